"""Latest-wins, rates, percentiles, similarity joins, clustering: the operators that the queries share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import dot
from gleanery.sources.sinks import staged


def latest(events: DataFrame, key: str, order: list[Column], tombstone: Column | None = None) -> DataFrame:
    """The newest row of each key; rows that ``tombstone`` marks are dropped after ranking. Aggregates before the shuffle."""
    row = F.struct(*[F.col(c) for c in events.columns])
    newest = events.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")
    return newest.filter(~tombstone) if tombstone is not None else newest


def smoothed_rates(credits: DataFrame, key: str | list[str]) -> DataFrame:
    """Beta-smoothed share of positive credit by key: (up + 1) / (up + down + 2)."""
    up, down = F.sum(F.greatest("credit", F.lit(0.0))), F.sum(F.greatest(-F.col("credit"), F.lit(0.0)))
    return credits.groupBy(*([key] if isinstance(key, str) else key)).agg(up.alias("up"), down.alias("down"), F.count("*").alias("n")).withColumn("rate", (F.col("up") + 1) / (F.col("up") + F.col("down") + 2))


def mid_ranks(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Adds for each column of ``names`` the mid-rank percentile (below + (equal + 1) / 2) / n of the values present, 0.5 if all are
    equal, null where there is none. ``key`` is unique.

    All columns go in one pass: distinct values are counted by column and ranked by a range sort with offsets by partition, so
    no window spans the table, and rows without a value take no part. ``df`` is read three times; stage a dear one.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in names])
    values = df.select(key, F.inline(pairs)).filter("__v IS NOT NULL")
    counts = values.groupBy("__c", "__v").agg(F.count("*").alias("__n"))
    ordered = counts.repartitionByRange("__c", "__v").sortWithinPartitions("__c", "__v").withColumn("__part", F.spark_partition_id())
    local = ordered.withColumn("__below", F.sum("__n").over(Window.partitionBy("__part", "__c").orderBy("__v")) - F.col("__n"))
    local = staged(local, "mid-ranks")  # a row for each column and distinct value; read twice, with the same partitions
    parts = local.groupBy("__c", "__part").agg(F.sum("__n").alias("__all"))  # a row for each column in each partition
    of = Window.partitionBy("__c")
    before = parts.select("__c", "__part", (F.sum("__all").over(of.orderBy("__part")) - F.col("__all")).alias("__before"), F.sum("__all").over(of).alias("__total"))
    share = (F.col("__below") + F.col("__before") + (F.col("__n") + 1) / 2.0) / F.col("__total")
    placed = local.join(F.broadcast(before), ["__c", "__part"]).select("__c", "__v", F.when(F.col("__n") == F.col("__total"), 0.5).otherwise(share).alias("__p"))
    ranked = values.join(placed, ["__c", "__v"]).groupBy(key).agg(*[F.max(F.when(F.col("__c") == c, F.col("__p"))).alias(out) for c, out in names.items()])
    return df.join(ranked, key, "left")


def top_k(df: DataFrame, key: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def similarities(left: DataFrame, right: DataFrame, most: int = 5000) -> DataFrame:
    """left_id, right_id, score of every left (left_id, v) with every right (right_id, w). The right side is a list that people
    keep (interests, rated examples); it is broadcast after a check that it has at most ``most`` rows, and goes in slices
    of that many otherwise."""
    n = right.count()
    slices = max(1, -(-n // most))
    parts = [right] if slices == 1 else [right.filter(F.pmod(F.xxhash64("right_id"), F.lit(slices)) == i) for i in range(slices)]
    scored = [left.join(F.broadcast(p)).select("left_id", "right_id", dot(F.col("v"), F.col("w")).alias("score")) for p in parts]
    out = scored[0]
    for more in scored[1:]:
        out = out.union(more)
    return out


NEAREST = "left_id long, value double, right_id long, score double"


def best_of_block(left_ids: np.ndarray, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray, values: np.ndarray, k: int) -> pa.Table:
    """For each left vector and each value the ``k`` right ones with the largest inner products, an id never with itself. A
    product of matrices proposes, sums in the order of the components decide; ties at nine digits go to the smaller id."""
    columns: list[list] = [[], [], [], []]
    for value in np.unique(values):
        mine = np.flatnonzero(values == value)
        own_ids, own = right_ids[mine], right[mine]
        for lo in range(0, len(left_ids), 512):
            rough = left[lo : lo + 512] @ own.T
            rough[left_ids[lo : lo + 512, None] == own_ids] = -np.inf
            n = min(k, len(mine))
            least = np.partition(rough, len(mine) - n, axis=1)[:, len(mine) - n]
            at, near = np.nonzero((rough >= least[:, None] - 4e-9 * np.maximum(1, np.abs(least[:, None]))) & (rough > -np.inf))
            score = np.cumsum(left[lo + at] * own[near], axis=1)[:, -1]
            order = np.lexsort((own_ids[near], -np.round(score, 9), at))
            at, near, score = at[order], near[order], score[order]
            first = np.searchsorted(at, at)  # where the row's run begins
            kept = np.arange(len(at)) - first < k
            for column, part in zip(columns, (left_ids[lo + at[kept]], np.full(kept.sum(), value), own_ids[near[kept]], score[kept]), strict=True):
                column.append(part)
    types = (pa.int64(), pa.float64(), pa.int64(), pa.float64())
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, types, strict=True)], ["left_id", "value", "right_id", "score"])


def nearest(left: DataFrame, right: DataFrame, k: int, most: int = 20_000, block: int = 4096) -> DataFrame:
    """left_id, value, right_id, score, rank: for each left (left_id, v) and value the ``k`` right ones (right_id, w, value) with
    the largest inner products.

    A right side of at most ``most`` rows, which is counted first, goes to the tasks, and left vectors stay where they are.
    Beyond that both sides are dealt to blocks by a hash of the id and every two blocks meet in one task. Either way no
    more than ``k`` rows for each left vector, value and block leave a task. Null vectors and vectors of another length
    than the first right one take no part.
    """
    spark = left.sparkSession
    some = right.filter(F.col("w").isNotNull()).select(F.size("w").alias("d")).first()
    if some is None:
        return spark.createDataFrame([], NEAREST).withColumn("rank", F.lit(0))
    d = some["d"]
    left = left.filter(F.size("v") == d).select(F.col("left_id").cast("long").alias("left_id"), "v")
    right = right.filter(F.size("w") == d).select(F.col("right_id").cast("long").alias("right_id"), "w", F.col("value").cast("double").alias("value"))
    matrix = lambda column: column.combine_chunks().flatten().to_numpy().reshape(-1, d)
    sides = lambda t: (t["right_id"].to_numpy(), matrix(t["w"]), t["value"].to_numpy())
    n = right.count()
    if n <= most:
        shipped = spark.sparkContext.broadcast(sides(right.toArrow()))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                yield from best_of_block(t["left_id"].to_numpy(), matrix(t["v"]), *shipped.value, k).to_batches()

        found = left.mapInArrow(best, NEAREST)
    else:
        lefts, rights = max(1, -(-left.count() // block)), -(-n // block)
        deal = lambda df, key, own, other, of, to: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
        a = deal(left, "left_id", "a", "b", lefts, rights)
        b = deal(right, "right_id", "b", "a", rights, lefts)
        meet = lambda key, x, y: best_of_block(x["left_id"].to_numpy(), matrix(x["v"]), *sides(y), k) if len(x) and len(y) else best_of_block(*[np.zeros((0, 1))] * 5, k)
        found = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(meet, NEAREST)
    return top_k(found, ["left_id", "value"], [F.desc(F.round("score", 9)), F.asc("right_id")], k)


def leader_clusters(shortlist: DataFrame, threshold: float, most: int) -> DataFrame:
    """item, rank, cluster: in the order of rank each item joins the first leader with cosine >= threshold or becomes one; an
    item without a vector stands alone. Works on a shortlist: the ``most`` first by rank."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"item": [], "rank": [], "v": []})]).sort_values("rank")
        leaders: list[tuple[int, np.ndarray]] = []
        out = []
        for item, vector in zip(rows["item"], rows["v"], strict=True):
            unit = None
            if vector is not None and (norm := np.linalg.norm(vector)) > 0:
                unit = np.asarray(vector, float) / norm
            found = next((lead for lead, w in leaders if unit is not None and float(unit @ w) >= threshold), None)
            if found is None:
                found = item
                if unit is not None:
                    leaders.append((item, unit))
            out.append(found)
        yield pd.DataFrame({"item": rows["item"].astype("int64"), "rank": rows["rank"].astype("int32"), "cluster": pd.Series(out, dtype="int64").values})

    first = shortlist.orderBy("rank").limit(most).select("item", "rank", "v").coalesce(1)
    return first.mapInPandas(walk, "item long, rank int, cluster long")


def diversified(ranked: DataFrame, keep: int, protected: int, cap: int, explorers: int = 3, wider: int = 3) -> DataFrame:
    """item, rank, cluster, stage, reason of a ranked list (item, rank, cluster, auto, exploration) of a bounded length.

    The first ``protected`` and the automatic ones are in, whatever their cluster holds, and count there; so are the first
    ``explorers`` marked for exploration while there is room. The rest fills up to ``keep`` in the order of rank: first while
    its cluster holds fewer than ``cap``, then fewer than ``wider``, then without a cap. Who is left out was suppressed by
    its cluster in the first of these rounds, or found no room.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames) or [pd.DataFrame({c: [] for c in ("item", "rank", "cluster", "auto", "exploration")})]).sort_values("rank")
        items = list(rows.itertuples(index=False))
        held: dict[int, int] = {}
        chosen: set[int] = set()
        suppressed: set[int] = set()

        def take(x: tuple) -> None:
            if x.item not in chosen:
                chosen.add(x.item)
                held[x.cluster] = held.get(x.cluster, 0) + 1

        for i, x in enumerate(items):
            if i < protected or x.auto:
                take(x)
        for x in [x for x in items if x.exploration][:explorers]:
            if len(chosen) < keep:
                take(x)
        target = max(keep, len(chosen))
        for most in (cap, wider, None):
            for x in items:
                if len(chosen) >= target or x.item in chosen:
                    continue
                if most is not None and held.get(x.cluster, 0) >= most:
                    if most == cap:
                        suppressed.add(x.item)
                    continue
                take(x)
        stage = ["shortlisted" if x.item in chosen else "assessed" for x in items]
        reason = [None if x.item in chosen else "cluster_suppressed" if x.item in suppressed else "shortlist_cap" for x in items]
        out = rows[["item", "rank", "cluster"]].astype({"item": "int64", "rank": "int32", "cluster": "int64"})
        yield out.assign(stage=pd.Series(stage, index=out.index, dtype=object), reason=pd.Series(reason, index=out.index, dtype=object))

    return ranked.coalesce(1).mapInPandas(walk, "item long, rank int, cluster long, stage string, reason string")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge by key; a null of ``new`` leaves the old value."""
    o, n = old.alias("o"), new.alias("n")
    merged = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *merged)


def funnel(items: DataFrame, stage: str, order: list[str]) -> DataFrame:
    """stage, stopped, reached, percent: how many items got to each stage, when each carries the stage it stopped at. Stages
    outside ``order`` count in the total alone."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    stopped = items.groupBy(stage).agg(F.count("*").alias("stopped"))
    spark = items.sparkSession
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(order)], f"{stage} string, place int")
    full = stages.join(stopped, stage, "left").na.fill(0, ["stopped"]).join(F.broadcast(stopped.agg(F.sum("stopped").alias("total"))))
    earlier = F.coalesce(F.sum("stopped").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stage
    reached = F.col("total") - earlier
    return full.select(F.col(stage), "stopped", reached.alias("reached"), F.round(100.0 * reached / F.col("total")).cast("long").alias("percent"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds n from 1 in the order of a unique column, by a range sort and offsets of its partitions."""
    return numbered_within(df, [], [F.asc(order)], "n")


def numbered_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``, the number from 1 of a row in its group by an order without ties. A range sort over group and order splits a group
    of any size over many tasks; a row for each group in each partition carries the offset. Nulls are a group. The sorted rows
    are written once, so that both readings see the same partitions, and a lost executor doesn't sort anew."""
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("__part", F.spark_partition_id())
    at = [F.col("__part"), *[F.col(g) for g in groups]]
    local = staged(ranged.withColumn(name, F.row_number().over(Window.partitionBy(*at).orderBy(*order))), "numbered")
    sizes = local.groupBy(*at).agg(F.count("*").alias("__size"))
    before = sizes.select(
        F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], (F.sum("__size").over(Window.partitionBy(*at[1:]).orderBy("__part")) - F.col("__size")).alias("__before")
    )
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return local.join(before, same).select(*df.columns, (F.col(name) + F.col("__before")).alias(name))
