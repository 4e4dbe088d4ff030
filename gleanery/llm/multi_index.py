"""Nearest neighbours by inner product through an inverted multi-index.

Both halves of a vector are quantised on their own, with as many centroids as give cells of about ``per_cell`` vectors (at most
``most_centroids``), fitted on a bounded sample of vectors (``sample_size``, taken by a hash of the id); a cell is a pair
of centroids, and every vector is indexed in its cell. A query walks the pairs by falling sum of its inner products with the two
centroids, with a heap, until the cells that it has passed hold the ``share`` of all entries; every entry of these cells is reranked by
its exact inner product in double precision.

The share is measured for each table, on 200 queries of the sample: it is the least one that reaches ``recall`` of their true
neighbours within the sample, which lie farther off than those in the whole table. Of the cells on the way those are left out that
can't hold an answer: the inner product of a query and an entry of a cell is bounded by half (q.c plus |q| times the largest
distance from the centroid, or |q| times the largest norm, whichever is less), and ``nearest`` sampled vectors score more. With
``share=1`` every other cell is passed, and the search is exact for vectors of any norms.

Vectors of one cell meet in blocks, dealt by a hash of the vector itself, as many as the cell's size asks for, so a
crowded cell is spread over tasks; a block keeps at most ``nearest`` + 1 ids of each distinct vector, which is all that an
answer of ``nearest`` can hold. A query goes to the blocks of its cells with the sum at which its walk ended, which tells its cells
there again. Answers of blocks are merged by query.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
ties go to the smaller id; repeated ids are entries of their own, and a query never finds its own id; fewer candidates than
``nearest`` are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged

SCHEMA = "query_id long, rank int, vec_id long, score double"
FOUND = "query_id long, vec_id long, score double"
BLOCK, GROUP = 4096, 8192


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    ids: np.ndarray  # of the sampled vectors
    sample: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = distances(vectors[:, : self.half], self.first), distances(vectors[:, self.half :], self.second)
        return a.argmin(axis=1).astype(np.int64) * len(self.second) + b.argmin(axis=1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1), 0)


def lloyd(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means from a spread of distinct starting rows."""
    starts = np.unique(x, axis=0)
    centroids = starts[np.random.default_rng(11).permutation(len(starts))[:k]].copy()
    for _ in range(rounds):
        nearest = distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def at_most(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each row of ``q`` with any entry of each centroid."""
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    bound = np.minimum(q @ centroids.T + length * radius, length * norm)
    return np.where(np.isnan(bound), np.inf, bound)


def to_beat(ids: np.ndarray, q: np.ndarray, index: Index, nearest: int) -> np.ndarray:
    """For each query a score that ``nearest`` sampled vectors of other ids have at least; -inf if there are fewer."""
    if len(index.ids) < nearest:
        return np.full(len(q), -np.inf)
    scores = q @ index.sample.T
    scores[(ids[:, None] == index.ids) | np.isnan(scores)] = -np.inf
    return np.partition(scores, len(index.ids) - nearest, axis=1)[:, len(index.ids) - nearest]


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float) -> tuple[list[int], float]:
    """Cells in the order of the sum (the multi-sequence walk), until they hold ``enough`` entries; and the last sum."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    rows, columns, many = first[a].tolist(), second[b].tolist(), len(second)
    heap, out, held, last = [(rows[0] + columns[0], 0, 0)], [], 0, -np.inf
    # a pair enters the heap behind its left neighbour, or, in the first column, behind the one above it
    while heap and held < enough:
        last, i, j = heapq.heappop(heap)
        cell = int(a[i]) * many + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(columns):
            heapq.heappush(heap, (rows[i] + columns[j + 1], i, j + 1))
        if not j and i + 1 < len(rows):
            heapq.heappush(heap, (rows[i + 1] + columns[0], i + 1, 0))
    return out, last


def measured_share(index: Index, sizes: np.ndarray, nearest: int, recall: float, queries: int = 200) -> float:
    """The least share of all entries whose cells, in the order of the walk, hold ``recall`` of the nearest sampled vectors."""
    n = len(index.ids)
    if n <= nearest or not sizes.sum():
        return 1.0
    asked = np.unique(np.linspace(0, n - 1, queries).astype(int))
    cells, shares = index.cells(index.sample), []
    for q, own in zip(index.sample[asked], index.ids[asked], strict=True):
        scores = np.where(index.ids == own, -np.inf, index.sample @ q)
        sums = (index.first @ q[: index.half])[:, None] + index.second @ q[index.half :]
        order = np.argsort(-sums.ravel(), kind="stable")
        passed = np.empty(len(order))
        passed[order] = np.cumsum(sizes[order])
        shares.append(passed[cells[np.argpartition(-scores, nearest - 1)[:nearest]]] / sizes.sum())
    return float(np.quantile(np.concatenate(shares), recall))


def usable(vector: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal vectors have equal scores."""
    return np.cumsum(rows * query, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def rounding(query: np.ndarray, lengths: np.ndarray | float) -> np.ndarray | float:
    """How far sums of the same products in another order may be from each other."""
    return 8 * len(query) * np.finfo(float).eps * np.sqrt((query**2).sum()) * lengths


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, passes: np.ndarray, ids: np.ndarray, cells: np.ndarray, vectors: np.ndarray, nearest: int) -> Iterator[tuple[int, int, float]]:
    """For each query the nearest entries of the block in the cells that it passes (a row of ``passes``; ``cells`` has the column of
    each entry)."""
    order = np.argsort(ids, kind="stable")
    ids, keyed = ids[order], np.ascontiguousarray(np.column_stack([cells[order], vectors[order]]))
    _, first, group = np.unique(keyed.view([("", keyed.dtype)] * keyed.shape[1]).ravel(), return_index=True, return_inverse=True)
    # the smallest ids of each distinct vector
    by_group = np.argsort(group, kind="stable")
    at = np.append(np.searchsorted(group[by_group], np.arange(len(first))), len(ids))
    members = [ids[by_group[s : min(e, s + nearest + 1)]] for s, e in zip(at[:-1], at[1:], strict=True)]
    distinct, cell = keyed[first, 1:], keyed[first, 0].astype(np.int64)
    lengths = np.sqrt((distinct**2).sum(axis=1))
    for lo in range(0, len(queries), 256):
        rough = queries[lo : lo + 256] @ distinct.T
        for row, query_id, query, passed in zip(rough, query_ids[lo : lo + 256].tolist(), queries[lo : lo + 256], passes[lo : lo + 256], strict=True):
            open_ = np.flatnonzero(passed[cell])
            if not len(open_):
                continue
            k = min(nearest + 1, len(open_))
            error = rounding(query, lengths[open_])
            least = np.partition(row[open_] - error, len(open_) - k)[len(open_) - k]
            near = open_[row[open_] + error >= least]
            found = [(-s, int(v)) for s, g in zip(exact(query, distinct[near]).tolist(), near, strict=True) for v in members[g] if v != query_id]
            for s, v in heapq.nsmallest(nearest, found):
                yield query_id, v, -s


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share a block of about BLOCK entries, a larger
    cell is split over blocks of its own."""
    first, many, block, filled = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK)), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if filled and filled + size > BLOCK:
            block, filled = block + 1, 0
        first[cell] = block
        filled += size
        if many[cell] > 1:
            block, filled = block + int(many[cell]), 0
    return first, many


def search(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, nearest: int = 20, per_cell: int = 48, most_centroids: int = 256, share: float | None = None, recall: float = 0.95, sample_size: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of every row for which ``is_query`` holds. ``share`` is measured for ``recall`` unless it is given."""
    spark = vectors.sparkSession
    held_to_small_batches(spark)
    picked = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    picked = picked.filter(usable(F.col("v")))
    lengths = {r["d"]: r["n"] for r in picked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    dimensions = max(lengths, key=lambda d: (lengths[d], -d))
    total = lengths[dimensions]
    picked = picked.filter(F.size("v") == dimensions)
    point = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    taken = picked.filter(point <= sample_size / total).select("vec_id", "v").toArrow()
    if not taken.num_rows:
        taken = picked.orderBy("vec_id").limit(1).select("vec_id", "v").toArrow()
    taken = taken.sort_by("vec_id")
    sample = matrix(taken["v"].combine_chunks(), dimensions)
    half, centroids = dimensions // 2, int(np.clip(np.sqrt(total / per_cell), 1, most_centroids))
    index = spark.sparkContext.broadcast(Index(lloyd(sample[:, :half], centroids), lloyd(sample[:, half:], centroids), taken["vec_id"].to_numpy(), sample))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(index.value.cells(matrix(b.column(1), dimensions)))], ["vec_id", "v", "q", "cell"])

    entries = staged(picked.mapInArrow(assign, "vec_id long, v array<double>, q boolean, cell long"), "multi-index")
    sizes = np.zeros(len(index.value.first) * len(index.value.second), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most centroids squared rows
        sizes[r["cell"]] = r["n"]
    first, many = blocks(sizes)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        books = (own.first, own.second)
        far = [np.zeros((2, len(c))) for c in books]
        for b in batches:
            v, cell = matrix(b.column(0), dimensions), b.column(1).to_numpy()
            for x, of, c, f in zip((v[:, :half], v[:, half:]), divmod(cell, len(own.second)), books, far, strict=True):
                np.maximum.at(f[0], of, np.sqrt(((x - c[of]) ** 2).sum(axis=1)))
                np.maximum.at(f[1], of, np.sqrt((x**2).sum(axis=1)))
        for side, f in enumerate(far):
            n = f.shape[1]
            yield pa.record_batch([pa.array([side] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(f[0]), pa.array(f[1])], ["side", "c", "radius", "norm"])

    reaches = [np.zeros((2, len(c))) for c in (index.value.first, index.value.second)]
    each = entries.select("v", "cell").mapInArrow(reach, "side int, c int, radius double, norm double")
    for r in each.groupBy("side", "c").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect():  # a row for each centroid
        reaches[r["side"]][:, r["c"]] = r["radius"], r["norm"]
    longest = float(np.sqrt(sum(f[1].max() ** 2 for f in reaches)))
    shipped = spark.sparkContext.broadcast((sizes, first, many))
    enough = (measured_share(index.value, sizes, nearest, recall) if share is None else share) * total
    slack = lambda q: rounding(q, longest)
    # queries beyond GROUP are dealt to groups, and every group meets the entries on its own
    groups = max(1, -(-entries.filter("q").count() // GROUP))

    def reached(q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By half: the inner products of queries with the centroids, and their bounds for entries there."""
        books = list(zip((q[:, :half], q[:, half:]), (index.value.first, index.value.second), reaches, strict=True))
        return [x @ c.T for x, c, _ in books], [at_most(x, c, *f) for x, c, f in books]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (of, start, spread) = index.value, shipped.value
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                q = matrix(part.column(1), dimensions)
                beat = to_beat(part.column(0).to_numpy(), q, own, nearest)
                sums, bounds = reached(q)
                at, where, ended, floor = [], [], [], []
                for i in range(len(q)):
                    cells, last = walk(-sums[0][i], -sums[1][i], of, enough)
                    least = beat[i] - slack(q[i])
                    x, y = np.divmod(np.array(cells, np.int64), len(own.second))
                    cells = np.array(cells)[bounds[0][i][x] + bounds[1][i][y] >= least] if cells else np.zeros(0, np.int64)
                    routes = np.unique(np.concatenate([np.arange(start[c], start[c] + spread[c]) for c in cells])) if len(cells) else cells
                    at += [i] * len(routes)
                    where += routes.tolist()
                    ended += [-last - slack(q[i])] * len(routes)
                    floor += [least] * len(routes)
                take = pa.array(at, pa.int32())
                yield pa.record_batch([pa.array(where, pa.int64()), *(c.take(take) for c in part.columns), pa.array(ended, pa.float64()), pa.array(floor, pa.float64())], ["block", "query_id", "v", "grp", "ended", "floor"])

    group = F.pmod(F.xxhash64("vec_id", F.lit("group")), F.lit(groups))
    asked = entries.filter("q").select("vec_id", "v", group.alias("grp")).mapInArrow(visit, "block long, query_id long, v array<double>, grp long, ended double, floor double")
    of_cell = lambda values: F.element_at(F.lit(values.tolist()).cast("array<long>"), (F.col("cell") + 1).cast("int"))
    block = of_cell(first) + F.pmod(F.xxhash64("vec_id"), of_cell(many))
    held = entries.select(block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), "vec_id", "v", "cell")

    def rerank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            ask, have = (matrix(t["v"].combine_chunks(), dimensions) for t in (left, right))
            cells, place = np.unique(right["cell"].to_numpy(), return_inverse=True)
            x, y = np.divmod(cells, len(index.value.second))
            sums, bounds = ((h[0][:, x] + h[1][:, y]) for h in reached(ask))
            passes = (sums >= left["ended"].to_numpy()[:, None]) & (bounds >= left["floor"].to_numpy()[:, None])
            rows = list(best_of_block(left["query_id"].to_numpy(), ask, passes, right["vec_id"].to_numpy(), place, have, nearest))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = asked.groupBy("block", "grp").cogroup(held.groupBy("block", "grp")).applyInArrow(rerank, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
