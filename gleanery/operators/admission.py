"""Admission by quotas, the judged pool, and the shortlist's order into sections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Retriever:
    """A ranking that may admit ``quota`` rows: by ``signal`` descending, ids ascending, rows without a signal left out."""

    name: str
    signal: Column
    quota: int


def ranking(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The ``most`` first rows with their place from 1. The limit comes before the window, so the window sees that many."""
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def admit(df: DataFrame, keep: int, retrievers: list[Retriever], explorers: Column, slots: int, key: Column, blend: Column) -> DataFrame:
    """Adds stage, admitted_by (names in order) and exploration to article_id, auto and the signals.

    Rows marked ``auto`` come first, whatever their number. Then each retriever takes its quota of rows that nobody took, while
    fewer than ``keep`` are in; then ``slots`` rows that pass ``explorers`` between places ``keep`` and 2.5 ``keep`` of the
    blend, by ``key``; then the blend fills up. A retriever also signs the rows of its own first ``quota`` that others took.
    Since at most ``keep`` rows are in before a retriever takes, it never looks beyond its first ``keep + quota``: the last
    step walks these short lists alone.
    """
    lists = [df.filter("auto").orderBy("article_id").limit(keep).select(F.lit(0).alias("step"), "article_id", F.col("article_id").alias("place"), "auto")]
    for step, r in enumerate(retrievers, 1):
        found = df.withColumn("__s", r.signal).filter("__s IS NOT NULL")
        lists.append(ranking(found, [F.desc("__s"), F.asc("article_id")], keep + r.quota).select(F.lit(step).alias("step"), "article_id", "place", "auto"))
    by_blend = [F.desc("__b"), F.asc("article_id")]
    blended = df.withColumns({"__b": blend, "__e": explorers, "__k": key}).filter("__b IS NOT NULL")
    band = ranking(blended, by_blend, -(-5 * keep // 2)).filter((F.col("place") > keep) & F.col("__e"))
    band = band.withColumn("place", F.row_number().over(Window.orderBy("__k", "article_id")))
    lists.append(band.select(F.lit(len(retrievers) + 1).alias("step"), "article_id", "place", "auto"))
    lists.append(ranking(blended, by_blend, 2 * keep).select(F.lit(len(retrievers) + 2).alias("step"), "article_id", "place", "auto"))

    names = ["auto_include", *[r.name for r in retrievers], "exploration", "blend"]
    quotas = [keep, *[r.quota for r in retrievers], slots, None]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames) or [pd.DataFrame({"step": [], "article_id": [], "place": [], "auto": []})])
        signed: dict[int, list[str]] = {}
        taken = 0
        for step, part in rows.sort_values(["step", "place"]).groupby("step"):
            name, left = names[int(step)], max(keep - taken, 0)
            quota = left if quotas[int(step)] is None else quotas[int(step)]
            free = min(left, quota)
            order = list(zip(part["article_id"], part["auto"], strict=True))
            if step == 0:
                taken = len(order)
                continue
            for item, auto in order[:quota]:
                if auto or item in signed:
                    signed.setdefault(item, []).append(name)
            for item in [i for i, auto in order if not auto and i not in signed][:free]:
                signed[item] = [name]
                taken += 1
        yield pd.DataFrame({"article_id": pd.Series(list(signed), dtype="int64"), "names": pd.Series([",".join(n) for n in signed.values()], dtype="object")})

    short = lists[0]
    for more in lists[1:]:
        short = short.unionByName(more)
    signed = short.select("step", "article_id", F.col("place").cast("long").alias("place"), "auto").coalesce(1).mapInPandas(walk, "article_id long, names string")
    out = df.join(F.broadcast(signed), "article_id", "left")  # at most some lists of keep and quota rows
    by = F.when(F.col("auto"), F.concat_ws(",", F.lit("auto_include"), "names")).otherwise(F.col("names"))
    first = F.split(by, ",")[0]
    return out.select(*df.columns, F.when(by.isNotNull(), "admitted").otherwise("not_admitted").alias("stage"), by.alias("admitted_by"), F.coalesce(first == "exploration", F.lit(False)).alias("exploration"))


def pool(df: DataFrame, most: int, share: float, retriever_size: int, blend: str, signals: list[str]) -> DataFrame:
    """article_id and pooled: autos, the first ``share`` of ``most`` by blend and the first of each signal are in; the blend
    fills what is left of ``most``, and nothing that is in goes."""
    chosen = ranking(df.filter(F.col(blend).isNotNull()), [F.desc(blend), F.asc("article_id")], int(most * share)).select("article_id")
    for s in signals:
        chosen = chosen.union(ranking(df.filter(F.col(s).isNotNull()), [F.desc(s), F.asc("article_id")], retriever_size).select("article_id"))
    chosen = chosen.distinct().withColumn("hit", F.lit(True))
    marked = df.join(F.broadcast(chosen), "article_id", "left").withColumn("hit", F.coalesce("hit", "auto"))
    left = marked.agg(F.greatest(F.lit(most) - F.count_if("hit"), F.lit(0)).alias("left"))
    fill = ranking(marked.filter("NOT hit"), [F.desc_nulls_last(blend), F.asc("article_id")], most)
    fill = fill.join(F.broadcast(left)).filter("place <= left").select("article_id", F.lit(True).alias("filled"))
    return marked.join(F.broadcast(fill), "article_id", "left").select("article_id", (F.col("hit") | F.coalesce("filled", F.lit(False))).alias("pooled"))


def lineup(picks: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """article_id, section, position, is_lead from proposed picks (article_id, section, place) over known articles (article_id,
    auto, score): unknown ids and repeats go, missing autos come back under their own section, the list is cut to ``most`` by
    (auto, score), positions restart in each section, and the first of all leads."""
    once = picks.groupBy("article_id").agg(F.min(F.struct("place", "section")).alias("p")).select("article_id", "p.place", "p.section")
    rows = known.join(once, "article_id", "left").filter("auto OR place IS NOT NULL")
    rows = rows.select("article_id", "auto", "score", F.coalesce("section", "home").alias("section"), F.coalesce("place", F.lit(2**31 - 1)).alias("place"))
    kept = rows.orderBy(F.desc("auto"), F.desc_nulls_last("score"), F.asc("article_id")).limit(most)
    order = [F.asc("place"), F.asc("article_id")]
    kept = kept.withColumn("all", F.row_number().over(Window.orderBy(*order)))  # a lineup of ``most`` rows
    return kept.select("article_id", "section", F.row_number().over(Window.partitionBy("section").orderBy(*order)).alias("position"), (F.col("all") == 1).alias("is_lead"))
