"""Deletes that reach child tables, inserts behind a guard, and keyed writes that touch only the partitions they change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.ranking import latest
from gleanery.sources.sinks import replace_partitions, staged


@dataclass(frozen=True)
class Child:
    """A table whose ``foreign`` column points to the ``key`` of ``parent``. With ``keep`` its rows stay and lose the pointer."""

    name: str
    parent: str
    foreign: str
    key: str
    keep: bool = False


def cascaded(tables: dict[str, DataFrame], root: str, gone: Column, children: Sequence[Child]) -> dict[str, DataFrame]:
    """The tables after the rows of ``root`` for which ``gone`` holds were deleted, with all rows that point to a deleted row, however far
    down. ``children`` come after their parents. The keys of deleted rows are written once and spread as one set; pointers that are
    null stay."""
    deleted = {root: staged(tables[root].filter(F.coalesce(gone, F.lit(False))), "deleted")}
    out = {**tables, root: tables[root].filter(~F.coalesce(gone, F.lit(False)))}
    for child in children:
        keys = deleted[child.parent].select(F.col(child.key).alias("__gone")).filter("__gone IS NOT NULL").distinct()
        rows = out[child.name]
        if child.keep:
            marked = rows.join(keys, F.col(child.foreign) == F.col("__gone"), "left")
            out[child.name] = marked.withColumn(child.foreign, F.when(F.col("__gone").isNull(), F.col(child.foreign))).select(*rows.columns)
            continue
        lost = staged(rows.join(keys, F.col(child.foreign) == F.col("__gone"), "left_semi"), "deleted")
        deleted[child.name] = lost if child.name not in deleted else deleted[child.name].unionByName(lost)
        out[child.name] = rows.join(keys, F.col(child.foreign) == F.col("__gone"), "left_anti")
    return out


def insert_guarded(held: DataFrame, new: DataFrame, key: Column, guarded: Column, order: Sequence[str]) -> DataFrame:
    """``held`` and the rows of ``new`` that may join it: among rows for which ``guarded`` holds, a key stands once. Rows outside the guard
    neither block nor are blocked; of new rows with one key the first by ``order`` is taken. A null key blocks nothing."""
    rows = new.withColumns({"__k": key, "__g": F.coalesce(guarded, F.lit(False)) & key.isNotNull()})
    free = rows.filter("NOT __g").drop("__k", "__g")
    taken = held.withColumn("__k", key).filter(F.coalesce(guarded, F.lit(False)) & F.col("__k").isNotNull()).select("__k").distinct()
    asked = rows.filter("__g").join(taken, "__k", "left_anti").drop("__g")
    first = latest(asked, "__k", [F.struct(*[-F.col(c) for c in order])]).drop("__k")
    return held.unionByName(free.select(*held.columns)).unionByName(first.select(*held.columns))


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, key: str, by: str) -> None:
    """Rows of ``new`` replace those with the same key under ``path`` (Parquet, partitioned by ``by``); a row may move to another partition.
    Only partitions that lose or gain rows are written; they are replaced as a whole, so a run that is repeated leaves the same."""
    old = spark.read.parquet(path)
    left = old.join(new.select(key), key, "left_semi").select(by)
    touched = staged(left.union(new.select(by)).distinct(), "touched")
    kept = old.join(touched, by, "left_semi").join(new.select(key), key, "left_anti").select(*new.columns)
    # partitions that only lost rows would not be written by a dynamic overwrite if nothing is left of them
    rows = staged(kept.unionByName(new), "merged")
    replace_partitions(rows, path, by)
    empty = touched.join(rows.select(by).distinct(), by, "left_anti").collect()  # names of partitions
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in empty:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={r[0]}"), True)
