"""Writes: append, replaced partitions, files named by day, feeds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drafts(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see: below spark.checkpoint.dir, else the warehouse; below a temporary folder
    in a plain local session."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    shared = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh shared folder and read back: no step behind it computes it again, and a lost executor costs the
    reading of a file."""
    path = drafts(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Partitions that ``df`` has rows of are replaced, others stay; the write commits as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replaced(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """What ``replace_partitions`` leaves, as rows."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def publish(df: DataFrame, folder: str, name: str) -> None:
    """Text lines under ``folder/name``, written beside it first and moved into place as a whole: readers see the old files or the new
    ones. Folders that begin with a dot are no part of a scan."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = path(f"{folder}/.draft-{name}-{uuid.uuid4().hex}"), path(f"{folder}/{name}")
    df.write.text(draft.toString())
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(final, True)
    if not store.rename(draft, final):
        raise OSError(f"{draft} could not be moved to {final}")


def named_by_day(spark: SparkSession, pattern: str) -> DataFrame:
    """day, name, value of the lines of text files that carry a date in their names, or lie in folders that do; others are left out."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*\d{4}-\d{2}-\d{2}[^/]*)(?:/[^/]*)?$", 1)
    day = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1))
    return spark.read.text(pattern).select(day.alias("day"), name.alias("name"), "value").filter("day IS NOT NULL")


def kept_files(files: DataFrame, most: int | None = None, oldest: str | None = None) -> DataFrame:
    """Names (day, name) of the ``most`` newest days, or of days from ``oldest`` on."""
    if oldest is not None:
        files = files.filter(F.col("day") >= F.lit(oldest).cast("date"))
    if most is None:
        return files.select("day", "name").distinct()
    days = files.select("day").distinct().orderBy(F.desc("day")).limit(most)
    return files.select("day", "name").distinct().join(F.broadcast(days), "day", "left_semi")


def feed(df: DataFrame, order: list[Column], most: int, shown: list[str]) -> DataFrame:
    """``item``: the ``most`` first rows as JSON objects of the shown columns."""
    return df.orderBy(*order).limit(most).select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("item"))
