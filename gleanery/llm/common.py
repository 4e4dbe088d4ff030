"""What the corpus operators share: staged tables and word hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, for staged tables.

    It is ``spark.checkpoint.dir``. Where that is unset, a plain local session (tests) takes a temporary
    folder, which its only machine shares with itself, and a cluster takes the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        found = f"{tempfile.gettempdir()}/gleanery-stages" if local else spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, so a lost executor costs
    the reading of a file, and two consumers cost one computation. What no later result reads is given to ``discard``;
    the rest stays as long as the shared folder does."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_to_small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From here on this session sends at most ``size`` to a Python task at once, unless its setting is lower. Spark's own
    64 MB stand in an executor several times: as rows, as vectors, and as Python's copy, for each task that runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    amount = lambda x: int(x.rstrip("bkmg")) * units.get(x.rstrip("b")[-1:], 1)
    now = amount(spark.conf.get(key).lower())
    if now <= 0 or now > amount(size):
        spark.conf.set(key, size)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_hashes(text: Column) -> Column:
    """Words (runs of letters and digits, lower case) of a text as an array of 64-bit hashes; null text has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
