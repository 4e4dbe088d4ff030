"""An extension: the verdict log as a stream. Late rows are taken within the look-back of the batch queries (26 hours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.ranking import latest

LOOK_BACK = "26 hours"


def verdict_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive, each event_id once within the look-back."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withWatermark("ts", LOOK_BACK).dropDuplicatesWithinWatermark(["event_id"])


def weekly_counts(stream: DataFrame) -> DataFrame:
    """week (its Monday), label, n; a week is final once the watermark passes its end."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return stream.groupBy(week, "label").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("week"), "label", "n")


def keep_latest(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the newest verdict of each article under ``table_path``.

    A batch writes a complete new version, named by its number, from the version before it; a batch that is run again after a
    failure reads the same older version and writes the same rows, so the outcome is the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{table_path}/version={number - 1}").unionByName(batch)
        latest(rows, "article_id", [F.col("ts"), F.col("event_id")]).write.mode("overwrite").parquet(f"{table_path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
