"""An extension: the newest verdict of each article as keyed state.

One row of state is kept for each article: its newest explicit verdict by (time, id). A late or repeated row that isn't newer changes
nothing, however often it comes. A cleared verdict is a tombstone: it is kept, so that an older row that comes late can't bring
the article back, until an event-time timer fires ``LOOK_BACK`` after it and the state is dropped. Each trigger writes only the
articles that changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gleanery.operators.ranking import latest

LOOK_BACK = "26 hours"
HOURS = 26
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CHANGE = "article_id long, us long, id long, label string, value double"
STATE = "us long, id long, label string, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVerdict(StatefulProcessor):
    """Emits an article's verdict when it changes, tombstones included. Times are microseconds since the epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for r in rows:
            mine = (r["us"], r["id"], r["label"], r["value"])
            if best is None or mine[:2] > best[:2]:
                best = mine
        if best is None or best == before:
            return
        self.newest.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[2] == "cleared":
            self.handle.registerTimer(best[0] // 1000 + HOURS * 3_600_000)
        yield Row(article_id=key[0], us=best[0], id=best[1], label=best[2], value=best[3])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Nothing older than the look-back is admitted any more, so the tombstone has done its work."""
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def changes_of(verdicts: DataFrame) -> DataFrame:
    """The changes of a stream of verdicts (id, article_id, event_at, label, value, explicit)."""
    rows = verdicts.filter("explicit AND article_id IS NOT NULL").withColumn("at", F.col("event_at").cast("timestamp")).withWatermark("at", LOOK_BACK)
    keyed = rows.select("article_id", "at", F.unix_micros("at").alias("us"), "id", "label", "value").groupBy("article_id")
    return keyed.transformWithState(statefulProcessor=NewestVerdict(), outputStructType=StructType.fromDDL(CHANGE), outputMode="Update", timeMode="EventTime")


def kept(verdicts: DataFrame, folder: str, trigger: dict | None = None) -> None:
    """Runs the stream over what there is; every batch writes its changes to a folder of its own number, so one that is run again
    after a failure replaces what it wrote."""
    spark = verdicts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = changes_of(verdicts).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """article_id, id, label, value: the newest change of each article, without tombstones."""
    rows = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{folder}/changes")
    return latest(rows, "article_id", [F.col("us"), F.col("id")], F.col("label") == "cleared").select("article_id", "id", "label", "value")
