"""The verdict log as a stream with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.sources.sinks import drafts
from gleanery.sources.views import table, verdicts_of, with_views
from gleanery.streaming.latest_state import EVENTS, current, kept

from .catalog import query


@query("T_stream_of_verdicts", with_views("verdicts latest", "SELECT article_id, id, label, value FROM latest"))
def verdict_state(spark, sf):
    """All events, dealt to several files by time and read a file a trigger; a fifth of them comes once more with the next file."""
    folder = drafts(spark, "verdict-stream")
    e = table(spark, sf, "events")
    part = F.least((F.dayofmonth("ts") / 11).cast("int"), F.lit(2))
    again = e.filter("event_id % 5 = 0").withColumn("part", F.least(part + 1, F.lit(2)))
    e.withColumn("part", part).unionByName(again).repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{folder}/log")
    for k in range(3):  # files arrive one after the other: the stream goes on from its checkpoint
        rows = spark.readStream.schema(EVENTS).parquet(f"{folder}/log/part={{{','.join(map(str, range(k + 1)))}}}")
        kept(verdicts_of(rows), folder)
    return current(spark, folder)
