"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, racks and shards, each shard with a weight; a node's weight is the sum below it. Every document
descends: at each level it draws -ln(u)/weight for each child, with u hashed from the document's key and the
child's name, and takes the child with the smallest draw. A draw changes only with its node's own weight, so when
a shard's weight changes, documents move only into or within the subtrees that contain it. A shard that is added
as a region of its own therefore takes documents into itself and moves nothing else.

Defined cases: a null text has no bytes; a null key is hashed as the text ``null``; repeated rows go to the same shard
and get slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

ROW_BYTES = 8
"""Bytes beside the text that a document counts for."""


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def base_tree(shards: int = 24, racks: int = 3, per_rack: int = 4) -> list[Shard]:
    """Regions of ``racks`` racks of ``per_rack`` shards, all of weight 1, filled in order."""
    return [Shard(i // (racks * per_rack), i // per_rack % racks, i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    return [*tree, Shard(max(s.region for s in tree) + 1, 0, max(s.shard for s in tree) + 1, weight)]


def drawn(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest weighted draw; ties go to the first."""
    draws = []
    for place, (name, weight, value) in enumerate(children):
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 13), 16, 10).cast("double")
        draw = -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)
        draws.append(F.struct(draw.alias("draw"), F.lit(place).alias("place"), value.alias("value")))
    return draws[0]["value"] if len(draws) == 1 else F.least(*draws)["value"]


def descend(key: Column, tree: list[Shard]) -> Column:
    """Nested draws: the shards of a rack, the racks of a region, the regions. Zero-weight shards take nothing."""
    live = [s for s in tree if s.weight > 0]
    regions = []
    for region in sorted({s.region for s in live}):
        racks = []
        for rack in sorted({s.rack for s in live if s.region == region}):
            own = [s for s in live if (s.region, s.rack) == (region, rack)]
            shard = drawn(key, [(f"{region}.{rack}.{s.shard}", s.weight, F.lit(s.shard)) for s in own])
            racks.append((f"{region}.{rack}", sum(s.weight for s in own), shard))
        regions.append((str(region), sum(w for _, w, _ in racks), drawn(key, racks)))
    return drawn(key, regions)


def with_slots(assigned: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: the place of a row in its shard, gapless from 0, in the given order.

    Rows are range-sorted by shard and order, so a shard is spread over as many tasks as its size asks for. A row's
    number in its task is known locally; a table of one row for each shard of a task adds what came before.
    """
    sorted_rows = assigned.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    placed = staged(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "slots")
    task = F.shiftright("__at", 33)
    runs = placed.groupBy(F.col(shard).alias("__shard"), task.alias("__task")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    # bounded by tasks + shards rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__shard", "__task", (before - F.col("first")).alias("__shift"))
    joined = placed.join(F.broadcast(runs), (F.col(shard) == F.col("__shard")) & (task == F.col("__task")))
    return joined.select(*assigned.columns, (F.col("__at") + F.col("__shift")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and the shard that one more would make of it."""
    tree = base_tree(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    assigned = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown(tree)).cast("int").alias("grown_shard"),
    )
    return with_slots(assigned, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
