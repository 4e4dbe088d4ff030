"""Connected components of an edge table, by alternating stars; every round is a shuffle, nothing reaches the driver but counts.

The edges of a hub meet its minimum in inner sort-merge joins, whose hot partitions Spark splits (adaptive skew joins); all
else is aggregated before it is shuffled.

Defined cases: an edge from a node to itself, or with a null end, joins nothing; repeated edges and both directions count once; an empty
table gives no rows; nodes are numbers, ties don't arise, and columns other than a and b are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _oriented(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the smallest id in it) of every node of the edges (a, b). The number of rounds grows with the
    logarithm of the longest path."""
    held, mark = staged(_oriented(edges), "star"), None
    for _ in range(most_rounds):
        now = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark or not now["n"]:
            return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(held.select(F.col("b"), F.col("b")).distinct())
        mark, before = now, held
        held = staged(_oriented(_small_star(_oriented(_large_star(held)))), "star")
        discard(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
