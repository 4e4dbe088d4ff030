"""Entity resolution by two keys without a walk through the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(rows: DataFrame, seq: str, first_key: str, second_key: str) -> DataFrame:
    """Adds ``cluster``: in the order of ``seq`` a row joins the cluster of its first key, else of its second, else opens one.
    Null keys join nothing.

    A key belongs to the cluster of the first row that has it. So a row that isn't the first with its first key follows that
    first row; else it follows the first row with its second key; else it is a root. Both come from a minimum by key, which
    is aggregated before the shuffle, and pointer doubling finds the roots in a logarithmic number of joins; hot keys and
    large components need no group of their own.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir() and (shared := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(shared)
    cut = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    firsts = rows
    for key, name in ((first_key, "__one"), (second_key, "__two")):
        least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias(name))
        firsts = firsts.join(least, key, "left")
    up = F.when(F.col("__one") < F.col(seq), F.col("__one")).when(F.col("__two") < F.col(seq), F.col("__two")).otherwise(F.col(seq))
    links = cut(firsts.select(F.col(seq).alias("node"), up.alias("up")))
    while True:
        above = links.filter("node <> up").select(F.col("node").alias("up"), F.col("up").alias("top"))  # roots need no row
        jumped = cut(links.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        moved = jumped.filter("moved").limit(1).count()
        links = jumped.drop("moved")
        if not moved:
            return rows.join(links.select(F.col("node").alias(seq), F.col("up").alias("cluster")), seq)


def merge(members: DataFrame) -> DataFrame:
    """One row for each cluster of (entry_id, cluster, url, words, published, fetched, comments, author, direct): the richest
    entry gives id, URL and words (ties to the smaller id); earliest times; all entry ids; the comments link of the best kind,
    the last of it; the first author that isn't blank, of direct entries only if there are any."""
    kind = F.when(F.contains(F.lower("comments"), F.lit("news.ycombinator.com")), 2).when(F.contains(F.lower("comments"), F.lit("lobste.rs")), 1).otherwise(0)
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    known = has("author")
    best = F.struct("words", -F.col("entry_id"))
    pick = lambda direct: F.min_by(F.when(direct & known, F.col("author")), F.when(direct & known, F.col("entry_id")))
    return members.groupBy("cluster").agg(
        F.max_by("entry_id", best).alias("best_entry"),
        F.max_by("url", best).alias("url"),
        F.max("words").alias("words"),
        F.min(F.coalesce("published", "fetched")).alias("first_seen"),
        F.min("published").alias("published"),
        F.array_sort(F.collect_set("entry_id")).alias("sources"),
        F.max_by("comments", F.when(has("comments"), F.struct(kind, "entry_id"))).alias("comments"),
        F.when(F.bool_or("direct"), pick(F.col("direct"))).otherwise(pick(F.lit(True))).alias("author"),
    )
