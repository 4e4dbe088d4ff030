"""Vectors of documents through the cache, and what stands on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.providers import OfflineEmbedder, OfflineScorer, decoded, embedded, scored, through_cache
from gleanery.operators.ranking import nearest
from gleanery.sources.views import table

from .catalog import query

EMBEDDER = OfflineEmbedder(64)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache as an earlier run left it: two documents of three; a tenth of another text, an eleventh of another model, a thirteenth
    cut short."""
    some = inputs(spark, sf_dir).filter("id % 3 <> 0").withColumn("input_hash", F.sha2("text", 256))
    rows = embedded(some, EMBEDDER)
    hash_ = F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("input_hash"))
    model = F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("model"))
    blob = F.when(F.col("id") % 13 == 0, F.substring("embedding", 1, 7)).otherwise(F.col("embedding"))
    return rows.select("id", model.alias("model"), "dimension", hash_.alias("input_hash"), blob.alias("embedding"))


VECTORS = """h AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS input_hash FROM documents),
b AS (SELECT *, list_transform(range(64), lambda i: ('0x' || substr(input_hash, (2 * (i % 32) + 1)::INT, 2))::INT / 255.0::DOUBLE - 0.5::DOUBLE) AS c FROM h),
vectors AS MATERIALIZED (SELECT id, input_hash, list_transform(c, lambda x: (x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-6))::FLOAT::DOUBLE) AS v FROM b)"""
STORED = "id % 3 <> 0 AND id % 10 <> 0 AND id % 11 <> 0 AND id % 13 <> 0"


@query("K9_vectors_through_the_cache", f"WITH {VECTORS} SELECT id, input_hash, CASE WHEN {STORED} THEN 'stored' ELSE 'computed' END AS origin, list_transform(v, lambda x: round(x, 5)) AS v FROM vectors")
def through(spark, sf):
    found, _ = through_cache(inputs(spark, sf), earlier(spark, sf), EMBEDDER)
    return decoded(found).select("id", "input_hash", "origin", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("K9_cache_after_the_run", "SELECT doc_id AS id, 'offline-sha256' AS model, 64::INT AS dimension, sha256(coalesce(text, '')) AS input_hash, 256::INT AS bytes FROM documents")
def written_back(spark, sf):
    """The cache has every document once, under its present text and model."""
    _, cache = through_cache(inputs(spark, sf), earlier(spark, sf), EMBEDDER)
    return cache.select("id", "model", "dimension", "input_hash", F.octet_length("embedding").alias("bytes"))


@query("K9_nearest_of_each_nation", f"""WITH {VECTORS}, n AS (SELECT n_nationkey AS nation, sha256(n_name) AS k FROM nation), nb AS (SELECT nation, list_transform(range(64), lambda i: ('0x' || substr(k, (2 * (i % 32) + 1)::INT, 2))::INT / 255.0::DOUBLE - 0.5::DOUBLE) AS c FROM n),
nv AS (SELECT nation, list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT::DOUBLE) AS w FROM nb)
SELECT nation, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT nation, id, list_dot_product(v, w) AS score, row_number() OVER (PARTITION BY nation ORDER BY round(list_dot_product(v, w), 9) DESC, id) AS rank FROM vectors, nv) WHERE rank <= 3""")  # fmt: skip
def nearest_of_nations(spark, sf):
    """The three documents nearest to each nation's name, both from the provider; the documents' vectors come from the cache."""
    found, _ = through_cache(inputs(spark, sf), earlier(spark, sf), EMBEDDER)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("text")).withColumn("input_hash", F.sha2("text", 256))
    # ids of the two sides are of different things, so those of nations lie below zero
    asked = decoded(embedded(names, EMBEDDER)).select((-F.col("id") - 1).alias("left_id"), "v")
    have = decoded(found).select(F.col("id").alias("right_id"), F.col("v").alias("w"), F.lit(1.0).alias("value"))
    return nearest(asked, have, 3).select((-F.col("left_id") - 1).cast("int").alias("nation"), F.col("right_id").alias("id"), "rank", F.round("score", 6).alias("score"))


@query("K11_offline_scores", "SELECT doc_id AS id, 'offline-sha256' AS model, round(('0x' || substr(sha256(coalesce(text, '')), 1, 2))::INT * 10 / 255.0::DOUBLE, 6) AS score FROM documents")
def scores(spark, sf):
    return scored(inputs(spark, sf), OfflineScorer()).select("id", "model", F.round("score", 6).alias("score"))
