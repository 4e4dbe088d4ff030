"""The curation model over the given tables, as DataFrames, and the same views as SQL for the checks.

Verdicts come from events, articles from documents, runs and their costs from orders, candidates and picks from line items,
vectors and interests from embeddings, comment threads from conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
"""The explicit present of all queries."""

LABELS = {"purchase": "loved", "click": "good", "error": "not_for_me", "signup": "slop", "view": "cleared"}
# What a verdict counts for.
VALUES = {"loved": 1.0, "good": 0.35, "not_for_me": -1.0, "slop": -1.0, "cleared": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column, pairs: dict):
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])[column]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, article_id, event_at, label, value, explicit."""
    return verdicts_of(table(spark, sf_dir, "events"))


def verdicts_of(e: DataFrame) -> DataFrame:
    """Verdicts of rows of events, from a table or a stream."""
    label = mapped(F.col("event_type"), LABELS)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("article_id"),
        F.col("ts").alias("event_at"),
        label.alias("label"),
        mapped(label, VALUES).alias("value"),
        (F.get_json_object("props", "$.k").cast("long") % 2 == 0).alias("explicit"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("article_id"), F.col("source").alias("feed"), F.split("text", "\n")[0].alias("title"), "text", F.col("lang").alias("category"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each (run, article) with its stage and reason; repeated line items count once, with the largest utility."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("article_id")).agg(
        F.min("l_returnflag").alias("stage"), F.min("l_linestatus").alias("reason"), F.max("l_extendedprice").alias("utility")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("provider"), F.col("o_totalprice").alias("cost"), F.col("o_orderstatus").alias("status"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


#: The views as common table expressions.
PRELUDE = {
    "verdicts": """verdicts AS (SELECT event_id AS id, user_id AS article_id, ts AS event_at,
 CASE event_type WHEN 'purchase' THEN 'loved' WHEN 'click' THEN 'good' WHEN 'error' THEN 'not_for_me' WHEN 'signup' THEN 'slop' ELSE 'cleared' END AS label,
 CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.35 WHEN 'view' THEN 0.0 ELSE -1.0 END::DOUBLE AS value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS explicit FROM events)""",
    "articles": "articles AS (SELECT doc_id AS article_id, source AS feed, string_split(text, chr(10))[1] AS title, text, lang AS category FROM documents)",
    "candidates": "candidates AS (SELECT l_orderkey AS run_id, l_partkey AS article_id, min(l_returnflag) AS stage, min(l_linestatus) AS reason, max(l_extendedprice) AS utility FROM lineitem GROUP BY 1, 2)",
    "runs": "runs AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS provider, o_totalprice AS cost, o_orderstatus AS status FROM orders)",
    "latest": """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY event_at DESC, id DESC) AS rn FROM verdicts WHERE explicit) WHERE rn = 1 AND label <> 'cleared')""",
}


def with_views(names: str, sql: str) -> str:
    """``sql`` behind the named views."""
    return "WITH " + ",\n".join(PRELUDE[n] for n in names.split()) + "\n" + sql
