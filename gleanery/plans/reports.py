"""Verdicts, counts, funnels, costs: windows and aggregates of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.ranking import funnel, latest, top_k
from gleanery.params import RANKING
from gleanery.sources.views import NOW, articles, candidates, runs, table, verdicts, with_views

from .catalog import query

HALF_LIFE = 60.0


def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(verdicts(spark, sf_dir).filter("explicit"), "article_id", [F.col("event_at"), F.col("id")], F.col("label") == "cleared")


def verdicts_within(rows: DataFrame, days: int) -> DataFrame:
    """The newest explicit verdict of each article among those of the last ``days`` days; older ones don't count at all."""
    since = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return latest(rows.filter(F.col("explicit") & (F.col("event_at") >= since)), "article_id", [F.col("event_at"), F.col("id")], F.col("label") == "cleared")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query("W1_latest_verdict", with_views("verdicts latest", "SELECT article_id, id, label, value FROM latest"))
def w1(spark, sf):
    return latest_verdicts(spark, sf).select("article_id", "id", "label", "value")


@query(
    "W2_slop_authors",
    with_views("verdicts articles", """, newest AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY event_at DESC, id DESC) AS rn FROM verdicts WHERE explicit)
SELECT DISTINCT feed FROM newest JOIN articles USING (article_id) WHERE rn = 1 AND label = 'slop'"""),
)
def w2(spark, sf):
    return latest_verdicts(spark, sf).filter("label = 'slop'").join(articles(spark, sf).select("article_id", "feed"), "article_id").select("feed").distinct()


@query("W3_verdicts_in_the_look_back", with_views("verdicts latest candidates", """, r AS (SELECT l.article_id, l.label, l.value, c.run_id, c.stage, row_number() OVER (PARTITION BY l.article_id ORDER BY c.run_id DESC) AS k
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY event_at DESC, id DESC) AS rn2 FROM verdicts WHERE explicit AND event_at >= TIMESTAMP '2024-02-01' - INTERVAL 180 DAY) WHERE rn2 = 1 AND label <> 'cleared') l JOIN candidates c USING (article_id)) SELECT article_id, label, value, run_id, stage, 180::INT AS days FROM r WHERE k = 1
UNION ALL SELECT article_id, label, value, NULL, NULL, 14::INT FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY event_at DESC, id DESC) AS rn2 FROM verdicts WHERE explicit AND event_at >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY) WHERE rn2 = 1 AND label <> 'cleared'"""))  # fmt: skip
def w3(spark, sf):
    """The newest verdict within 180 days with the newest run of its article, and within 14 days for comparison."""
    newest = candidates(spark, sf).groupBy("article_id").agg(F.max(F.struct("run_id", "stage")).alias("r"))
    long_ = verdicts_within(verdicts(spark, sf), RANKING.look_back_days).join(newest, "article_id").select("article_id", "label", "value", "r.run_id", "r.stage", F.lit(180).alias("days"))
    return long_.union(verdicts_within(verdicts(spark, sf), 14).select("article_id", "label", "value", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(14)))


@query("W3_latest_verdict_with_newest_run", with_views("verdicts latest candidates", """, r AS (SELECT l.article_id, l.label, c.run_id, c.stage, row_number() OVER (PARTITION BY l.article_id ORDER BY c.run_id DESC) AS k
 FROM latest l JOIN candidates c USING (article_id)) SELECT article_id, label, run_id, stage FROM r WHERE k = 1"""))  # fmt: skip
def w3_any_age(spark, sf):
    newest = candidates(spark, sf).groupBy("article_id").agg(F.max(F.struct("run_id", "stage")).alias("r"))
    return latest_verdicts(spark, sf).join(newest, "article_id").select("article_id", "label", "r.run_id", "r.stage")


@query("W6_last_value_by_user_and_kind", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1, 2")
def w6(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("W10_top_articles_of_a_run", with_views("candidates", """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY utility DESC, article_id) AS rank FROM candidates)
SELECT run_id, article_id, rank::INT AS rank FROM r WHERE rank <= 3"""))  # fmt: skip
def w10(spark, sf):
    return top_k(candidates(spark, sf), "run_id", [F.desc("utility"), F.asc("article_id")], 3).select("run_id", "article_id", "rank")


@query("W13_number_within_section", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS position FROM customer")
def w13(spark, sf):
    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("position"))


@query("W14_days_since_first_issue", with_views("runs", "SELECT run_id, date_diff('day', min(day) OVER (), day)::INT + 1 AS number FROM runs"))
def w14(spark, sf):
    r = runs(spark, sf)
    return r.join(F.broadcast(r.agg(F.min("day").alias("first")))).select("run_id", (F.date_diff("day", "first") + 1).alias("number"))


@query("A1_count_selected", with_views("candidates", "SELECT count(*) AS n FROM candidates WHERE stage = 'R'"))
def a1(spark, sf):
    return candidates(spark, sf).filter("stage = 'R'").agg(F.count("*").alias("n"))


@query("A2_verdicts_by_label", with_views("verdicts latest", "SELECT label, count(*) AS n FROM latest GROUP BY 1"))
def a2(spark, sf):
    return latest_verdicts(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("A3_stage_by_reason", with_views("candidates", "SELECT stage, nullif(reason, 'F') AS reason, count(*) AS n FROM candidates GROUP BY 1, 2"))
def a3(spark, sf):
    return candidates(spark, sf).groupBy("stage", F.nullif("reason", F.lit("F")).alias("reason")).agg(F.count("*").alias("n"))


@query("A4_funnel", with_views("candidates", """, s AS (SELECT d.stage, d.place, count(c.stage) AS stopped FROM (VALUES ('A', 0), ('N', 1), ('R', 2)) d(stage, place) LEFT JOIN candidates c USING (stage) GROUP BY 1, 2),
t AS (SELECT stage, stopped, (SELECT count(*) FROM candidates) AS total, coalesce(sum(stopped) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s)
SELECT stage, stopped, (total - earlier)::BIGINT AS reached, round(100.0 * (total - earlier) / total)::BIGINT AS percent FROM t"""))  # fmt: skip
def a4(spark, sf):
    return funnel(candidates(spark, sf), "stage", ["A", "N", "R"])


@query("A5_first_and_last_day", with_views("runs", "SELECT CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM runs"))
def a5(spark, sf):
    return runs(spark, sf).agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))


@query("A6_distinct_providers", with_views("runs", "SELECT DISTINCT provider FROM runs"))
def a6(spark, sf):
    return runs(spark, sf).select("provider").distinct()


@query("A8_week_by_label", with_views("verdicts", "SELECT CAST(CAST(date_trunc('week', event_at) AS DATE) AS VARCHAR) AS week, label, count(*) AS n FROM verdicts WHERE explicit GROUP BY 1, 2"))
def a8(spark, sf):
    return verdicts(spark, sf).filter("explicit").groupBy(F.to_date(F.date_trunc("week", "event_at")).cast("string").alias("week"), "label").agg(F.count("*").alias("n"))


@query("A9_tally_by_stage", with_views("verdicts latest candidates", """SELECT stage, count(*) FILTER (value > 0) AS up, count(*) FILTER (value < 0) AS down, count(*) AS rated, round(count(*) FILTER (value > 0) / count(*), 9) AS ratio
FROM latest JOIN (SELECT article_id, arg_max(stage, run_id) AS stage FROM candidates GROUP BY 1) USING (article_id) GROUP BY 1"""))  # fmt: skip
def a9(spark, sf):
    newest = candidates(spark, sf).groupBy("article_id").agg(F.max_by("stage", "run_id").alias("stage"))
    up = F.count(F.when(F.col("value") > 0, 1))
    return latest_verdicts(spark, sf).join(newest, "article_id").groupBy("stage").agg(
        up.alias("up"), F.count(F.when(F.col("value") < 0, 1)).alias("down"), F.count("*").alias("rated"), F.round(up / F.count("*"), 9).alias("ratio")
    )


@query("A10_mean_seconds_between_events", "WITH g AS (SELECT user_id, date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) AS s, count(*) AS n FROM events GROUP BY 1) SELECT user_id, (s // n)::BIGINT AS mean_s FROM g")
def a10(spark, sf):
    second = F.date_trunc("second", "ts")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.timestamp_diff("SECOND", F.min(second), F.max(second)).alias("s"), F.count("*").alias("n"))
    return g.select("user_id", F.expr("s div n").alias("mean_s"))


@query("A11_ratio_by_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 9) AS ratio FROM events GROUP BY 1")
def a11(spark, sf):
    n = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    both = n("purchase", "error")
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.when(both > 0, n("purchase") / both), 9).alias("ratio"))


@query("A19_composite_log_score", "SELECT user_id, round(sum(log10(1 + greatest(value, 0))) + 0.5 * log10(1 + count(*)), 9) AS score FROM events GROUP BY 1")
def a19(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.log10(1 + F.greatest("value", F.lit(0.0)))) + 0.5 * F.log10(1 + F.count("*")), 9).alias("score"))


@query("A20_shrunk_evidence", with_views("verdicts latest articles", "SELECT feed, round(least(greatest((sum(value) + 0.6) / (count(*) + 2) * 100, 0), 100), 6) AS evidence FROM latest JOIN articles USING (article_id) GROUP BY 1"))
def a20(spark, sf):
    e = (F.sum("value") + 0.6) / (F.count("*") + 2) * 100
    return latest_verdicts(spark, sf).join(articles(spark, sf).select("article_id", "feed"), "article_id").groupBy("feed").agg(F.round(F.least(F.greatest(e, F.lit(0.0)), F.lit(100.0)), 6).alias("evidence"))


@query("A21_modal_values", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS k FROM c) SELECT o_orderstatus, o_orderpriority, n, k::INT AS rank FROM r WHERE k <= 3")
def a21(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return top_k(counts, "o_orderstatus", [F.desc("n"), F.asc("o_orderpriority")], 3)


@query("A22_richest_article_of_a_feed", with_views("articles", "SELECT feed, arg_max(article_id, (length(text), -article_id)) AS richest FROM articles WHERE text IS NOT NULL GROUP BY 1"))
def a22(spark, sf):
    return articles(spark, sf).filter("text IS NOT NULL").groupBy("feed").agg(F.max_by("article_id", F.struct(F.length("text"), -F.col("article_id"))).alias("richest"))


@query("A23_union_of_arrays", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY 1")
def a23(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("A24_first_non_blank", "SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE trim(text) <> '' AND role = 'user' GROUP BY 1")
def a24(spark, sf):
    return table(spark, sf, "conversations").filter("trim(text) <> '' AND role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


@query("A25_feed_counts", with_views("articles", """, n AS (SELECT feed, count(*) AS n, count(DISTINCT category) AS languages FROM articles GROUP BY 1)
SELECT feed, n, languages, (SELECT count(DISTINCT feed) FROM articles) AS feeds, row_number() OVER (ORDER BY n DESC, feed NULLS FIRST) <= 5 AS top FROM n"""))  # fmt: skip
def a25(spark, sf):
    """Articles and languages of each feed, how many feeds there are, and whether a feed is among the five largest."""
    n = articles(spark, sf).groupBy("feed").agg(F.count("*").alias("n"), F.count_distinct("category").alias("languages"))
    feeds = n.agg(F.count("feed").alias("feeds"))  # one row
    first = n.orderBy(F.desc("n"), F.asc_nulls_first("feed")).limit(5).select(F.col("feed").alias("f"), F.lit(True).alias("hit"))
    out = n.join(F.broadcast(first), F.col("feed").eqNullSafe(F.col("f")), "left").join(F.broadcast(feeds))
    return out.select("feed", "n", "languages", "feeds", F.coalesce("hit", F.lit(False)).alias("top"))


@query("A26_nested_lists", """WITH g AS (SELECT CASE WHEN p_size % 7 <> 0 THEN p_brand END AS category, p_partkey % 20 AS slot, p_name FROM part), k AS (SELECT category, slot, list(p_name ORDER BY lower(p_name), p_name) AS names FROM g GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY category NULLS LAST, slot)::INT AS place, category, slot::INT AS slot, names FROM k""")  # fmt: skip
def a26(spark, sf):
    """Names by category, those without one last, each list in the order of lower case."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("p_name"), F.col("p_name").alias("n")))), lambda x: x["n"])
    g = table(spark, sf, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("category"), (F.col("p_partkey") % 20).cast("int").alias("slot"), "p_name")
    k = g.groupBy("category", "slot").agg(names.alias("names"))
    return k.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("category"), "slot")))  # a row for each category and slot


@query("U6_calendar", "WITH d AS (SELECT CAST(unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-11', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(d.day AS VARCHAR) AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1")
def u6(spark, sf):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-10')) AS day")  # at most 400 days
    counts = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))
