"""Text, time and vector functions, signals, the blend and the shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import age_days, decay, dot, gate, long_form, reading_minutes, sample_words, title_key, weighted_mean, word_count
from gleanery.operators.ranking import diversified, leader_clusters, mid_ranks, nearest, numbered_within, similarities, top_k
from gleanery.sources.views import NOW, articles, candidates, table, vectors, with_views

from .catalog import query

WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')))"


@query("X2_title_key", with_views("articles", ", k AS (SELECT article_id, lower(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')) AS key FROM articles) SELECT article_id, CASE WHEN octet_length(encode(key)) >= 12 THEN key END AS key FROM k"))
def x2(spark, sf):
    return articles(spark, sf).select("article_id", title_key(F.col("title")).alias("key"))


@query("X5_url_for_equality", "SELECT page_id, lower(regexp_replace(trim(url), '/$', '')) AS url FROM pages")
def x5(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_replace(F.trim("url"), "/$", "")).alias("url"))


@query("X8_word_count", f"SELECT doc_id, {WORDS}::INT AS words FROM documents")
def x8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query("X13_truncated", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short FROM documents")
def x13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("…"))).otherwise(F.col("text")).alias("short"))


@query("X14_sample", "WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g'), '\\s+') AS w FROM documents) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 1500 THEN w ELSE w[1:600] || w[(len(w) - 500) // 2 + 1:(len(w) - 500) // 2 + 500] || w[len(w) - 399:] END, ' ')) AS sample FROM w")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(sample_words(F.col("text"))).alias("sample"))


@query("X15_tokens", "SELECT doc_id, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM documents")
def x15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.ceil(F.octet_length("text") / 4).alias("tokens"))


@query("X16_content_hash", with_views("articles", "SELECT article_id, sha256('Title: ' || title || chr(10) || chr(10) || left(text, 8000)) AS hash FROM articles"))
def x16(spark, sf):
    return articles(spark, sf).select("article_id", F.sha2(F.concat(F.lit("Title: "), "title", F.lit("\n\n"), F.left("text", F.lit(8000))), 256).alias("hash"))


@query("X17_author", "SELECT c_custkey, nullif(lower(trim(regexp_replace(replace(c_name, '#', '  '), '\\s+', ' ', 'g'))), '') AS author FROM customer")
def x17(spark, sf):
    name = F.lower(F.trim(F.regexp_replace(F.replace("c_name", F.lit("#"), F.lit("  ")), r"\s+", " ")))
    return table(spark, sf, "customer").select("c_custkey", F.nullif(name, F.lit("")).alias("author"))


@query("T3_age_and_decay", f"WITH a AS (SELECT event_id, greatest(date_diff('second', date_trunc('second', ts), TIMESTAMP '{NOW}'), 0) / 86400.0 AS age FROM events) SELECT event_id, round(age, 9) AS age, round(pow(0.5, age / 60), 9) AS decay FROM a")
def t3(spark, sf):
    age = age_days(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", F.round(age, 9).alias("age"), F.round(decay(age, 60.0), 9).alias("decay"))


@query("T2_day_and_week", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week FROM events")
def t2(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week"))


@query("T6_dates_for_display", "SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS long, strftime(o_orderdate, '%m-%d') AS short FROM orders")
def t6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd MMMM yyyy").alias("long"), F.date_format("o_orderdate", "MM-dd").alias("short"))


@query("V1_dot", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 9) AS d FROM embeddings")
def v1(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(dot(F.col("v"), F.reverse("v")), 9).alias("d"))


@query("V3_gate", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n <= 40 THEN 0.0 WHEN n >= 80 THEN 1.0 ELSE (n - 40) / 40 END::DOUBLE AS gate FROM n")
def v3(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", gate(F.col("n"), 40, 80).cast("double").alias("gate"))


@query("V4_long_form", f"WITH w AS (SELECT doc_id, text, lang, {WORDS} AS w FROM documents) SELECT doc_id, round(35 * pow(least(greatest((w - 300) / 2200.0, 0), 1), 0.65) - CASE WHEN w < 60 THEN 20 ELSE 0 END - CASE WHEN lang = 'fr' THEN 15 ELSE 0 END, 6) AS points, greatest(ceil(w / 220), 1)::BIGINT AS minutes FROM w")
def v4(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", "lang", word_count(F.col("text")).alias("w"))
    return w.select("doc_id", F.round(long_form(F.col("w"), F.col("w") < 60, F.coalesce(F.col("lang") == "fr", F.lit(False))), 6).alias("points"), reading_minutes(F.col("w")).alias("minutes"))


@query("V12_exploration_key", "SELECT doc_id, sha256('2024-01-15' || doc_id) AS key FROM documents")
def v12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("2024-01-15"), F.col("doc_id").cast("string")), 256).alias("key"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """right_id, w, value of rated vectors: 1 for good ones that aren't toxic, -1 for the others."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(-1.0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), good.alias("value")).join(vectors(spark, sf_dir), "vec_id").select(F.col("vec_id").alias("right_id"), F.col("v").alias("w"), "value")


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = vectors(spark, sf_dir).groupBy("label").agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("x"))
    return first.select(F.col("x.vec_id").alias("right_id"), F.col("x.v").alias("w"))


def interest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """left_id, right_id, score of all articles against the few interests, an interest not against itself."""
    left = vectors(spark, sf_dir).select(F.col("vec_id").alias("left_id"), "v")
    return similarities(left, interests(spark, sf_dir)).filter("left_id <> right_id")


PAIRS = "i AS (SELECT min(vec_id) AS right_id, arg_min(embedding::DOUBLE[], vec_id) AS w FROM embeddings GROUP BY label), s AS (SELECT vec_id AS left_id, right_id, list_dot_product(embedding::DOUBLE[], w) AS score FROM embeddings, i WHERE vec_id <> right_id)"


@query("J10_article_by_interest", f"WITH {PAIRS} SELECT left_id, right_id, round(score, 9) AS score FROM s")
def j10(spark, sf):
    return interest_scores(spark, sf).select("left_id", "right_id", F.round("score", 9).alias("score"))


@query("W11_interest_z_scores", f"WITH {PAIRS}, z AS (SELECT *, (score - avg(score) OVER (PARTITION BY right_id)) / greatest(stddev_pop(score) OVER (PARTITION BY right_id), 1e-3) AS z FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(z, 9) DESC, right_id) AS rank FROM z) SELECT left_id, right_id, round(z, 6) AS z, rank::INT AS rank FROM r WHERE rank <= 3")
def w11(spark, sf):
    s = interest_scores(spark, sf)
    stats = s.groupBy("right_id").agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-3)).alias("std"))  # one row for each interest
    z = s.join(F.broadcast(stats), "right_id").withColumn("z", (F.col("score") - F.col("mean")) / F.col("std"))
    return top_k(z, "left_id", [F.desc(F.round("z", 9)), F.asc("right_id")], 3).select("left_id", "right_id", F.round("z", 6).alias("z"), "rank")


KNN = """WITH r AS (SELECT doc_id AS right_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE -1.0 END AS value, embedding::DOUBLE[] AS w FROM labels JOIN embeddings ON vec_id = doc_id),
s AS (SELECT vec_id AS left_id, right_id, value, list_dot_product(embedding::DOUBLE[], w) AS score FROM embeddings, r WHERE vec_id <> right_id),
k AS (SELECT *, row_number() OVER (PARTITION BY left_id, value ORDER BY round(score, 9) DESC, right_id) AS rank FROM s)"""


@query("J11_rated_neighbours", KNN + " SELECT left_id, value::DOUBLE AS value, right_id, rank::INT AS rank FROM k WHERE rank <= 5")
def j11(spark, sf):
    return neighbours(spark, sf).select("left_id", "value", "right_id", "rank")


def neighbours(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    left = vectors(spark, sf_dir).select(F.col("vec_id").alias("left_id"), "v")
    return nearest(left, rated(spark, sf_dir), k)


@query("V8_knn_score", KNN + ", m AS (SELECT left_id, avg(score) FILTER (value > 0) AS pos, avg(score) FILTER (value < 0) AS neg FROM k WHERE rank <= 5 GROUP BY 1) SELECT left_id, round(coalesce(pos, 0) - 0.75 * coalesce(neg, 0), 6) AS knn FROM m")
def v8(spark, sf):
    mean = lambda sign: F.coalesce(F.avg(F.when(F.col("value") == sign, F.col("score"))), F.lit(0.0))
    return neighbours(spark, sf).groupBy("left_id").agg(F.round(mean(1.0) - 0.75 * mean(-1.0), 6).alias("knn"))


@query("J12_nearest_to_one", "WITH q AS (SELECT embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], w), 9) AS score FROM embeddings, q WHERE vec_id <> 3) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def j12(spark, sf):
    one = vectors(spark, sf).filter("vec_id = 3").select(F.col("vec_id").alias("right_id"), F.col("v").alias("w"))
    scored = similarities(vectors(spark, sf).filter("vec_id <> 3").select(F.col("vec_id").alias("left_id"), "v"), one)
    return scored.select(F.col("left_id").alias("vec_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


MIDRANK = "(rank() OVER (ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {0}) + 1) / 2.0) / count(*) OVER ()"


@query("W7_mid_rank", f"SELECT p_partkey, round({MIDRANK.format('p_size')}, 9) AS percentile FROM part")
def w7(spark, sf):
    return mid_ranks(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey", {"p_size": "percentile"}).select("p_partkey", F.round("percentile", 9).alias("percentile"))


BLEND = [("size", 0.3), ("price", 0.5), ("rated", 0.2)]


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id and its blend: percentiles of two signals and a rate that many articles lack."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    normal = mid_ranks(parts, "article_id", {"a": "size", "b": "price"})
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("article_id")).agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("rated"))
    return normal.join(seen, "article_id", "left").select("article_id", F.round(100 * weighted_mean([(F.col(c), w) for c, w in BLEND]), 6).alias("blend"))


BLENDED = f"""n AS (SELECT p_partkey AS article_id, {MIDRANK.format("p_size")} AS size, {MIDRANK.format("p_retailprice")} AS price FROM part),
e AS (SELECT user_id AS article_id, avg((event_type = 'purchase')::INT) AS rated FROM events GROUP BY 1),
b AS (SELECT article_id, round(100 * (0.3 * size + 0.5 * price + 0.2 * coalesce(rated, 0)) / (0.8 + CASE WHEN rated IS NULL THEN 0 ELSE 0.2 END), 6) AS blend FROM n LEFT JOIN e USING (article_id))"""


@query("W8_rank_by_utility", f"WITH {BLENDED} SELECT article_id, row_number() OVER (PARTITION BY article_id % 10 ORDER BY blend DESC NULLS LAST, article_id)::INT AS rank FROM b")
def w8(spark, sf):
    rows = blended(spark, sf).withColumn("run", F.col("article_id") % 10)
    return numbered_within(rows, ["run"], [F.desc_nulls_last("blend"), F.asc("article_id")]).select("article_id", F.col("rank").cast("int").alias("rank"))


SHORTLIST, CLUSTER_THRESHOLD = 120, 0.3


def ranked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ``SHORTLIST`` articles with a vector, by blend."""
    top = blended(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("vec_id", "article_id"), "article_id").orderBy(F.desc("blend"), "article_id").limit(SHORTLIST)
    return top.select(F.col("article_id").alias("item"), "v", F.row_number().over(Window.orderBy(F.desc("blend"), "article_id")).alias("rank"))


#: Leaders in the order of rank; ``near``: the earlier ranks that are close enough.
CLUSTERS = f"""{BLENDED}, top AS (SELECT article_id AS item, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY blend DESC, article_id)::INT AS rank FROM b JOIN embeddings ON vec_id = article_id ORDER BY blend DESC, article_id LIMIT {SHORTLIST}),
near AS (SELECT a.rank, coalesce(list(p.rank ORDER BY p.rank) FILTER (list_cosine_similarity(a.v, p.v) >= {CLUSTER_THRESHOLD}), []) AS near FROM top a LEFT JOIN top p ON p.rank < a.rank GROUP BY 1),
walk AS (SELECT 0 AS rank, []::INT[] AS leaders, 0 AS lead UNION ALL
 SELECT n.rank, CASE WHEN len(list_intersect(leaders, near)) = 0 THEN list_append(leaders, n.rank) ELSE leaders END, coalesce(list_min(list_intersect(leaders, near)), n.rank) FROM walk w JOIN near n ON n.rank = w.rank + 1),
clusters AS (SELECT t.item, t.rank, l.item AS cluster FROM walk w JOIN top t USING (rank) JOIN top l ON l.rank = w.lead)"""


@query("K2_leader_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT item, rank, cluster FROM clusters")
def k2(spark, sf):
    return leader_clusters(ranked_vectors(spark, sf), CLUSTER_THRESHOLD, SHORTLIST)


KEPT, PROTECTED, CAP = 60, 10, 2


def rounds_sql(kept: int, protected: int, cap: int) -> str:
    """The rounds of a shortlist over cand (item, rank, cluster, auto, exploration, x: its place among explorations)."""
    return f"""first AS (SELECT item FROM cand WHERE rank <= {protected} OR auto),
explored AS (SELECT item FROM (SELECT item, row_number() OVER (ORDER BY rank) AS k FROM cand WHERE exploration AND x <= 3 AND item NOT IN (FROM first)) WHERE k <= greatest({kept} - (SELECT count(*) FROM first), 0)),
i0 AS (FROM first UNION ALL FROM explored), target AS (SELECT greatest({kept}, count(*)) AS n FROM i0),
c1 AS (SELECT cand.*, row_number() OVER (PARTITION BY cluster ORDER BY rank) + (SELECT count(*) FROM cand o WHERE o.cluster = cand.cluster AND o.item IN (FROM i0)) AS place FROM cand WHERE item NOT IN (FROM i0)),
t1 AS (SELECT item, rank FROM c1 WHERE place <= {cap} QUALIFY row_number() OVER (ORDER BY rank) <= (SELECT n FROM target) - (SELECT count(*) FROM i0)),
i1 AS (FROM i0 UNION ALL SELECT item FROM t1),
suppressed AS (SELECT item FROM c1 WHERE place > {cap} AND ((SELECT count(*) FROM i1) < (SELECT n FROM target) OR rank < (SELECT max(rank) FROM t1))),
c2 AS (SELECT cand.*, row_number() OVER (PARTITION BY cluster ORDER BY rank) + (SELECT count(*) FROM cand o WHERE o.cluster = cand.cluster AND o.item IN (FROM i1)) AS place FROM cand WHERE item NOT IN (FROM i1)),
t2 AS (SELECT item FROM c2 WHERE place <= 3 QUALIFY row_number() OVER (ORDER BY rank) <= (SELECT n FROM target) - (SELECT count(*) FROM i1)),
i2 AS (FROM i1 UNION ALL FROM t2),
t3 AS (SELECT item FROM cand WHERE item NOT IN (FROM i2) QUALIFY row_number() OVER (ORDER BY rank) <= (SELECT n FROM target) - (SELECT count(*) FROM i2)),
i3 AS (FROM i2 UNION ALL FROM t3)"""


@query("K3_diversified_shortlist", f"""WITH RECURSIVE {CLUSTERS}, cand AS (SELECT *, item % 17 = 0 AS auto, row_number() OVER (PARTITION BY item % 7 = 3 ORDER BY rank) AS x, item % 7 = 3 AS exploration FROM clusters),
{rounds_sql(KEPT, PROTECTED, CAP)}
SELECT item, rank, cluster, CASE WHEN item IN (FROM i3) THEN 'shortlisted' ELSE 'assessed' END AS stage,
 CASE WHEN item IN (FROM i3) THEN NULL WHEN item IN (FROM suppressed) THEN 'cluster_suppressed' ELSE 'shortlist_cap' END AS reason FROM cand""")  # fmt: skip
def shortlist(spark, sf):
    """Every seventeenth id stands for an automatic one, ids that leave 3 by 7 for explorations."""
    c = leader_clusters(ranked_vectors(spark, sf), CLUSTER_THRESHOLD, SHORTLIST)
    return diversified(c.withColumns({"auto": F.col("item") % 17 == 0, "exploration": F.col("item") % 7 == 3}), KEPT, PROTECTED, CAP)
