"""Hygiene, the judged pool, admission by quotas, the lineup, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import ROUNDUP_PHRASES, canonical_url, host, plain_text, roundup_title, title_key, under_domain, weighted_mean, word_count
from gleanery.operators.admission import lineup, pool
from gleanery.operators.ranking import leader_clusters
from gleanery.operators.resolution import merge, resolve
from gleanery.sources.views import table, with_views

from .catalog import ORACLE, query
from .lookups import CANONICAL
from .signals import CLUSTER_THRESHOLD, CLUSTERS, KNN, MIDRANK, PAIRS, SHORTLIST, WORDS, interest_scores, ranked_vectors, v8

BLOCKED = ["example.org", "tiontion.example.com"]
ROUNDUPS = "|".join(p.replace("'", "''") for p in ROUNDUP_PHRASES)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title, words, auto, triage, interest, knn, blend of articles that hygiene lets in. A rule on the id stands
    in for the scores that a judge would give; interest and nearest rated examples come from the vectors."""
    d = table(spark, sf_dir, "documents")
    auto = F.col("doc_id") % 97 == 0
    rows = d.select(
        F.col("doc_id").alias("article_id"), F.split("text", "\n")[0].alias("title"), word_count(F.col("text")).alias("words"), auto.alias("auto"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") * 7 % 11).cast("double")).alias("triage"),
    ).filter(auto | (F.col("source") != "src3") | F.col("source").isNull())
    best = interest_scores(spark, sf_dir).groupBy(F.col("left_id").alias("article_id")).agg(F.round(F.max("score"), 6).alias("interest"))
    near = v8(spark, sf_dir).withColumnRenamed("left_id", "article_id")
    rows = rows.join(best, "article_id", "left").join(near, "article_id", "left")
    mean = weighted_mean([(F.col("triage") / 10, 0.5), (F.col("interest"), 0.3), (F.col("knn"), 0.2)])
    return rows.withColumn("blend", F.round(mean, 6))


JUDGED = f"""best AS (SELECT left_id AS article_id, round(max(score), 6) AS interest FROM (WITH {PAIRS} SELECT * FROM s) GROUP BY 1),
near AS (SELECT left_id AS article_id, knn FROM ({ORACLE["V8_knn_score"]})),
d AS (SELECT doc_id AS article_id, string_split(text, chr(10))[1] AS title, {WORDS} AS words, doc_id % 97 = 0 AS auto, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 7 % 11)::DOUBLE END AS triage
 FROM documents WHERE doc_id % 97 = 0 OR source IS DISTINCT FROM 'src3'),
judged AS (SELECT *, round((coalesce(triage / 10 * 0.5, 0) + coalesce(interest * 0.3, 0) + coalesce(knn * 0.2, 0))
 / nullif(CASE WHEN triage IS NULL THEN 0 ELSE 0.5 END + CASE WHEN interest IS NULL THEN 0 ELSE 0.3 END + CASE WHEN knn IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS blend
 FROM d LEFT JOIN best USING (article_id) LEFT JOIN near USING (article_id))"""
FLOOR = f"words >= 300 AND NOT regexp_matches(lower(coalesce(title, '')), '{ROUNDUPS}') AND coalesce(triage >= 3, true)"


def over_floor():
    return (F.col("words") >= 300) & ~roundup_title(F.col("title")) & F.coalesce(F.col("triage") >= 3, F.lit(True))


@query("U5_pool_under_a_cap", f"""WITH {JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY blend DESC NULLS LAST, article_id) AS b, row_number() OVER (ORDER BY interest DESC NULLS LAST, article_id) AS i, row_number() OVER (ORDER BY knn DESC NULLS LAST, article_id) AS n FROM judged),
h AS (SELECT article_id, blend, auto OR (b <= 56 AND blend IS NOT NULL) OR (i <= 10 AND interest IS NOT NULL) OR (n <= 10 AND knn IS NOT NULL) AS hit FROM r),
f AS (SELECT article_id, hit, row_number() OVER (PARTITION BY hit ORDER BY blend DESC NULLS LAST, article_id) AS k FROM h)
SELECT article_id, hit OR k <= greatest(80 - (SELECT count(*) FROM h WHERE hit), 0) AS pooled FROM f""")  # fmt: skip
def u5(spark, sf):
    return pool(judged(spark, sf).persist(), 80, 0.7, 10, "blend", ["interest", "knn"])


@query("F12_hygiene_gate", f"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages),
pub AS (SELECT DISTINCT l_partkey AS page_id FROM lineitem WHERE l_orderkey % 50 = 0), rej AS (SELECT DISTINCT user_id AS page_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-28')
SELECT page_id, CASE WHEN page_id % 41 = 0 THEN 'auto' WHEN {" OR ".join(f"host = '{b}' OR host LIKE '%.{b}'" for b in BLOCKED)} THEN 'blocked' WHEN pub.page_id IS NOT NULL THEN 'published_before' WHEN rej.page_id IS NOT NULL THEN 'recently_rejected' END AS reason
FROM h LEFT JOIN pub USING (page_id) LEFT JOIN rej USING (page_id)""")  # fmt: skip
def f12(spark, sf):
    published = table(spark, sf, "lineitem").filter("l_orderkey % 50 = 0").select(F.col("l_partkey").alias("page_id")).distinct().withColumn("pub", F.lit(True))
    since = F.lit("2024-01-28").cast("timestamp_ntz")
    rejected = table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("ts") >= since)).select(F.col("user_id").alias("page_id")).distinct().withColumn("rej", F.lit(True))
    p = table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host")).join(published, "page_id", "left").join(rejected, "page_id", "left")
    reason = F.when(F.col("page_id") % 41 == 0, "auto").when(under_domain(F.col("host"), BLOCKED), "blocked").when(F.col("pub"), "published_before").when(F.col("rej"), "recently_rejected")
    return p.select("page_id", reason.alias("reason"))


@query("F13_semantic_floor", f"WITH {JUDGED} SELECT article_id FROM judged WHERE {FLOOR}")
def f13(spark, sf):
    return judged(spark, sf).filter(over_floor()).select("article_id")


@query("F11_roundup_title", with_views("articles", f"SELECT article_id FROM articles WHERE regexp_matches(lower(title || CASE WHEN article_id % 9 = 0 THEN ' Weekly Roundup' WHEN article_id % 9 = 1 THEN ' WHAT''S NOW AVAILABLE' ELSE '' END), '{ROUNDUPS}')"))
def f11(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.split("text", "\n")[0].alias("title"))
    tail = F.when(F.col("article_id") % 9 == 0, " Weekly Roundup").when(F.col("article_id") % 9 == 1, " WHAT'S NOW AVAILABLE").otherwise("")
    return d.filter(roundup_title(F.concat("title", tail))).select("article_id")


@query("W9_rank_inside_cluster", f"WITH RECURSIVE {CLUSTERS} SELECT item, rank, cluster, row_number() OVER (PARTITION BY cluster ORDER BY rank)::INT AS cluster_rank FROM clusters")
def w9(spark, sf):
    c = leader_clusters(ranked_vectors(spark, sf), CLUSTER_THRESHOLD, SHORTLIST)
    return c.withColumn("cluster_rank", F.row_number().over(Window.partitionBy("cluster").orderBy("rank")))


@query("K14_lineup", f"""WITH {JUDGED}, picks AS (SELECT doc_id + 3 * (doc_id % 2) AS article_id, 'section ' || (doc_id % 4) AS section, doc_id AS place FROM documents WHERE doc_id % 13 < 4),
once AS (SELECT article_id, min({{'place': place, 'section': section}}) AS p FROM picks GROUP BY 1),
r AS (SELECT article_id, auto, blend, coalesce(p.section, 'other') AS section, coalesce(p.place, 2147483647) AS place FROM judged LEFT JOIN once USING (article_id) WHERE auto OR p IS NOT NULL),
k AS (SELECT * FROM r ORDER BY auto DESC, blend DESC NULLS LAST, article_id LIMIT 28)
SELECT article_id, section, row_number() OVER (PARTITION BY section ORDER BY place, article_id)::INT AS position, row_number() OVER (ORDER BY place, article_id) = 1 AS is_lead FROM k""")  # fmt: skip
def k14(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id % 13 < 4")
    picks = d.select((F.col("doc_id") + 3 * (F.col("doc_id") % 2)).alias("article_id"), F.concat(F.lit("section "), F.col("doc_id") % 4).alias("section"), F.col("doc_id").alias("place"))
    return lineup(picks, judged(spark, sf).select("article_id", "auto", F.col("blend").alias("score"), F.lit("other").alias("home")), 28)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries, with the columns that a merge needs."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("page_id"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://lobste.rs/s/"), F.col("page_id"))).when(F.col("page_id") % 4 == 2, " ")
    day = F.timestamp_add("DAY", (F.col("page_id") * 11 % 23).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return p.select(
        F.col("page_id").alias("entry_id"), canonical_url(F.col("url")).alias("url"), title_key(title).alias("title_key"), word_count(plain_text(F.col("html"))).alias("words"),
        F.when(F.col("page_id") % 5 != 0, day).alias("published"), day.alias("fetched"), link.alias("comments"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("author "), F.col("page_id") % 7)).alias("author"), (F.col("page_id") % 4 > 1).alias("direct"),
    )


ENTRIES = f"""c AS ({CANONICAL}), t AS ({ORACLE["X6_plain_text"]}),
k AS (SELECT page_id, lower(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key, TIMESTAMP '2024-01-01' + to_days((page_id * 11 % 23)::INT) AS day FROM pages),
entries AS (SELECT page_id AS entry_id, canonical AS url, CASE WHEN octet_length(encode(key)) >= 12 THEN key END AS title_key, {WORDS.replace("text", "plain")} AS words,
 CASE WHEN page_id % 5 <> 0 THEN day END AS published, day AS fetched, CASE page_id % 4 WHEN 0 THEN 'https://news.ycombinator.com/item?id=' || page_id WHEN 1 THEN 'https://lobste.rs/s/' || page_id WHEN 2 THEN ' ' END AS comments,
 CASE WHEN page_id % 3 <> 0 THEN 'author ' || (page_id % 7) END AS author, page_id % 4 > 1 AS direct FROM c JOIN t USING (page_id) JOIN k USING (page_id)),
f AS (SELECT *, min(entry_id) OVER (PARTITION BY url) AS one, CASE WHEN title_key IS NOT NULL THEN min(entry_id) OVER (PARTITION BY title_key) END AS two FROM entries),
up AS (SELECT entry_id, CASE WHEN one < entry_id THEN one WHEN two < entry_id THEN two ELSE entry_id END AS up FROM f),
walk AS (SELECT entry_id, up FROM up UNION ALL SELECT w.entry_id, u.up FROM walk w JOIN up u ON u.entry_id = w.up WHERE u.up <> w.up),
resolved AS (SELECT entry_id, min(up) AS cluster FROM walk GROUP BY 1)"""


@query("J13_entity_resolution", f"WITH RECURSIVE {ENTRIES} SELECT entry_id, cluster FROM resolved")
def j13(spark, sf):
    return resolve(entries(spark, sf), "entry_id", "url", "title_key").select("entry_id", "cluster")


@query("K7_cluster_merge", f"""WITH RECURSIVE {ENTRIES}, m AS (SELECT *, trim(coalesce(comments, '')) <> '' AS linked, trim(coalesce(author, '')) <> '' AS named,
 CASE WHEN contains(comments, 'news.ycombinator.com') THEN 2 WHEN contains(comments, 'lobste.rs') THEN 1 ELSE 0 END AS kind, bool_or(direct) OVER (PARTITION BY cluster) AS any_direct FROM entries JOIN resolved USING (entry_id))
SELECT cluster, arg_max(entry_id, (words, -entry_id)) AS best_entry, arg_max(url, (words, -entry_id)) AS url, max(words)::INT AS words, min(coalesce(published, fetched)) AS first_seen, min(published) AS published, array_to_string(list_sort(list(entry_id)), ',') AS sources,
 arg_max(comments, (kind, entry_id)) FILTER (linked) AS comments, arg_min(author, entry_id) FILTER (named AND (direct OR NOT any_direct)) AS author FROM m GROUP BY 1""")  # fmt: skip
def k7(spark, sf):
    return merge(resolve(entries(spark, sf), "entry_id", "url", "title_key")).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))
