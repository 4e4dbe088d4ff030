"""Scans, filters, joins, sorts, set operations and keyed writes of the dashboards and the ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import host, paywalled, plain_text, under_domain, word_count
from gleanery.operators.ranking import latest, numbered_within, top_k, upsert, upsert_keeping
from gleanery.sources.views import articles, candidates, runs, table, verdicts, with_views

from .catalog import query
from .reports import latest_verdicts


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """The rows whose columns have the wanted values; a None switches its filter off."""
    tests: list[Column] = [F.col(c) == v for c, v in wanted.items() if v is not None]
    for test in tests:
        df = df.filter(test)
    return df


@query("S1_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")
def s1(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey = 42").select("o_orderkey", "o_custkey")


@query("S2_range_scan", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def s2(spark, sf):
    between = F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return table(spark, sf, "events").filter(between).orderBy(F.desc("ts")).select("event_id", "user_id")


@query("S4_normalised_rows", with_views("articles", "SELECT article_id, coalesce(nullif(trim(title), ''), feed, 'untitled') AS title, coalesce(nullif(trim(category), ''), 'none') AS category FROM articles"))
def s4(spark, sf):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return articles(spark, sf).select("article_id", F.coalesce(blank(F.col("title")), "feed", F.lit("untitled")).alias("title"), F.coalesce(blank(F.col("category")), F.lit("none")).alias("category"))


@query("S9_full_scan", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem")
def s9(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("S10_multi_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT user_id FROM events)")
def s10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(table(spark, sf, "events").select(F.col("user_id").alias("o_orderkey")), "o_orderkey", "left_semi")


HALVES = """WITH old AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1),
new AS (SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) <> 'view' THEN arg_max(event_type, (ts, event_id)) END AS kind, max(value) AS value FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1)
"""


def halves(spark, sf):
    """A stored table and a later batch for it."""
    e = table(spark, sf, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    old = e.filter("event_id % 2 = 0").groupBy("user_id").agg(last.alias("kind"), F.max("value").alias("value"))
    new = e.filter("event_id % 2 = 1 AND user_id % 3 <> 0").groupBy("user_id").agg(F.when(last != "view", last).alias("kind"), F.max("value").alias("value"))
    return old, new


@query("S11_upsert", HALVES + "SELECT user_id, kind, value FROM new UNION ALL SELECT user_id, kind, value FROM old WHERE user_id NOT IN (SELECT user_id FROM new)")
def s11(spark, sf):
    return upsert(*halves(spark, sf), "user_id")


@query("S12_upsert_keeping", HALVES + "SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON o.user_id = n.user_id")
def s12(spark, sf):
    return upsert_keeping(*halves(spark, sf), "user_id", ["kind", "value"])


@query("S13_insert_if_absent", HALVES + "SELECT user_id, kind, value FROM old UNION ALL SELECT user_id, kind, value FROM new WHERE user_id NOT IN (SELECT user_id FROM old)")
def s13(spark, sf):
    old, new = halves(spark, sf)
    return old.unionByName(new.join(old.select("user_id"), "user_id", "left_anti"))


@query("S16_conditional_update", with_views("runs", "SELECT run_id, CASE WHEN status = 'P' AND day < DATE '1998-01-01' THEN 'expired' ELSE status END AS status FROM runs"))
def s16(spark, sf):
    late = (F.col("status") == "P") & (F.col("day") < F.lit("1998-01-01").cast("date"))
    return runs(spark, sf).select("run_id", F.when(late, "expired").otherwise(F.col("status")).alias("status"))


@query("F1_optional_filters", with_views("candidates", "SELECT run_id, article_id FROM candidates WHERE stage = 'N' AND reason = 'F'"))
def f1(spark, sf):
    return matching(candidates(spark, sf), stage="N", reason="F", run_id=None).select("run_id", "article_id")


@query("F3_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the mit')")
def f3(spark, sf):
    return table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("the mit"))).select("doc_id")


@query("F4_equal_ignoring_case", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def f4(spark, sf):
    return table(spark, sf, "customer").filter(F.lower("c_mktsegment") == "building").select("c_custkey")


@query("F5_events_of_a_day", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def f5(spark, sf):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-15", "2024-01-16"))  # a range reaches the scan, a cast of the column doesn't
    return table(spark, sf, "events").filter((F.col("ts") >= start) & (F.col("ts") < end)).select("event_id")


@query("F6_json_path", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def f6(spark, sf):
    return table(spark, sf, "events").filter(F.get_json_object("props", "$.k").cast("long") == 7).select("event_id")


@query("F9_blocked_hosts", "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, host FROM h WHERE host = 'example.org' OR host LIKE '%.example.org' OR host LIKE '%.tiontion.example.com' OR host = 'tiontion.example.com'")
def f9(spark, sf):
    named = table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"))
    return named.filter(under_domain(F.col("host"), ["example.org", "tiontion.example.com"]))


@query("F14_paywalled", "WITH w AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS n FROM documents) SELECT doc_id, CASE WHEN n < 120 THEN true WHEN n >= 400 THEN false ELSE source IN ('src1', 'src2') END AS paywalled FROM w")
def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paywalled(word_count(F.col("text")), F.col("source").isin("src1", "src2")).alias("paywalled"))


@query("F16_plausible_url", "SELECT page_id, (url <> '' AND octet_length(encode(url)) <= 2048 AND NOT regexp_matches(url, '^(data|about):|[\\s<>\"''{}]|%20')) AS ok FROM pages")
def f16(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", ((url != "") & (F.octet_length(url) <= 2048) & ~url.rlike(r"^(data|about):|[\s<>\"'{}]|%20")).alias("ok"))


@query("J1_inner", with_views("candidates runs", "SELECT run_id, article_id, provider FROM candidates JOIN runs USING (run_id) WHERE status = 'F'"))
def j1(spark, sf):
    return candidates(spark, sf).join(runs(spark, sf).filter("status = 'F'").select("run_id", "provider"), "run_id").select("run_id", "article_id", "provider")


@query("J2_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def j2(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J3_pivot_by_stage", with_views("candidates", "SELECT article_id, max(utility) FILTER (stage = 'A') AS triage, max(utility) FILTER (stage = 'R') AS deep FROM candidates GROUP BY 1"))
def j3(spark, sf):
    mine = lambda s: F.max(F.when(F.col("stage") == s, F.col("utility")))
    return candidates(spark, sf).groupBy("article_id").agg(mine("A").alias("triage"), mine("R").alias("deep"))


@query("J4_left_to_latest", with_views("candidates", "SELECT p_partkey, c.run_id, c.stage FROM part LEFT JOIN (SELECT article_id, max(run_id) AS run_id, arg_max(stage, run_id) AS stage FROM candidates GROUP BY 1) c ON p_partkey = article_id"))
def j4(spark, sf):
    newest = latest(candidates(spark, sf), "article_id", [F.col("run_id")])
    return table(spark, sf, "part").select("p_partkey").join(newest, F.col("p_partkey") == F.col("article_id"), "left").select("p_partkey", "run_id", "stage")


@query("J5_equi_and_range", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND (o_orderstatus = 'P' OR l_shipdate > o_orderdate)")
def j5(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & ((F.col("o_orderstatus") == "P") | (F.col("l_shipdate") > F.col("o_orderdate")))).select("o_orderkey", "l_linenumber")


@query("J6_semi_top_runs", with_views("runs candidates", "SELECT run_id, article_id FROM candidates WHERE run_id IN (SELECT run_id FROM runs ORDER BY day DESC, run_id DESC LIMIT 3)"))
def j6(spark, sf):
    newest = runs(spark, sf).orderBy(F.desc("day"), F.desc("run_id")).limit(3).select("run_id")
    return candidates(spark, sf).join(newest, "run_id", "left_semi").select("run_id", "article_id")


@query("J7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error' AND value > 100)")
def j7(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    c = c.join(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.join(table(spark, sf, "events").filter("event_type = 'error' AND value > 100").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("J8_superseded", with_views("verdicts", "SELECT id FROM verdicts v WHERE EXISTS (SELECT 1 FROM verdicts w WHERE w.article_id = v.article_id AND (w.event_at > v.event_at OR w.event_at = v.event_at AND w.id > v.id))"))
def j8(spark, sf):
    newest = Window.partitionBy("article_id").orderBy(F.desc("event_at"), F.desc("id"))
    return verdicts(spark, sf).withColumn("rn", F.row_number().over(newest)).filter("rn > 1").select("id")


@query("J9_dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j9(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")  # 25 and 5 rows
    return table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("J14_two_key_reconcile", "SELECT s_suppkey, coalesce(a.c_custkey, b.k) AS c_custkey FROM supplier LEFT JOIN customer a ON a.c_custkey = s_suppkey AND a.c_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) b ON b.c_nationkey = s_nationkey")
def j14(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    exact = c.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("one"))
    owner = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("two"))
    return s.join(exact, ["s_suppkey", "s_nationkey"], "left").join(owner, "s_nationkey", "left").select("s_suppkey", F.coalesce("one", "two").alias("c_custkey"))


@query("J16_previous_and_next", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def j16(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("J17_counts_with_zeros", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j17(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("O3_nulls_last", with_views("candidates", "SELECT article_id, row_number() OVER (PARTITION BY stage ORDER BY nullif(run_id % 5, 0) ASC NULLS LAST, run_id, article_id)::INT AS place, run_id FROM candidates"))
def o3(spark, sf):
    order = [F.nullif(F.col("run_id") % 5, F.lit(0)).asc_nulls_last(), F.asc("run_id"), F.asc("article_id")]
    return numbered_within(candidates(spark, sf).select("stage", "article_id", "run_id"), ["stage"], order, "place").select("article_id", F.col("place").cast("int").alias("place"), "run_id")


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page of rows (numbers below 1 are 1)."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


@query("O4_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def o4(spark, sf):
    return page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3, 50, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("O6_newest_finished", with_views("runs", "SELECT run_id, provider FROM runs WHERE status = 'F' ORDER BY day DESC, run_id DESC LIMIT 1"))
def o6(spark, sf):
    return runs(spark, sf).filter("status = 'F'").orderBy(F.desc("day"), F.desc("run_id")).limit(1).select("run_id", "provider")


@query("O12_archive_by_month", with_views("runs", "SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, list(run_id ORDER BY run_id) AS runs FROM runs WHERE status = 'P' GROUP BY 1"))
def o12(spark, sf):
    return runs(spark, sf).filter("status = 'P'").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("run_id")).alias("runs"))


@query("U2_ordered_union", "WITH u AS (SELECT 0 AS src, s_suppkey AS pos, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, upper(replace(c_name, 'Customer', 'Supplier')) FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY src, pos) AS k FROM u) SELECT name, src, pos FROM r WHERE k = 1")
def u2(spark, sf):
    one = table(spark, sf, "supplier").select(F.lit(0).alias("src"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    two = table(spark, sf, "customer").select(F.lit(1).alias("src"), F.col("c_custkey").alias("pos"), F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name"))
    return one.union(two).groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("src", "pos", "name")).alias("r")).select("r.name", "r.src", "r.pos")


@query("U3_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def u3(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber")
    return li.filter("l_returnflag = 'A'").join(li.filter("l_returnflag = 'R' AND l_linenumber = 1"), "l_partkey", "left_anti").select("l_partkey").distinct()


@query("U4_intersection_with_provenance", "SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS admitted_by FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def u4(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("admitted_by")).filter(F.size("admitted_by") > 1)


@query("K29_budget_rows", with_views("runs", "SELECT p.provider, coalesce(s.spent, 0) AS spent, coalesce(s.spent, 0) > 500000 AS over FROM (SELECT DISTINCT provider FROM runs) p LEFT JOIN (SELECT provider, round(sum(cost), 2) AS spent FROM runs WHERE day = DATE '1998-10-03' GROUP BY 1) s USING (provider)"))
def k29(spark, sf):
    r = runs(spark, sf)
    spent = r.filter(F.col("day") == F.lit("1998-10-03").cast("date")).groupBy("provider").agg(F.round(F.sum("cost"), 2).alias("spent"))
    got = F.coalesce("spent", F.lit(0.0))
    return r.select("provider").distinct().join(spent, "provider", "left").select("provider", got.alias("spent"), (got > 500000).alias("over"))


@query("K30_unrated_picks", with_views("verdicts runs candidates", "SELECT DISTINCT article_id FROM candidates WHERE run_id IN (SELECT run_id FROM runs ORDER BY day DESC, run_id DESC LIMIT 200) AND article_id NOT IN (SELECT article_id FROM verdicts WHERE explicit)"))
def k30(spark, sf):
    newest = runs(spark, sf).orderBy(F.desc("day"), F.desc("run_id")).limit(200).select("run_id")
    picks = candidates(spark, sf).join(newest, "run_id", "left_semi").select("article_id").distinct()
    return picks.join(verdicts(spark, sf).filter("explicit").select("article_id"), "article_id", "left_anti")


@query("K31_last_job_of_a_kind", "SELECT k.event_type, arg_max(event_id, (ts, event_id)) AS last_job FROM (SELECT DISTINCT event_type FROM events) k LEFT JOIN events e ON e.event_type = k.event_type AND e.user_id % 2 = 1 GROUP BY 1")
def k31(spark, sf):
    e = table(spark, sf, "events")
    newest = e.filter("user_id % 2 = 1").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_job"))
    return e.select("event_type").distinct().join(newest, "event_type", "left")


#: Canonical addresses of the given pages, which have no redirectors and no parameters that need another encoding.
CANONICAL = """WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^(https?://[^/?#]+)', 1)) AS head, regexp_replace(u, '^https?://[^/?#]+', '') AS rest FROM u),
q AS (SELECT page_id, head, rtrim(split_part(rest, '?', 1), '/') AS path, list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|s|si|mc_cid|mc_eid)(=|$)')) AS kept FROM p)
SELECT page_id, head || CASE WHEN path = '' AND len(kept) > 0 THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM q"""
O12_DAYS = "CAST(o_orderdate AS DATE)"


@query("X4_hosts", "SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def x4(spark, sf):
    return table(spark, sf, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("X6_plain_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&rsquo;', ''''), '&mdash;', '—'), '\s+', ' ', 'g')) AS plain FROM pages""")  # fmt: skip
def x6(spark, sf):
    return table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("plain"))
