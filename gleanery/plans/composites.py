"""Caches, backfills, discovery, trees, settings and pages made of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import host
from gleanery.operators.ranking import latest, numbered, top_k
from gleanery.operators.trees import changes, dotted, leaves, until_budget, within_budget
from gleanery.sources.sinks import feed, replaced
from gleanery.sources.views import candidates, runs, table, with_views

from .catalog import query
from .reports import latest_verdicts
from .signals import KNN, PAIRS, interest_scores, neighbours


@query("S3_ingest_window", "SELECT event_id, coalesce(c_name, 'feed ' || user_id) AS feed FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 WHERE ts BETWEEN TIMESTAMP '2024-01-20 10:00:00' AND TIMESTAMP '2024-01-21 12:00:00'")
def s3(spark, sf):
    since, until = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-20 10:00:00", "2024-01-21 12:00:00"))
    names = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows = table(spark, sf, "events").filter(F.col("ts").between(since, until))
    return rows.join(names, "user_id", "left").select("event_id", F.coalesce("c_name", F.concat(F.lit("feed "), "user_id")).alias("feed"))


@query("S5_discussion_payloads", "SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'hits' ELSE 'children' END AS source, page_id AS item, page_id % 50 AS score, page_id % 7 AS comments FROM pages WHERE page_id % 9 <> 0")
def s5(spark, sf):
    i = F.col("page_id")
    body = F.when(i % 9 == 0, "not json").when(i % 2 == 0, F.format_string('{"hits":[{"objectID":"%d","points":%d,"num_comments":%d}]}', i, i % 50, i % 7)).otherwise(F.format_string('{"data":{"children":[{"data":{"id":"%d","score":%d,"num_comments":%d}}]}}', i, i % 50, i % 7))
    return discussion_refs(table(spark, sf, "pages").select("page_id", body.alias("body")), "page_id", "body")


def discussion_refs(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, source, item, score, comments from search replies of two shapes; other texts give no row."""
    schema = "hits array<struct<objectID:string,points:long,num_comments:long>>, data struct<children:array<struct<data:struct<id:string,score:long,num_comments:long>>>>"
    read = df.select(key, F.from_json(body, schema).alias("r"))
    one = F.transform(F.coalesce("r.hits", F.array()), lambda h: F.struct(F.lit("hits").alias("source"), h["objectID"].alias("item"), h["points"].alias("score"), h["num_comments"].alias("comments")))
    two = F.transform(F.coalesce("r.data.children", F.array()), lambda c: F.struct(F.lit("children").alias("source"), c["data"]["id"].alias("item"), c["data"]["score"].alias("score"), c["data"]["num_comments"].alias("comments")))
    return read.select(key, F.inline(F.concat(one, two))).withColumn("item", F.col("item").try_cast("long"))


@query("S7_outline_names", "WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS n FROM pages), u AS (SELECT page_id, unnest(n) AS name, generate_subscripts(n, 1) AS place FROM t), c AS (SELECT page_id, place, trim(replace(name, '&amp;', '&')) AS name FROM u) SELECT arg_min(name, (page_id, place)) AS name, min(page_id) AS page_id FROM c WHERE name <> '' GROUP BY lower(name)")
def s7(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)).alias("place", "name"))
    names = names.withColumn("name", F.trim(F.replace("name", F.lit("&amp;"), F.lit("&")))).filter("name <> ''")
    return names.groupBy(F.lower("name").alias("k")).agg(F.min_by("name", F.struct("page_id", "place")).alias("name"), F.min("page_id").alias("page_id")).drop("k")


@query("S8_section_bullets", "SELECT doc_id, n::INT AS place, CASE n WHEN 1 THEN left(text, 5) ELSE source END AS item FROM documents, (VALUES (1), (2)) v(n) WHERE text IS NOT NULL AND source IS NOT NULL AND regexp_matches(left(text, 5), '^[\\p{L}]{5}$')")
def s8(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("source").isNotNull() & F.left("text", F.lit(5)).rlike(r"^\p{L}{5}$"))
    note = F.concat(F.lit("# Other\n- no\n## Interests\n\n- "), F.left("text", F.lit(5)), F.lit("\nprose\n* "), "source", F.lit("\n# Later\n- no"))
    return section_items(d.select("doc_id", note.alias("note")), "doc_id", "note", "interests")


def section_items(df: DataFrame, key: str, note: str, heading: str) -> DataFrame:
    """key, place from 1, item: the bullet lines below a heading up to the next one, each note for itself."""
    body = F.regexp_extract(note, rf"(?ims)^#+\s*{heading}\s*$(.*?)(?=^#|\z)", 1)
    items = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+\S")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", "")))
    return df.select(key, F.posexplode(items).alias("place", "item")).withColumn("place", F.col("place") + 1)


@query("S14_replaced_days", "WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS cost FROM orders), n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE), 0.0 FROM orders WHERE o_orderkey % 101 = 1) SELECT k, CAST(day AS VARCHAR) AS day, cost::DOUBLE AS cost FROM (FROM o WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 101 = 1) UNION ALL FROM n)")
def s14(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_totalprice").cast("double").alias("cost"))
    return replaced(o, o.filter("k % 101 = 1").withColumn("cost", F.lit(0.0)), "day")


@query("S18_json_feed", "SELECT to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS item FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 20)")
def s18(spark, sf):
    return feed(table(spark, sf, "events").select("event_id", "event_type", "ts"), [F.desc("ts"), F.asc("event_id")], 20, ["event_id", "event_type"])


@query("A12_exploration_yield", "SELECT count(*) AS admitted, count(*) FILTER (l_returnflag = 'R') AS selected, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS positive FROM lineitem WHERE l_linenumber = 2")
def a12(spark, sf):
    r = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").filter("l_linenumber = 2").agg(F.count("*").alias("admitted"), F.count_if(r).alias("selected"), F.count_if(r & (F.col("l_quantity") > 25)).alias("positive"))


@query("A17_weighted_neighbours", KNN + ", v AS (SELECT k.*, 1.0 / (1 + right_id % 3) AS w FROM k WHERE rank <= 5) SELECT left_id, round(sum(w * score) / sum(w), 6) AS mean FROM v GROUP BY 1")
def a17(spark, sf):
    w = F.lit(1.0) / (1 + F.col("right_id") % 3)
    return neighbours(spark, sf).groupBy("left_id").agg(F.round(F.sum(w * F.col("score")) / F.sum(w), 6).alias("mean"))


@query("A18_mean_of_rates", "WITH r AS (SELECT l_suppkey, avg((l_returnflag = 'R')::INT) AS r FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1) SELECT l_orderkey, round(avg(r), 9) AS rate FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN r USING (l_suppkey) GROUP BY 1")
def a18(spark, sf):
    li = table(spark, sf, "lineitem")
    rates = li.filter("l_suppkey % 4 <> 0").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r"))
    return li.select("l_orderkey", "l_suppkey").distinct().join(rates, "l_suppkey", "left").groupBy("l_orderkey").agg(F.round(F.avg("r"), 9).alias("rate"))


@query("A30_stage_counters", "SELECT l_linenumber, count(*) AS requested, count(*) FILTER (l_returnflag = 'A') AS reused, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS recovered FROM lineitem GROUP BY 1")
def a30(spark, sf):
    flag = lambda f: F.col("l_returnflag") == f
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("requested"), F.count_if(flag("A")).alias("reused"), F.count_if(flag("R")).alias("rejected"), F.count_if(flag("R") & (F.col("l_linestatus") == "F")).alias("recovered"))


@query("W4_verdicts_of_an_issue", with_views("verdicts latest candidates", ", i AS (SELECT DISTINCT article_id FROM candidates WHERE run_id < 200) SELECT article_id, label FROM latest JOIN i USING (article_id)"))
def w4(spark, sf):
    issue = candidates(spark, sf).filter("run_id < 200").select("article_id").distinct()
    return latest_verdicts(spark, sf).join(issue, "article_id", "left_semi").select("article_id", "label")


@query("W12_running_budgets", """WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem),
w AS (SELECT l_orderkey, 0::BIGINT AS k, 0.0::DOUBLE AS used, false AS kept, NULL::INT AS l_linenumber, NULL::BIGINT AS l_partkey, NULL::DOUBLE AS l_quantity FROM (SELECT DISTINCT l_orderkey FROM i) UNION ALL
 SELECT i.l_orderkey, i.k, CASE WHEN used + i.l_quantity <= 60 THEN used + i.l_quantity ELSE used END, used + i.l_quantity <= 60, i.l_linenumber, i.l_partkey, i.l_quantity::DOUBLE FROM w JOIN i ON i.l_orderkey = w.l_orderkey AND i.k = w.k + 1)
SELECT 'skip' AS form, l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS l_quantity FROM w WHERE kept UNION ALL
SELECT 'stop', l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY k) AS s FROM i) WHERE s <= 60""")  # fmt: skip
def w12(spark, sf):
    """For each order the line items that fit into 60 units, in the order of (number, part, quantity): with those that don't
    skipped, and with an end at the first that doesn't."""
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    by_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = lambda form, rule: by_order.select(F.lit(form).alias("form"), "l_orderkey", F.inline(rule(F.col("items"), "l_quantity", 60.0)))
    return kept("skip", within_budget).union(kept("stop", until_budget))


@query("O1_stable_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey)::INT AS place FROM orders")
def o1(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("O7_newest_in_order", with_views("runs", "SELECT run_id, row_number() OVER (ORDER BY day, run_id)::INT AS place FROM (SELECT * FROM runs ORDER BY day DESC, run_id DESC LIMIT 30)"))
def o7(spark, sf):
    newest = runs(spark, sf).orderBy(F.desc("day"), F.desc("run_id")).limit(30)
    return newest.select("run_id", F.row_number().over(Window.orderBy("day", "run_id")).alias("place"))  # 30 rows


@query("O10_lookup_queue", "WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT host, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, host LIMIT 12")
def o10(spark, sf):
    return table(spark, sf, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(12)


@query("V2_valid_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def v2(spark, sf):
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, sf, "embeddings").filter((F.size("embedding") == 64) & finite).select("vec_id")


@query("V6_token_prices", "SELECT o_orderpriority AS provider, round(sum(o_orderkey % 1000) * 0.25 / 1e6 + sum(o_custkey % 500) * 2.0 / 1e6, 9) AS cost FROM orders GROUP BY 1")
def v6(spark, sf):
    cost = F.sum(F.col("o_orderkey") % 1000) * 0.25 / 1e6 + F.sum(F.col("o_custkey") % 500) * 2.0 / 1e6
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("provider")).agg(F.round(cost, 9).alias("cost"))


ZS = f"WITH {PAIRS}, z AS (SELECT *, (score - avg(score) OVER (PARTITION BY right_id)) / greatest(stddev_pop(score) OVER (PARTITION BY right_id), 1e-3) AS z FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(z, 9) DESC, right_id) AS rank FROM z)"


def top_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interest_scores(spark, sf_dir)
    stats = s.groupBy("right_id").agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-3)).alias("std"))  # one row for each interest
    z = s.join(F.broadcast(stats), "right_id").withColumn("z", (F.col("score") - F.col("mean")) / F.col("std"))
    return top_k(z, "left_id", [F.desc(F.round("z", 9)), F.asc("right_id")], 3)


@query("V13_sparkline", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round((row_number() OVER (ORDER BY day) - 1) * 120.0 / greatest(count(*) OVER () - 1, 1), 3)::DOUBLE AS x, round(24 - 24.0 * n / max(n) OVER (), 3)::DOUBLE AS y FROM d")
def v13(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a row for each day
    x = (F.row_number().over(Window.orderBy("day")) - 1) * 120.0 / F.greatest(F.count("*").over(whole) - 1, F.lit(1))
    return d.select(F.col("day").cast("string"), F.round(x, 3).alias("x"), F.round(24 - 24.0 * F.col("n") / F.max("n").over(whole), 3).alias("y"))


CACHE = "a AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS input FROM documents), c AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'old' ELSE input END AS input FROM a WHERE id % 3 <> 0)"


def cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Inputs by hash, and what an earlier run has stored of them."""
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("input"))
    return wanted, wanted.filter("id % 3 <> 0").withColumn("input", F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("input")))


@query("K9_cache_misses", f"WITH {CACHE} SELECT a.id, a.input FROM a LEFT JOIN c USING (id, input) WHERE c.id IS NULL")
def k9(spark, sf):
    wanted, stored = cache(spark, sf)
    return wanted.join(stored, ["id", "input"], "left_anti")


@query("K10_backfill_plan", f"WITH {CACHE}, m AS (SELECT id FROM a WHERE (id, input) NOT IN (SELECT (id, input) FROM c)), r AS (SELECT DISTINCT user_id AS id FROM events), p AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT id, CASE WHEN id IN (FROM r) THEN 1 WHEN id IN (FROM p) THEN 2 ELSE 3 END AS turn, ceil(coalesce(octet_length(encode(text)), 0) / 4)::BIGINT AS tokens FROM m JOIN documents ON doc_id = id")
def k10(spark, sf):
    misses = k9(spark, sf).select("id")
    first = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("t"))
    second = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.lit(2).alias("t"))
    turns = first.union(second).groupBy("id").agg(F.min("t").alias("turn"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("tokens"))
    return misses.join(texts, "id").join(turns, "id", "left").select("id", F.coalesce("turn", F.lit(3)).alias("turn"), "tokens")


@query("K11_reused_assessments", "WITH a AS (SELECT user_id AS article_id, arg_max({'event_type': event_type, 'value': value}, (ts, event_id)) AS r FROM events WHERE event_type IN ('view', 'click') AND value > 0 AND ts > TIMESTAMP '2024-01-29' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 1 GROUP BY 1) SELECT doc_id, r.event_type AS model, r.value AS score FROM documents LEFT JOIN a ON article_id = doc_id")
def k11(spark, sf):
    usable = F.col("event_type").isin("view", "click") & (F.col("value") > 0) & (F.get_json_object("props", "$.k").cast("long") % 3 == 1) & (F.col("ts") > F.lit("2024-01-29").cast("timestamp_ntz"))
    newest = latest(table(spark, sf, "events").filter(usable), "user_id", [F.col("ts"), F.col("event_id")])
    stored = newest.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("model"), F.col("value").alias("score"))
    return table(spark, sf, "documents").select("doc_id").join(stored, "doc_id", "left")


@query("K22_profile_document", "SELECT p_brand, string_agg('- ' || p_name || ' (' || p_size || ')', chr(10) ORDER BY p_size DESC, p_name, p_partkey) AS document FROM part GROUP BY 1")
def k22(spark, sf):
    line = F.concat(F.lit("- "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("p_size")).alias("s"), "p_name", "p_partkey", line.alias("line"))))
    return table(spark, sf, "part").groupBy("p_brand").agg(rows.alias("r")).select("p_brand", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("document"))


@query("K24_summary_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'primary' WHEN doc_id % 3 = 1 AND source IS NOT NULL THEN 'bulk' ELSE array_to_string(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+')[1:45], ' ') END AS summary FROM documents")
def k24(spark, sf):
    primary = F.when(F.col("doc_id") % 3 == 0, "primary")
    bulk = F.when((F.col("doc_id") % 3 == 1) & F.col("source").isNotNull(), "bulk")
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), r"\s+")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(primary, bulk, F.array_join(F.slice(words, 1, 45), " ")).alias("summary"))


NODES = "n AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 END AS parent, role || turn AS label, CASE WHEN turn % 2 = 0 THEN ['l' || turn, 'all'] END AS links FROM conversations)"


@query("K25_tree_leaves", f"WITH RECURSIVE {NODES}, w AS (SELECT id, label AS labels, coalesce(links, []) AS links FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.labels || ' > ' || n.label, list_concat(w.links, coalesce(n.links, [])) FROM w JOIN n ON n.parent = w.id) SELECT id, labels, array_to_string(list_sort(list_distinct(links)), ',') AS links, ((row_number() OVER (ORDER BY id) - 1) // 6)::BIGINT AS batch FROM w WHERE id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)")
def k25(spark, sf):
    t = F.col("turn")
    nodes = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + t).alias("id"), F.when(t > 0, F.col("conv_id") * 100 + F.floor((t - 1) / 2)).alias("parent"), F.concat("role", t.cast("string")).alias("label"),
        F.when(t % 2 == 0, F.array(F.concat(F.lit("l"), t.cast("string")), F.lit("all"))).alias("links"),
    )
    found = leaves(nodes).select("id", F.array_join("labels", " > ").alias("labels"), F.array_join(F.array_sort("links"), ",").alias("links"))
    return numbered(found, "id").withColumn("batch", F.floor((F.col("n") - 1) / 6)).drop("n")


@query("K26_assigned_categories", "WITH a AS (SELECT lower(n_name) AS k, arg_min(left(r_name, 60), n_nationkey) AS c FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(r_name) BETWEEN 1 AND 60 GROUP BY 1) SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Kept' ELSE c END AS category FROM nation LEFT JOIN a ON lower(n_name) = k")
def k26(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    said = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).filter(F.length("r_name").between(1, 60)).groupBy(F.lower("n_name").alias("k")).agg(F.min_by("r_name", "n_nationkey").alias("c"))
    stored = F.when(F.col("n_nationkey") % 4 == 0, "Kept")
    return n.join(said, F.lower("n_name") == F.col("k"), "left").select("n_nationkey", F.coalesce(stored, "c").alias("category"))


@query("K32_refreshed_snapshot", "SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'stored' END AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def k32(spark, sf):
    li = table(spark, sf, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", F.lit("stored").alias("name"))
    stored = table(spark, sf, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.to_json(F.collect_list(item)).alias("snapshot"))
    old = stored.select("o_orderkey", F.inline(F.from_json("snapshot", "array<struct<l_linenumber:int,l_partkey:long,name:string>>")))
    live = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return old.join(live, "l_partkey", "left").select("o_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", "name").alias("name"))


@query("K34_interest_backfill", f"{ZS} SELECT left_id, right_id, round(z, 6) AS z FROM r WHERE rank <= 3 AND z >= 1 AND left_id % 4 <> 0")
def k34(spark, sf):
    found = top_interests(spark, sf).filter("z >= 1").select("left_id", "right_id", F.round("z", 6).alias("z"))
    stored = found.filter("left_id % 4 = 0").select("left_id", "right_id")
    return found.join(stored, ["left_id", "right_id"], "left_anti")


@query("F20_finished_runs", with_views("runs", "SELECT run_id FROM runs WHERE status <> 'P' AND day IS NOT NULL"))
def f20(spark, sf):
    return runs(spark, sf).filter((F.col("status") != "P") & F.col("day").isNotNull()).select("run_id")


@query("W5_source_of_the_latest_verdict", with_views("verdicts latest", "SELECT l.article_id, l.label, json_extract_string(e.props, '$.k') AS source FROM latest l JOIN events e ON e.event_id = l.id"))
def w5(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("source"))
    return latest_verdicts(spark, sf).join(e, "id").select("article_id", "label", "source")


@query("O5_optional_limit", with_views("runs", "SELECT run_id, 'all' AS page FROM runs UNION ALL SELECT run_id, 'ten' FROM (SELECT * FROM runs ORDER BY day DESC, run_id LIMIT 10)"))
def o5(spark, sf):
    newest = [F.desc("day"), F.asc("run_id")]
    return at_most(runs(spark, sf), newest, 0).select("run_id", F.lit("all").alias("page")).union(at_most(runs(spark, sf), newest, 10).select("run_id", F.lit("ten").alias("page")))


def at_most(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows; all of them, unordered, if ``n`` isn't positive."""
    return df.orderBy(*order).limit(n) if n > 0 else df


@query("O9_scored_page", "WITH s AS (SELECT l_suppkey AS feed, count(DISTINCT l_partkey) AS links, max(l_shipdate) AS seen, round(avg((l_returnflag = 'R')::INT), 9) AS score FROM lineitem GROUP BY 1) SELECT feed, links, score FROM s ORDER BY score DESC, links DESC, seen DESC, feed LIMIT 5 OFFSET 2")
def o9(spark, sf):
    score = F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 9)
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feed")).agg(F.count_distinct("l_partkey").alias("links"), F.max("l_shipdate").alias("seen"), score.alias("score"))
    return s.orderBy(F.desc("score"), F.desc("links"), F.desc("seen"), "feed").offset(2).limit(5).select("feed", "links", "score")


@query("S6_page_sections", "WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) AS items FROM pages) SELECT page_id, 0 AS place, 0 AS depth, title AS label FROM t UNION ALL SELECT page_id, generate_subscripts(items, 1)::INT, 1, unnest(items) FROM t")
def s6(spark, sf):
    items = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), 1)
    t = table(spark, sf, "pages").select("page_id", F.posexplode(F.concat(F.array(F.regexp_extract("html", "<title>(.*?)</title>", 1)), items)).alias("place", "label"))
    return t.select("page_id", "place", F.least("place", F.lit(1)).alias("depth"), "label")
