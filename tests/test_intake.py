"""Chosen bodies, imported ratings, the discovery pass and costs of calls on hand-made tables."""

import datetime

import duckdb
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.operators import intake, ranking


def rows(df, *by):
    return sorted((tuple(r) for r in df.select(*by).collect()), key=repr)


def test_bodies_are_chosen_by_their_words_and_noted_once(spark):
    full, part, note = "w " * 250, "one two", f"<p>{intake.EXCERPT_NOTE}</p>"
    cases = [(0, full, full * 2), (1, part, "a b c"), (2, part, "a b"), (3, part, None), (4, None, None), (5, "  ", ""), (6, part + note, None), (7, "w " * 249, "w " * 400), (8, "w " * 200, None)]
    df = spark.createDataFrame(cases, "i int, feed string, page string")
    words = [F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")) for c in ("feed", "page")]
    got = {r["i"]: r["c"] for r in df.select("i", intake.chosen_body(F.col("feed"), words[0], F.col("page"), words[1], F.lit(False)).alias("c")).collect()}
    assert [got[i]["method"] for i in range(9)] == ["feed", "page", "excerpt", "excerpt", "excerpt", "excerpt", "excerpt", "page", "excerpt"]
    assert [got[i]["body"] for i in (0, 1, 2, 4, 5, 6)] == [full, "a b c", part + note, note, note, part + note]
    assert [got[i]["words"] for i in (0, 1, 2, 4, 5, 7, 8)] == [250, 3, 6, 4, 4, 400, 204]
    assert [got[i]["excerpt_only"] for i in range(9)] == [False, True, True, True, True, True, True, False, True]


def test_bodies_of_awkward_pages_are_those_of_the_sql(spark, tmp_path):
    """References without an end or by numbers, markup in capitals, with attributes or never closed, vertical tabs, blanks of other kinds, new letters."""
    texts = ["one two", "one two", "one\vtwo", "one two", "one two", "one two", "one two", "one two", "\u00a0\u3000", " \n", "\v", None, "one\vtwo \v three", "one", "\u0870 \U00031350"]
    pages = [
        "<title>token = &quot</title><p>a b", "<p>a&nbsp;b&nbspc &mdash; &#8212; &Eacute; &copy;d", "<p>a\vb c", "<STYLE>p q</STYLE>r", "<style media='x'>p q r</style>", "<script>a</script ><b>c</b></script> d e f",
        "a <!-- b --> c < d > e <f", "<noscript>a b</noscript> <template>c</template>", None, "", "<p>\u00a0</p>", "<p>a</p>", "<a\nb>c<style>\nd</style>\x1fe</p>f&amp;g &Amp; h", "x > y\n<!-- never", "<p>a",
    ]
    tables = {
        "documents": spark.createDataFrame([(i, t, "src1" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string"),
        "pages": spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {r["doc_id"]: r for r in registry.queries()["K8_content_choice"](spark, str(tmp_path)).collect()}
    want = con.sql(f"SELECT doc_id, method, words, body, excerpt_only, same_again FROM ({registry.oracle_sql()['K8_content_choice']})").fetchall()
    assert {i: tuple(r[c] for c in ("doc_id", "method", "words", "body", "excerpt_only", "same_again")) for i, r in got.items()} == {w[0]: w for w in want}
    assert (got[0]["method"], got[0]["words"]) == ("page", 4) and [got[i]["words"] for i in (2, 8, 14)] == [2, 4, 6]


QUEUE = "request long, url string, label string, note string"


def test_ratings_are_imported_in_the_order_of_their_requests(spark):
    queue = [
        (5, "https://a.example/x/?utm_source=q#f", "loved", "n"), (2, "https://A.example/x", "nonsense", None), (3, "https://b.example/new", "nonsense", None), (4, "https://b.example/new#again", "good", None),
        (6, "https://b.example/new", "slop", None), (1, "https://c.example/z", "good", None), (7, "ftp://a.example/x", "good", None), (8, None, "good", None), (9, "https://gone.example/", "good", None), (10, "https://a.example/x", None, None),
    ]
    stored = [(7, "https://a.example/x"), (4, "http://other.example"), (9, "https://a.example/x/"), (12, None)]
    pages = [("https://b.example/new",), ("https://c.example/z/",), ("https://c.example/z",), (None,)]
    done = intake.import_ratings(
        spark.createDataFrame(queue, QUEUE), spark.createDataFrame(stored, "article_id long, url string"), spark.createDataFrame(pages, "url string"), spark.createDataFrame([(7,), (13,), (13,), (None,)], "article_id long"), ["loved", "good", "slop"]
    )
    assert rows(done.articles, "article_id", "url") == [(13, "https://c.example/z"), (14, "https://b.example/new")]
    got = {r["request"]: (r["status"], r["message"], r["article_id"], r["created"]) for r in done.requests.collect()}
    assert got == {
        1: ("ok", "created + embedded", 13, True), 2: ("failed", "unknown label", None, False), 3: ("failed", "unknown label", None, False), 4: ("ok", "existing article; no embedding", 14, False),
        5: ("ok", "existing article + embedded", 7, False), 6: ("ok", "existing article; no embedding", 14, False), 7: ("failed", "invalid URL", None, False), 8: ("failed", "invalid URL", None, False),
        9: ("failed", "no page", None, False), 10: ("failed", "unknown label", None, False),
    }
    assert rows(done.events, "request", "article_id", "label", "note") == [(1, 13, "good", None), (4, 14, "good", None), (5, 7, "loved", "n"), (6, 14, "slop", None)]


def test_an_empty_queue_and_an_empty_store(spark):
    none = spark.createDataFrame([], QUEUE)
    ids, pages = spark.createDataFrame([], "article_id long, url string"), spark.createDataFrame([("https://a.example",)], "url string")
    assert intake.import_ratings(none, ids, pages, ids, ["good"]).requests.count() == 0
    one = intake.import_ratings(spark.createDataFrame([(1, "https://a.example/", "good", None)], QUEUE), ids, pages, ids, ["good"])
    assert rows(one.requests, "article_id", "created") == [(1, True)]


def test_feeds_of_a_host_are_few_and_not_json_if_that_can_be(spark):
    found = [
        ("a", 1, "a1", "T", "json", False), ("a", 2, "a2", "T", "XML", False), ("a", 3, "a3", "T", "xml", False), ("a", 4, "a4", "U", "JSON", False), ("a", 0, "a0", "g", "xml", True), ("a", 5, "a5", "g", "xml", True),
        ("b", 1, "b1", "1", None, False), ("b", 2, "b2", "2", "xml", False), ("b", 3, "b3", None, "xml", False), ("b", 4, "b4", None, "xml", False), ("b", 5, "b5", "x", "xml", True), ("c", 1, "c1", "", "xml", True),
    ]
    got = rows(intake.kept_feeds(spark.createDataFrame(found, "host string, place int, feed_url string, title string, kind string, guess boolean")), "host", "feed_url")
    assert got == [("a", "a0"), ("a", "a2"), ("a", "a4"), ("b", "b1"), ("b", "b2"), ("b", "b3"), ("c", "c1")]


def test_a_pass_links_known_hosts_and_queues_the_best_others(spark):
    now = datetime.datetime(2024, 2, 1)
    day = lambda n: now - datetime.timedelta(days=n)
    arts = [
        (1, "https://old.example/a", 1.0, True), (2, "https://www.old.example/b", None, True), (3, "https://x.example/1", 5.0, True), (4, "https://x.example/2", 5.0, True), (5, "https://y.example/", 9.0, True), (6, "https://z.example/", 5.0, True),
        (7, "https://sub.example/", 99.0, True), (8, "https://deep.skip.example/", 99.0, True), (9, "https://direct.example/", 99.0, False), (10, "mailto:x", 99.0, True), (11, None, 1.0, True), (12, "https://stale.example/", 7.0, True), (13, "https://q.example/", 99.0, None),
    ]
    found = spark.createDataFrame([(h, 1, f"https://{h}/feed", "T", "xml", False) for h in ("x.example", "y.example", "z.example", "old.example", "stale.example")], "host string, place int, feed_url string, title string, kind string, guess boolean")
    did = intake.discovery_pass(
        spark.createDataFrame(arts, "article_id long, url string, score double, aggregator_only boolean"), spark.createDataFrame([("sub.example",), ("sub.example",)], "host string"),
        spark.createDataFrame([("old.example", day(90)), ("stale.example", day(91)), ("none.example", None)], "host string, checked_at timestamp_ntz"), spark.createDataFrame([("old.example", "f1"), ("old.example", "f2"), ("old.example", "f2"), ("stale.example", "f3")], "host string, feed_url string"),
        found, F.lit(now).cast("timestamp_ntz"), ["skip.example"], 3,
    )
    assert rows(did.queue, "host", "url", "score", "articles") == [("stale.example", "https://stale.example/", 7.0, 1), ("x.example", "https://x.example/1", 5.0, 2), ("y.example", "https://y.example/", 9.0, 1)]
    assert rows(did.links, "article_id", "feed_url", "reused") == [
        (1, "f1", True), (1, "f2", True), (12, "https://stale.example/feed", False), (2, "f1", True), (2, "f2", True), (3, "https://x.example/feed", False), (4, "https://x.example/feed", False), (5, "https://y.example/feed", False),
    ]


def test_costs_add_four_counters_and_end_in_a_total(spark):
    calls = [("p", 1_000_000, 2_000_000, 0, 500_000), ("p", None, 0, 1_000_000, 0), ("free", 7, 0, 0, 0), (None, 1, 1, 1, 1)]
    schema = "provider string, input long, cache_read long, cache_write long, output long"
    prices = spark.createDataFrame([("p", 3.0, 0.5, 4.0, 10.0), ("unused", 1.0, 1.0, 1.0, 1.0)], "provider string, input double, cache_read double, cache_write double, output double")
    got = rows(intake.usage_costs(spark.createDataFrame(calls, schema), prices), "provider", "total", "calls", *intake.COUNTERS, "cost")
    assert got == [("free", False, 1, 7, 0, 0, 0, 0.0), ("p", False, 2, 1_000_000, 2_000_000, 1_000_000, 500_000, 13.0), (None, False, 1, 1, 1, 1, 1, 0.0), (None, True, 4, 1_000_008, 2_000_001, 1_000_001, 500_001, 13.0)]
    assert intake.usage_costs(spark.createDataFrame([], schema), prices).count() == 0


def test_rows_are_numbered_in_groups_that_span_partitions(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, (F.col("id") % 3).cast("string")).alias("g"), F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    got = ranking.numbered_within(df, ["g"], [F.desc("v"), F.asc("id")], "n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append(r)
    assert len(got) == 4000 and len(groups) == 5 and len(groups[None]) == 400
    for rows_ in groups.values():
        assert [r["n"] for r in sorted(rows_, key=lambda r: (-r["v"], r["id"]))] == list(range(1, len(rows_) + 1))
    assert [r["n"] for r in ranking.numbered(df, "id").orderBy("id").collect()] == list(range(1, 4001))
    assert ranking.numbered_within(df.limit(0), ["g"], [F.asc("id")]).count() == 0
