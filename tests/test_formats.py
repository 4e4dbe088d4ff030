"""Markup, cuts, display forms, stored vectors, replies, caches and categories on hand-made cases."""

import struct

import duckdb
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.functions import markup
from gleanery.plans import formats


def values(spark, cases, rule, kind="string"):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cases], f"x {kind}").select(rule(F.col("x")).alias("y")).collect()]


def test_entities_are_decoded_once_within_twelve_bytes(spark):
    cases = {
        "a &amp; b &lt;c&gt; &quot;&apos;&#39;": "a & b <c> \"''", "&amp;lt; &#038;#65;": "&lt; &#65;", "&nbsp;&#x1F600;&#8212;": " \U0001f600—", "&#xD800; &#1114112; &#x110000;": "&#xD800; &#1114112; &#x110000;",
        "&é; & &; &bogus; &#; &#x;": "&é; & &; &bogus; &#; &#x;", "&#0000000065; &#000000065;": "&#0000000065; A", "&&amp;": "&&", "": "", "no": "no",
    }
    assert values(spark, cases, markup.entities_decoded) == list(cases.values()) and values(spark, [None], markup.entities_decoded) == [None]
    assert values(spark, ["<a> & \"b\" 'c'"], lambda x: markup.escaped(x, quotes=True)) == ["&lt;a&gt; &amp; &quot;b&quot; 'c'"]
    assert values(spark, ["&amp;lt;p&amp;gt; &lt;b&gt;&#39;&#x200B;&nbsp;"], markup.unescaped) == ["&lt;p&gt; <b>' "]


def test_tags_and_their_attributes(spark):
    html = """<!-- <b x="1"> --><IMG alt='a > b' src="x.png?a=1&amp;b=2" hidden data-x=1><br><hr/><p class = "y">t &nbsp; < 3</p><a title="open>"""
    found = values(spark, [html], lambda h: F.transform(markup.tags(h), lambda t: F.struct(markup.tag_name(t).alias("t"), markup.attributes(t).alias("a"))))[0]
    assert [(r["t"], [tuple(a) for a in r["a"]]) for r in found] == [
        ("img", [("alt", "a > b"), ("src", "x.png?a=1&b=2"), ("hidden", ""), ("data-x", "1")]), ("br", []), ("hr", []), ("p", [("class", "y")]),
    ]
    want = html.replace("data-x=1>", "data-x=1/>").replace("<br>", "<br/>").replace("&nbsp;", "&#160;")
    assert values(spark, [html, "<img title='open>", "", None], markup.closed_voids) == [want, "<img title='open>", "", None]


def test_cuts_split_no_character_and_no_word(spark):
    text = "añb \U0001f600 cd"
    for n in range(14):
        want = text.encode()[:n].decode(errors="ignore")
        assert values(spark, [text], lambda x: markup.first_bytes(x, n)) == [want]  # noqa: B023
    assert values(spark, [" a\n b  c ", "a b", "", None], lambda x: markup.first_words(x, 2)) == ["a b…", "a b", "", None]
    assert values(spark, ["one two three", "one twothree", "abcdefghij", "short", "ab \ncdefghi"], lambda x: markup.first_tokens(x, 2)) == ["one two…", "one…", "abcdefgh…", "short", "ab…"]
    assert values(spark, ["abc", "ab", None], lambda x: markup.first_characters(x, 2)) == ["ab…", "ab", None]


def test_display_forms(spark):
    assert values(spark, [0, 1023, 1024, 1536, 1048576, 1073741824, 1288490189], markup.file_size, "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB", "1.2 GB"]
    assert values(spark, [0, 1, 1025, 1048575, 1572864], markup.download_size, "long") == ["0 KB", "1 KB", "2 KB", "1024 KB", "1.5 MB"]
    assert values(spark, [-5, 0, 59, 60, 1392], markup.took, "long") == ["0s", "0s", "59s", "1m00s", "23m12s"]
    assert values(spark, ["a b+(c)*~._-é/%"], markup.percent_encoded) == ["a%20b%2B%28c%29%2A~._-%C3%A9%2F%25"]
    assert values(spark, ["ai_ml", "other", "new_kind", None], markup.label) == ["AI & ML", None, "new kind", None]


def test_stored_vectors_are_little_endian_floats(spark):
    cases = [[1.5, -2.25], [], None, [float("nan")], [float("inf")], [None]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<float>").select("i", formats.encoded_vector("v").alias("b"))
    got = {r["i"]: None if r["b"] is None else bytes(r["b"]) for r in rows.collect()}
    assert got == {0: struct.pack("<2f", 1.5, -2.25), 1: b"", 2: None, 3: None, 4: None, 5: None}
    blobs = [struct.pack("<2f", 1.5, -2.25), b"1234567", struct.pack("<2f", 1, float("nan")), None]
    assert values(spark, blobs, lambda b: formats.decoded_vector(b, 2), "binary") == [[1.5, -2.25], None, None, None]


def test_sections_and_themes(spark):
    raw = ["Top Stories", "ai & machine learning", "science and other", "World briefing", " ", None, "and the"]
    assert values(spark, raw, lambda x: formats.resolved_section(x, formats.SECTIONS)) == ["Top Stories", "AI & Machine Learning", "Science & Space", "Top Stories", "Top Stories", "Top Stories", "From the Blogroll"]
    titles = ["On AI: a talk", "Rust databases", "nothing", None]
    plain = lambda x: formats.heuristic_section(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(""), x, formats.SECTIONS)
    assert values(spark, titles, plain) == ["AI & Machine Learning", "Tech & Engineering", "Top Stories", "Top Stories"]
    assert values(spark, ["Rust and SQL", "SQL", "Cats", "xyz"], formats.theme) == ["Systems & languages", "Databases & data", "Outdoors, coffee & everyday life", formats.OTHER_THEME]


def test_words_of_themes_end_at_other_letters(spark, tmp_path):
    cases = {
        "dieöke": "politics", "sé lesèel": "culture", "éthe": "systems", "dieß\nofé": "systems", "das\u0301": "politics", "_die": "other", "los2": "other", "the_": "other", "LAS": "science",
        "DİE": "politics", "of\u212a": "other", "\u0130the": "other", "DER|les": "politics", "": "other", None: "other", "-los-": "science",
    }
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(cases)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(enumerate(cases.values()))
    assert dict(con.sql(registry.oracle_sql()["X22_themes"]).fetchall()) == want
    assert {r["article_id"]: r["theme"] for r in registry.queries()["X22_themes"](spark, str(tmp_path)).collect()} == want


def test_items_of_replies(spark):
    replies = [
        '```json\n[{"id": "7", "score": "11", "kind": "essay", "why": "w"}]\n```', '{"x": [{"id": 2, "interest": -1, "kind": "?"}], "n": 1}', '[{"id": 3, "score": "nan"}, {"score": 1}, {"id": 4, "score": 2.5}, 5, null]',
        "Sure: []", "{", "", None, '{"data": [], "a": [{"id": 1, "score": 1}]}',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "k int, r string")
    got = sorted(tuple(r) for r in formats.scored_items(df, "k", "r").collect())
    assert got == [(0, 7, 10.0, "essay", "w"), (1, 2, 0.0, "other", ""), (2, 4, 2.5, "other", "")]


def test_references_of_discussions(spark):
    bodies = [
        '{"hits": [{"objectID": "1", "points": 5, "url": "https://a.example/x"}, {"objectID": "2", "points": 9, "url": "https://b.example"}]}', '{"hits": [{"objectID": "1", "points": 5}, {"objectID": "2"}, {"objectID": "3", "points": 5}]}',
        '{"hits": []}', '{"data": {"children": [{"kind": "t1", "data": {"id": "c", "score": 9}}, {"kind": "t3", "data": {"id": "p", "score": 1, "num_comments": 4}}]}}', '{"short_id": "s", "comments": [{}, {}]}', "no", None,
    ]
    df = spark.createDataFrame([(i, b, "https://a.example/x") for i, b in enumerate(bodies)], "k int, b string, u string")
    got = sorted(tuple(r) for r in formats.best_refs(df, "k", "b", "u").collect())
    assert got == [(0, "hits", "1", 5, 0), (1, "hits", "3", 5, 0), (3, "listing", "p", 1, 4), (4, "story", "s", 0, 2)]


def test_pages_end_with_the_last(spark):
    got = {r["id"]: r["page"] for r in formats.paged(spark.range(20), ["id"], 3, 4).collect()}
    assert got == {19 - i: i // 3 for i in range(12)}


def test_written_back_values_are_found_the_next_time(spark):
    wanted = spark.createDataFrame([(1, "m", 2, "h", "a"), (2, "m", 2, "new", None)], "id long, model string, dimension int, input string, text string")
    stored = spark.createDataFrame([(1, "m", 2, "h", 0.5), (2, "m", 2, "old", 0.25), (3, "m", 2, "h", 0.75)], "id long, model string, dimension int, input string, value double")
    found, after = formats.through_cache(wanted, stored, formats.KEYS, formats.digest_values)
    assert {r["id"]: r["origin"] for r in found.collect()} == {1: "stored", 2: "computed"}
    again, kept = formats.through_cache(wanted, after, formats.KEYS, formats.digest_values)
    assert {r["origin"] for r in again.collect()} == {"stored"} and sorted(kept.collect()) == sorted(after.collect()) and after.count() == 3


def test_categories_keep_their_spelling(spark):
    interests = spark.createDataFrame([(1, "Rust", None), (2, "rust", None), (3, "Tea", "Drinks"), (4, "Maps", None), (5, "Zen", None)], "id long, name string, category string")
    answers = spark.createDataFrame([(1, " RUST ", " "), (2, "rust", "drinks "), (3, "rust", "Code"), (4, "maps", "x" * 61), (5, "Maps", "Places"), (6, "tea", "Code"), (7, "other", "Code")], "place int, interest string, category string")
    assert sorted(tuple(r) for r in formats.assigned(interests, answers).collect()) == [(2, "Drinks", False), (4, "Places", True)]
