"""Markup functions on hand-made pages and on the given ones."""

from gleanery import registry
from gleanery.functions.html import image_addresses, largest, main_text, nested_comments, page_sections, sanitised, sanitised_comment, visible_text

GIVEN = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><p>Menu</p></nav>
<p onclick="x()">One <b>two &amp; three<p>Four <a href="/x?a=1&b=2" class="c">five</a> <a href="javascript:x">six</a></p>
<img src="i.png" alt="a &quot;b&quot;"><iframe src="y">seven</iframe><noscript>eight</noscript><footer><p>End</p></footer></body></html>"""


def test_visible_text_skips_hidden_elements(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("plain < text",)], "h string")
    assert [r[0] for r in df.select(visible_text("h")).collect()] == ["T Menu One two & three Four five six seven End", "", "plain < text"]


def test_sanitised_markup_is_balanced_and_absolute(spark):
    df = spark.createDataFrame([(PAGE, "https://a.example/d/p"), (None, None), ("<em>x<strong>y</em>", None)], "h string, u string")
    page, none, crossed = [r[0] for r in df.select(sanitised("h", "u")).collect()]
    assert '<a href="https://a.example/x?a=1&amp;b=2">five</a>' in page and "<a>six</a>" in page
    assert '<img src="https://a.example/d/i.png" alt="a &quot;b&quot;">' in page
    assert not any(bad in page for bad in ("onclick", "javascript", "<script", "<iframe", "eight", "class="))
    assert none == "" and crossed == "<em>x<strong>y</strong></em>" and "<b>" not in page


def test_main_text_leaves_page_furniture_out(spark):
    df = spark.createDataFrame([(PAGE,), ("",)], "h string")
    assert [r[0] for r in df.select(main_text("h")).collect()] == ["One two & three\nFour five six", ""]


def test_images_are_absolute_distinct_and_not_too_wide(spark):
    html = '<img src="/a.png"><img srcset="s.png 400w, l.png 1600w, xl.png 4000w"><img src="data:x"><img src="/a.png">'
    df = spark.createDataFrame([(html, "https://a.example/d/p")], "h string, u string")
    assert df.select(image_addresses("h", "u")).first()[0] == ["https://a.example/a.png", "https://a.example/d/l.png"]
    assert largest("") == "" and largest("w.png 3000w") == "w.png" and largest("one.png") == "one.png"


def test_given_pages_keep_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{GIVEN}/pages.parquet").collect()}
    for r in registry.queries()["X7_visible_text"](spark, GIVEN).collect():
        assert "track(" not in r["visible"] and "margin:0" not in r["visible"]
    for r in registry.queries()["X12_main_content"](spark, GIVEN).collect():
        assert r["title"] and len(r["title"]) <= 100 and r["title"] in pages[r["page_id"]]
    assert registry.queries()["X11_allow_listed_markup"](spark, GIVEN).count() == len(pages)
    assert all(len(r["images"]) == 2 for r in registry.queries()["X19_images"](spark, GIVEN).collect())


def test_tables_keep_their_parts_and_comments_their_own_elements(spark):
    html = '<table><caption>c</caption><thead><tr><th scope="col" class="x" colspan="2">h</th></tr></thead></table><a href="/x" title="t">a</a>'
    df = spark.createDataFrame([(html, "https://a.example/", "<b>x<i>y</b>"), (None, None, "bare <h1>text</h1>"), ("", "", None)], "h string, u string, c string")
    rows = df.select(sanitised("h", "u"), sanitised_comment("c")).collect()
    assert rows[0][0] == '<table><caption>c</caption><thead><tr><th colspan="2" scope="col">h</th></tr></thead></table><a href="https://a.example/x" title="t">a</a>'
    assert [r[1] for r in rows] == ["<b>x<i>y</i></b>", "<p>bare text</p>", ""]


def test_sections_of_the_first_place_with_events(spark):
    page = """<body><section><ul><li>not here</ul></section><div class="a description"><p>Title <sup>1</sup><ul><li>One <a href="x">two</a>
<ul><li>deep<li><ol><li>deeper</ol></ul><li class="noprint">gone<li> <li>three</ul><ol></ol><h3>Next</h3><ol><li>four</ol><ul><li>five</ul></div></body>"""
    df = spark.createDataFrame([(page,), (None,), ("<body><ul></ul></body>",)], "h string")
    rows = [[tuple(x) for x in r[0]] for r in df.select(page_sections("h")).collect()]
    assert rows == [
        [
            ("s1", None, 0, "Title"), ("s1-e1", "s1", 1, "One two"), ("s1-e1-1", "s1-e1", 2, "deep"), ("s1-e1-2", "s1-e1", 2, ""), ("s1-e1-2-1", "s1-e1-2", 3, "deeper"),
            ("s1-e3", "s1", 1, "three"), ("s2", None, 0, "Next"), ("s2-e1", "s2", 1, "four"), ("s3", None, 0, "Other events"), ("s3-e1", "s3", 1, "five"),
        ], [], [],
    ]


def test_comments_of_both_nested_shapes(spark):
    tree = '{"children": [{"type": "story", "text": "no"}, {"text": "", "children": [{"text": " a ", "author": "x", "points": 3}]}, {"text": null}]}'
    listing = """[{}, {"data": {"children": [{"kind": "more", "data": {"body": "no"}}, {"kind": "t1", "data": {"body": "[removed]", "replies": {"data": {"children": [
{"kind": "t1", "data": {"body": "gone"}}]}}}}, {"kind": "t1", "data": {"body": "a", "score": 2, "author": "x", "replies": {"data": {"children": [{"kind": "t1", "data": {"body": "b",
"replies": ""}}]}}}}, {"kind": "t1", "data": {"body": "pinned", "stickied": true}}]}}]"""
    df = spark.createDataFrame([(tree,), (listing,), ("not json",), (None,), ("[]",)], "b string")
    rows = [[tuple(x) for x in r[0]] for r in df.select(nested_comments("b")).collect()]
    assert rows[0] == [(1, 0, 0, "[deleted]", None, ""), (2, 1, 1, "x", 3, "a")]
    assert rows[1] == [(1, 0, 0, "x", 2, "a"), (2, 1, 1, "[deleted]", None, "b")] and rows[2:] == [[], [], []]
