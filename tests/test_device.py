"""Markup for a small reader, on hand-made pages and against a walk that is written token by token."""

import random
import re

from pyspark.sql import functions as F

from gleanery.functions import device

NB, SHY = "\u00a0", "\u00ad"


def shown(spark, cases, rule=device.for_device):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", rule(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_layout_attributes_go_and_all_else_stays(spark):
    cases = {
        '<p class="a" style="float:left" ALIGN=center>a &amp; b</p><img src="x.jpg" alt="An x" width = "900"/>': '<p class="a">a &amp; b</p><img src="x.jpg" alt="An x"/>',
        "<a style='x>y' href=/a/b border>t</a>": "<a href=/a/b>t</a>", '<img / style="x">': '<img / style="x">', '</p style="x"><!-- <b style="x"> --><!D style="x"><?q style="x">': '</p style="x"><!-- <b style="x"> --><!D style="x"><?q style="x">',
        '<b id="z" style="x"title="y"\n width>': '<b id="z"title="y">', 'a < b <i style="x': 'a < b <i style="x', '<b ="v" styles="x" style>': '<b ="v" styles="x">', "no tags": "no tags", "": "",
    }
    assert shown(spark, cases, device.without_attributes) == list(cases.values()) and shown(spark, [None]) == [None]


def test_long_words_get_soft_hyphens(spark):
    w = "é" * 200
    cases = {
        w: w, w + "x": w + SHY + "x", f"a {w}{w} b": f"a {w}{SHY}{w} b", "&amp;" * 200: "&amp;" * 200, "&amp;" * 201: "&amp;" * 200 + SHY + "&amp;", "&amp;" * 198 + "ab": "&amp;" * 198 + "ab",
        f"<p title='{w}x'>{w}</p>{w}": f"<p title='{w}x'>{w}</p>{w}", f"<STYLE>{w}x</style ><script >{w}</p>{w}</SCRIPT>{w}x": f"<STYLE>{w}x</style ><script >{w}</p>{w}</SCRIPT>{w}{SHY}x", f"<styled>{w}x": f"<styled>{w}{SHY}x",
        f"<script>{w}x": f"<script>{w}{SHY}x", f"<!-- {w}x -->": f"<!-- {w}x -->", f"{w} {w}": f"{w} {w}", "&" + "x" * 250: "&" + "x" * 199 + SHY + "x" * 51,
    }
    assert shown(spark, cases) == list(cases.values())


def test_white_space_of_preformatted_text_is_explicit(spark):
    cases = {
        "<pre><code>f() {\n    if x &lt; 2 {\n\t<em>r</em>;\n }\n <b><a href=\"#\">// d</a></b>\n}</code></pre>": f"<pre><code>f() {{<br/>{NB * 4}if x &lt; 2 {{<br/>{NB * 4}<em>r</em>;<br/>{NB}}}<br/>{NB}<b><a href=\"#\">// d</a></b><br/>}}</code></pre>",
        "<p>o  t\n n\tw</p><pre>x  y z</pre><p>t  t</p>": f"<p>o  t\n n\tw</p><pre>x{NB * 2}y z</pre><p>t  t</p>", "<pre><code>\na;\n\nb;</code></pre>": "<pre><code>a;<br/><br/>b;</code></pre>", "<pre>\r\n  x</pre>": f"<pre>{NB * 2}x</pre>",
        "<pre><b>\nx</b></pre>": "<pre><b><br/>x</b></pre>", "<pre><br>\nx<br> y <i> z</i></pre>": f"<pre><br>x<br>{NB}y <i> z</i></pre>", "<PRE\n>a\rb": "<PRE\n>a<br/>b", "<prefix> a  b": "<prefix> a  b",
        "<pre> a<pre>\n b</pre>  c</pre>  d": f"<pre>{NB}a<pre>{NB}b</pre>  c</pre>  d", "<pre>" + "y" * 201 + "\n</pre>": "<pre>" + "y" * 200 + SHY + "y<br/></pre>", "<pre><!-- \n --> x</pre>": f"<pre><!-- \n -->{NB}x</pre>", "<pre></pre>": "<pre></pre>",
    }
    assert shown(spark, cases) == list(cases.values())


def walked(html: str) -> str:
    """The same rule as one pass with a state, for pages without attributes."""
    out, pre, fresh, opened = [], False, False, False
    for t in re.findall(r"(?si)<!--.*?-->|<[^>]*>|<.*|[^<]+", html):
        name = re.match(r"(?i)<(/?[a-z]+)[ \t\n\r>/]", t)
        if t[0] == "<":
            out.append(t)
            name = name[1].lower() if name else ""
            if name == "pre":
                pre = fresh = opened = True
            elif name == "/pre":
                pre = False
            elif name == "br":
                fresh = True
            elif name != "code":
                opened = False
        elif not pre:
            out.append(t)
        else:
            t, opened = re.sub(r"\A(\r\n|[\r\n])", "", t) if opened else t, False
            for a in re.findall(r"\r\n|[\r\n\t]| +|[^ \t\r\n]+", t):
                out.append("<br/>" if a[0] in "\r\n" else NB * 4 if a == "\t" else a if a[0] != " " else NB * len(a) if fresh or len(a) > 1 else a)
                fresh = True if a[0] in "\r\n" else fresh if a[0] in " \t" else False
    return "".join(out)


def test_random_pages_against_a_walk(spark):
    rng = random.Random(5)
    parts = ["<pre>", "<PRE >", "</pre>", "<code>", "</code>", "<br>", "<br/>", "<b>", "</b>", "<!-- a -->", "\n", "\r\n", "\r", "\t", " ", "  ", "a", "b c", "é", "<", ">"]
    cases = ["".join(rng.choice(parts[:-2] if rng.random() < 0.95 else parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert shown(spark, cases) == [walked(c) for c in cases]


def test_a_page_of_many_blocks_and_a_very_long_one(spark):
    many, long = "<pre>\n a  b</pre> <p>c</p>" * 3000, "<pre>" + " x\ty\n" * 60_000 + "</pre>" + "w" * 300_000
    got = shown(spark, [many, long])
    assert got[0] == f"<pre>{NB}a{NB * 2}b</pre> <p>c</p>" * 3000
    assert got[1].startswith("<pre>" + f"{NB}x{NB * 4}y<br/>" * 60_000 + "</pre>") and got[1].count(SHY) == 1499 and len(got[1].split("</pre>")[1]) == 301_499
