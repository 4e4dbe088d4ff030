"""Paged ingest, discussion payloads, page sections, markup, cuts, display forms, replies of a model, caches and categories in full."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from gleanery.functions.columns import bound, canonical_url
from gleanery.functions.device import for_device
from gleanery.functions.html import nested_comments, page_sections
from gleanery.functions.markup import (
    LABELS, attributes, closed_voids, download_size, entities_decoded, escaped, file_size, first_bytes, first_characters, first_tokens, first_words, label, percent_encoded, tag_name, tags,
    took, unescaped,
)
from gleanery.operators.ranking import numbered_within, upsert
from gleanery.sources.views import articles, table, with_views

from .catalog import query

# ---- ingest -------------------------------------------------------------------------------------------------------------------


@query("S3_paged_ingest", """WITH p AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts > TIMESTAMP '2024-01-10')
SELECT event_id, ((k - 1) // 250)::BIGINT AS page, coalesce(c_name, 'feed ' || user_id) AS feed FROM p LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 WHERE k <= 250 * 200 AND (ts IS NULL OR ts <= TIMESTAMP '2024-01-21 12:00:00')""")  # fmt: skip
def s3_paged(spark, sf):
    since, until = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10", "2024-01-21 12:00:00"))
    names = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows = paged(table(spark, sf, "events").filter(F.col("ts") > since), ["ts", "event_id"]).filter(F.col("ts").isNull() | (F.col("ts") <= until))
    return rows.join(names, "user_id", "left").select("event_id", "page", F.coalesce("c_name", F.concat(F.lit("feed "), "user_id")).alias("feed"))


def paged(rows: DataFrame, newest: list[str], size: int = 250, most: int = 200) -> DataFrame:
    """The rows that reading page after page gives, newest first, with their page from 0: at most ``most`` pages of ``size`` rows. What
    lies behind the last page is left out, as a source that is read by pages does; the window runs over these rows alone."""
    order = [F.desc(c) for c in newest]
    read = rows.orderBy(*order).limit(size * most)
    return read.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


# ---- discussions --------------------------------------------------------------------------------------------------------------

ITEMS = "i AS (SELECT *, l_orderkey % 3 AS shape, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_returnflag, l_linestatus) AS place FROM lineitem)"


@query("S5_discussion_refs", f"""WITH {ITEMS}, w AS (SELECT l_orderkey, min(l_partkey) AS wanted FROM i GROUP BY 1),
h AS (SELECT l_orderkey, arg_max({{'item': l_partkey::VARCHAR, 'score': l_quantity::BIGINT, 'comments': l_suppkey}}, ((l_partkey = wanted)::INT, l_quantity, place)) AS r FROM i JOIN w USING (l_orderkey) WHERE shape = 0 GROUP BY 1),
c AS (SELECT l_orderkey, arg_max({{'item': CASE WHEN l_returnflag = 'R' THEN 't3_' || l_partkey ELSE l_partkey::VARCHAR END, 'score': l_quantity::BIGINT, 'comments': l_suppkey}}, (l_quantity, place)) AS r FROM i WHERE shape = 1 AND l_linestatus = 'O' GROUP BY 1),
s AS (SELECT l_orderkey, {{'item': 's' || l_orderkey, 'score': sum(l_quantity)::BIGINT, 'comments': CASE WHEN l_orderkey % 2 = 0 THEN 99 ELSE count(*) END}} AS r FROM i WHERE shape = 2 GROUP BY 1)
SELECT l_orderkey, source, r.item AS item, r.score AS score, r.comments AS comments FROM (SELECT *, 'hits' AS source FROM h UNION ALL SELECT *, 'listing' FROM c UNION ALL SELECT *, 'story' FROM s)""")  # fmt: skip
def s5_refs(spark, sf):
    """Replies of three sources, written as JSON from the line items of an order each, and read back."""
    place = ["l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus"]
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("rows"))
    page = lambda part: F.concat(F.lit("https://example.org/p/"), part.cast("string"))
    points, said = (lambda x: x["l_quantity"].cast("long")), (lambda x: x["l_suppkey"])
    hit = lambda x: F.struct(x["l_partkey"].cast("string").alias("objectID"), points(x).alias("points"), said(x).alias("num_comments"), F.concat(page(x["l_partkey"]), F.lit("/?utm_source=a#b")).alias("url"))
    post = lambda x: F.struct(
        F.when(x["l_linestatus"] == "O", "t3").otherwise("t1").alias("kind"),
        F.struct(F.when(x["l_returnflag"] == "R", F.concat(F.lit("t3_"), x["l_partkey"])).alias("name"), x["l_partkey"].cast("string").alias("id"), points(x).alias("score"), said(x).alias("num_comments")).alias("data"),
    )
    hits = F.to_json(F.struct(F.transform("rows", hit).alias("hits")))
    listing = F.to_json(F.struct(F.struct(F.transform("rows", post).alias("children")).alias("data")))
    total = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["l_quantity"]).cast("long")
    story = F.to_json(F.struct(F.concat(F.lit("s"), "l_orderkey").alias("short_id"), total.alias("score"), F.when(F.col("l_orderkey") % 2 == 0, 99).alias("comment_count"), F.transform("rows", lambda x: F.struct(x["l_partkey"].alias("id"))).alias("comments")))
    k = F.col("l_orderkey") % 3
    replies = orders.select("l_orderkey", page(F.array_min(F.transform("rows", lambda x: x["l_partkey"]))).alias("wanted"), F.when(k == 0, hits).when(k == 1, listing).otherwise(story).alias("body"))
    return best_refs(replies, "l_orderkey", "body", "wanted")


def best_refs(df: DataFrame, key: str, body: str, wanted: str) -> DataFrame:
    """key, source, item, score, comments: of search hits the best with the wanted address, else the best; of listed posts the best;
    of a story itself. Best is most points, the last of equals; missing points count 0. Texts of no such shape give no row."""
    schema = """hits array<struct<objectID:string,points:long,num_comments:long,url:string>>, data struct<children:array<struct<kind:string,data:struct<id:string,name:string,score:long,num_comments:long>>>>,
    short_id string, score long, comment_count long, comments array<string>"""
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    ref = lambda source, item, score, comments: F.struct(F.lit(source).alias("source"), item.alias("item"), none(score).alias("score"), none(comments).alias("comments"))
    best = lambda found, rank, out: bound(F.array_max(F.transform(found, lambda x, i: F.struct(*rank(x), i.alias("i"), x.alias("x")))), lambda b: F.when(b.isNotNull(), out(b["x"])))
    read = df.select(key, wanted, F.from_json(body, schema).alias("r"))
    exact = lambda h: F.coalesce(canonical_url(h["url"]) == F.col(wanted), F.lit(False))
    hit = best(F.col("r.hits"), lambda h: [exact(h).alias("e"), none(h["points"]).alias("p")], lambda h: ref("hits", h["objectID"], h["points"], h["num_comments"]))
    posts = F.filter("r.data.children", lambda c: c["kind"] == "t3")
    post = best(posts, lambda c: [none(c["data"]["score"]).alias("p")], lambda c: ref("listing", F.coalesce(c["data"]["name"], c["data"]["id"]), c["data"]["score"], c["data"]["num_comments"]))
    size = F.when(F.col("r.comments").isNotNull(), F.size("r.comments").cast("long"))
    story = F.when(F.col("r.short_id").isNotNull(), ref("story", F.col("r.short_id"), F.col("r.score"), F.coalesce("r.comment_count", size)))
    return read.select(key, F.coalesce(hit, post, story).alias("ref")).filter("ref IS NOT NULL").select(key, "ref.*")


@query("S5_nested_comments", """WITH c AS (SELECT conv_id, row_number() OVER w::INT AS place, CASE WHEN turn % 5 = 3 THEN '' ELSE trim(text, ' \t\n\r') END AS text, role, turn, max(CASE WHEN turn % 5 = 3 OR trim(text, ' \t\n\r') = '' THEN -1 ELSE turn END) OVER (PARTITION BY conv_id) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, place, place - 1 AS parent, place - 1 AS depth, role AS author, turn AS points, text FROM c WHERE turn <= last""")  # fmt: skip
def s5_nested(spark, sf):
    """Each conversation as a chain of replies in JSON, every fifth text missing, read back as rows."""
    t = F.struct("turn", "role", F.when(F.col("turn") % 5 == 3, "").otherwise(F.col("text")).alias("text"))
    chains = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("c"))
    head = F.transform("c", lambda x: F.concat(F.regexp_replace(F.to_json(F.struct(x["role"].alias("author"), x["turn"].alias("points"), x["text"].alias("text"))), r"\}$", ""), F.lit(',"children":[')))
    body = F.concat(F.lit('{"children":['), F.array_join(head, ""), F.repeat(F.lit("]}"), F.size("c") + 1))
    return chains.select("conv_id", F.inline(nested_comments(body)))


@query("S5_flat_threads", """WITH c AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn % 4 = 2 OR trim(text) = '' AS gone FROM conversations)
SELECT c.conv_id, c.turn, p.turn AS parent FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.parent AND NOT p.gone WHERE NOT c.gone""")  # fmt: skip
def s5_flat(spark, sf):
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(t > 0, F.floor((t - 1) / 2)).alias("parent"), ((t % 4 == 2) | (F.trim("text") == "")).alias("gone"))
    return rooted(rows, "conv_id", "turn")


def rooted(comments: DataFrame, thread: str, key: str) -> DataFrame:
    """thread, key, parent of the comments that aren't gone; one whose parent is gone or missing begins a thread."""
    kept = comments.filter(~F.col("gone"))
    above = kept.select(thread, F.col(key).alias("parent"), F.lit(True).alias("__held"))
    return kept.join(above, [thread, "parent"], "left").select(thread, key, F.when(F.col("__held"), F.col("parent")).alias("parent"))


@query("S6_nested_sections", """WITH t AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS items FROM pages), u AS (SELECT page_id, generate_subscripts(items, 1) AS n, len(items) AS last, trim(regexp_replace(replace(unnest(items), '&amp;', '&'), '\\s+', ' ', 'g')) AS label FROM t)
SELECT page_id, 's1' AS id, NULL AS parent, 0 AS depth, url AS label FROM t WHERE len(items) > 0 UNION ALL SELECT page_id, 's1-e' || n, 's1', 1, label FROM u WHERE label <> '' OR n = last UNION ALL SELECT page_id, 's1-e' || last || '-1', 's1-e' || last, 2, 'page ' || page_id FROM u WHERE n = last""")  # fmt: skip
def s6_nested(spark, sf):
    """The menus of pages as a titled section whose last item holds a list of its own."""
    html = F.replace("html", F.lit("<nav>"), F.concat(F.lit("<section><p>"), escaped(F.col("url")), F.lit("</p>")))
    html = F.replace(html, F.lit("</li></ul></nav>"), F.concat(F.lit("<ul><li>page "), F.col("page_id").cast("string"), F.lit("</li></ul></li></ul></section>")))
    return table(spark, sf, "pages").select("page_id", F.inline(page_sections(html)))


# ---- markup and text ----------------------------------------------------------------------------------------------------------


@query("X9_decoded_and_escaped", """WITH f AS (SELECT page_id, regexp_extract(html, '<footer>(.*?)</footer>', 1) || ' &#38;lt; &#x20AC;&#8212; &bogus; &#1114112; "q"' AS footer FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(footer, '&lt;', chr(1)), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&#x20AC;', '€'), '&#8212;', '—'), '&#38;', chr(2)), '&amp;', '&') AS d FROM f),
e AS (SELECT page_id, replace(replace(d, chr(1), '<'), chr(2), '&') AS decoded FROM d)
SELECT page_id, decoded, replace(replace(replace(replace(decoded, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attribute FROM e""")  # fmt: skip
def x9_full(spark, sf):
    footer = F.concat(F.regexp_extract("html", "<footer>(.*?)</footer>", 1), F.lit(' &#38;lt; &#x20AC;&#8212; &bogus; &#1114112; "q"'))
    return table(spark, sf, "pages").select("page_id", entities_decoded(footer).alias("decoded")).withColumn("attribute", escaped(F.col("decoded"), quotes=True))


@query("X10_attributes", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[a-zA-Z][^>]*>')) AS tag FROM pages), a AS (SELECT page_id, lower(regexp_extract(tag, '^<([^ />]+)', 1)) AS tag, unnest(regexp_extract_all(tag, '[a-zA-Z-]+="[^"]*"')) AS a FROM t)
SELECT page_id, tag, lower(regexp_extract(a, '^([^=]+)', 1)) AS name, replace(regexp_extract(a, '"(.*)"', 1), '&amp;', '&') AS value, count(*) AS n FROM a GROUP BY ALL""")  # fmt: skip
def x10_attributes(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.explode(tags(F.col("html"))).alias("t")).select("page_id", tag_name(F.col("t")).alias("tag"), F.inline(attributes(F.col("t"))))
    return t.groupBy("page_id", "tag", "name", "value").agg(F.count("*").alias("n"))


@query("X10_closed_voids", "SELECT page_id, md5(replace(regexp_replace(html, '<((br|meta|img|hr|link|input)( [^>]*[^/>])?)>', '<\\1/>', 'g'), '&nbsp;', '&#160;')) AS markup FROM pages")
def x10_closed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(closed_voids(F.col("html"))).alias("markup"))


@query("X13_cuts", """WITH c AS (SELECT doc_id, text, left(text, list_max(list_filter(range(0, 81), lambda k: octet_length(encode(left(text, k))) <= 80))) AS cut, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, array_to_string(w[1:12], ' ') || CASE WHEN len(w) > 12 THEN '…' ELSE '' END AS words, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS characters, cut AS bytes,
 CASE WHEN octet_length(encode(text)) <= 80 THEN text ELSE regexp_replace(cut, ' [^ ]*$', '') || '…' END AS tokens FROM c""")  # fmt: skip
def x13_cuts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", first_words(t, 12).alias("words"), first_characters(t, 80).alias("characters"), first_bytes(t, 80).alias("bytes"), first_tokens(t, 20).alias("tokens"))


@query("X23_device_markup", """WITH p AS (SELECT page_id, list_transform(string_split(html, '<'), lambda x: regexp_extract(x, '^([^>]*>)?', 0) || regexp_replace(regexp_replace(regexp_replace(x, '^[^>]*>', ''), '(\\S{200})', '\\1' || chr(173), 'g'), chr(173) || '(\\s|$)', '\\1', 'g')) AS parts FROM pages),
d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^(\\r\\n|\\n|\\r)', ''), '\\r\\n|\\n|\\r') AS lines FROM documents),
b AS (SELECT doc_id, list_transform(lines, lambda l: {'head': regexp_extract(l, '^[ \\t]*'), 'rest': regexp_replace(regexp_replace(regexp_extract(l, '^[ \\t]*(.*)$', 1, 's'), '(\\S{200})', '\\1' || chr(173), 'g'), chr(173) || '(\\s|$)', '\\1', 'g')}) AS lines FROM d),
w AS (SELECT doc_id, list_transform(lines, lambda l: replace(l.head, ' ', chr(57344)) || replace(replace(l.rest, '  ', chr(57344) || chr(57344)), chr(57344) || ' ', chr(57344) || chr(57344))) AS lines FROM b)
SELECT 'page' AS kind, page_id AS id, md5(regexp_replace(array_to_string(parts, '<'), ' (style|align|width|height|srcset|sizes|loading|hspace|vspace|border)="[^"]*"', '', 'g')) AS markup FROM p UNION ALL SELECT 'block', doc_id, md5('<pre><code>' || replace(replace(replace(replace(replace(replace(array_to_string(lines, chr(10)), chr(9), repeat(chr(57344), 4)), chr(57344), chr(160)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</code></pre>') FROM w""")  # fmt: skip
def x23_device(spark, sf):
    """Pages for a small reader, and whole texts as preformatted blocks of it."""
    p = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("m"))
    block = F.concat(F.lit("<pre style='margin:0'><code>"), escaped(F.col("text")), F.lit("</code></pre>"))
    d = table(spark, sf, "documents").select(F.lit("block").alias("kind"), F.col("doc_id").alias("id"), block.alias("m"))
    return p.union(d).select("kind", "id", F.md5(for_device(F.col("m"))).alias("markup"))


# What places an item into a section, in the order of the rules; the words stand anywhere in its category, feed and title.
SECTION_RULES = [
    ("Boston & Local", ["boston", "massachusetts", "cambridge", "mbta", "new england"]),
    ("AI & Machine Learning", [" ai ", "ai:", "llm", "machine learning", "neural", "openai", "anthropic", "gpt"]),
    ("Science & Space", ["science", "space", "nasa", "astronom", "physics", "biology", "climate"]),
    ("Culture & Essays", ["essay", "culture", "book", "fiction", "poetry", "film", "music", "art", "review"]),
    ("Niche Corner", ["hobby", "retro", "keyboard", "board game", "coffee", "e-ink", "eink"]),
    ("Tech & Engineering", ["tech", "programming", "engineering", "software", "developer", "rust", "linux", "database", "systems", "web"]),
]
SECTIONS = ["Top Stories", *[name for name, _ in SECTION_RULES], "From the Blogroll"]
RULE_SQL = " ".join(f"WHEN {' OR '.join(f'contains(hay, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in SECTION_RULES)


def default_section(sections: list[str]) -> str:
    return "Top Stories" if "Top Stories" in sections or not sections else sections[0]


def words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) > 2) & (F.lower(w) != "and")), F.lower))


def resolved_section(raw: Column, sections: list[str], reserved: str = "World Briefing") -> Column:
    """The section of that name, else of that name in another case, else the last of those that share most words, else the default,
    which also takes blank and reserved names; null counts as blank."""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    known = F.array(*map(F.lit, sections)) if sections else F.array().cast("array<string>")
    same = F.get(F.filter(known, lambda s: F.lower(s) == F.lower(raw)), F.lit(0))
    shared = F.array_max(F.transform(known, lambda s, i: F.struct(F.size(F.array_intersect(words_of(s), words_of(raw))).alias("n"), i.alias("i"), s.alias("s"))))
    exact = F.when(F.array_contains(known, raw), raw)
    default = F.lit(default_section(sections))
    return F.when((raw == "") | (F.lower(raw) == reserved.lower()), default).otherwise(F.coalesce(exact, same, F.when(shared["n"] > 0, shared["s"]), default))


def heuristic_section(auto: Column, said: Column, category: Column, feed: Column, title: Column, sections: list[str]) -> Column:
    """Always-included items go to their own section, those with an assessed category there, others by the first rule with a word in
    category, feed and title whose section is in use, else to the default."""
    none = lambda c: F.coalesce(c, F.lit(""))
    hay = F.lower(F.concat_ws(" ", none(category), none(feed), none(title)))
    ruled = bound(hay, lambda h: F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w)), name) for name, words in SECTION_RULES if name in sections], F.lit(default_section(sections))))
    return F.when(auto, resolved_section(F.lit("From the Blogroll"), sections)).when(said.isNotNull(), resolved_section(said, sections)).otherwise(ruled)


@query("X22_heuristic_sections", with_views("articles", f""", h AS (SELECT *, lower(coalesce(category, '') || ' ' || coalesce(feed, '') || ' ' || coalesce(title, '')) AS hay FROM articles)
SELECT article_id, CASE WHEN article_id % 29 = 0 THEN 'From the Blogroll' WHEN article_id % 13 = 0 THEN 'Science & Space' WHEN article_id % 13 = 1 THEN 'Tech & Engineering' WHEN article_id % 13 = 2 THEN 'Top Stories' {RULE_SQL} ELSE 'Top Stories' END AS section FROM h"""))
def x22_sections(spark, sf):
    k = F.col("article_id") % 13
    said = F.when(k == 0, "science & SPACE").when(k == 1, "Software and Engineering News").when(k == 2, " nothing known ")
    return articles(spark, sf).select("article_id", heuristic_section(F.col("article_id") % 29 == 0, said, F.col("category"), F.col("feed"), F.col("title"), SECTIONS).alias("section"))


# Themes of interests, in the order of the rules, and the words that stand anywhere in an interest's name.
INTEREST_THEMES = [
    ("Systems & languages", "rust, zig, lua, assembly, compiler, systems programming, concurrency, async, memory, simd, zero-copy, parser, fuzz, static analysis, functional programming, data structures, algorithm, performance, profil, python, typescript, node.js, wasm, webassembly, reactive programming, lsp"),
    ("Databases & data", "database, sql, postgres, query, vector databases, bloom, compression, data engineering, knowledge graph, message queue, distributed systems, crdt, microservices, system design"),
    ("AI & machine learning", "ai, llm, machine learning, nlp, rag, prompt, agent, claude, eval"),
    ("Web, infra & devtools", "web, css, htmx, svelte, react, pwa, api, developer, devops, docker, git, observability, cloud, cdn, edge, networking, mesh, ipfs, activitypub, atproto, search engines, tauri, design systems, cybersecurity, cryptography, monitoring, spatial computing, webrtc, webgpu, webgl, webcodecs, android, mobile, code generation"),
    ("Self-hosting, RSS & the indie web", "self-host, self host, homelab, rss, feed reader, indie web, personal website, personal wiki, digital garden, static site, static sites, personal archiving, offline-first, privacy, open source, licensing, side projects, digital nomad, remote living, off-grid, quantified self, cloudflare workers"),
    ("E-ink, terminals & hardware", "e-ink, eink, writerdeck, tmux, neovim, terminal, text editor, editor, window manager, keyboard, hardware, electronics, calibre, ghostty, retro computing, low-tech, manufacturing, typography, linux"),
    ("Games & interactive fiction", "game, gaming, minecraft, mud, interactive fiction, inform7, bevy, sim racing, modding"),
    ("Creative coding & digital art", "generative, creative coding, creative automation, glitch, procedural, digital art, gaussian splatting, cellular automata, sonification, code visualization, photo, photography, agent-based"),
    ("Writing, books & PKM", "writing, write, reading, book, essay, poetry, literature, note-taking, journaling, pkm, knowledge management, obsidian, markdown, commonplace, longform, long-form, fiction, worldbuilding, sci-fi, science fiction, speculative, podcast, narrative, choice architecture"),
    ("Science, space & nature", "space, aerospace, aviation, science, neuroscience, bioinformatics, nature, cognitive, social science"),
    ("History, policy & culture", "history, policy, culture, lgbt, queer, startups, apple, boston, criticism, internet history, computing history"),
    ("Outdoors, coffee & everyday life", "hiking, camping, running, trail, coffee, cats, films, music, engineering"),
]
OTHER_THEME = "Other standing interests"
THEME_SQL = " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in words.split(", ")) + f" THEN '{name}'" for name, words in INTEREST_THEMES)


def theme(name: Column, themes: list[tuple[str, str]] = INTEREST_THEMES) -> Column:
    """The first theme with a word in the name."""
    return bound(F.lower(name), lambda k: F.coalesce(*[F.when(F.exists(F.split(F.lit(words), ", "), lambda w: F.contains(k, w)), t) for t, words in themes], F.lit(OTHER_THEME)))


@query("X22_interest_themes", with_views("articles", f""", k AS (SELECT article_id, title, lower(title) AS k FROM articles WHERE title IS NOT NULL), t AS (SELECT *, CASE {THEME_SQL} ELSE '{OTHER_THEME}' END AS theme FROM k)
SELECT article_id, theme, row_number() OVER (PARTITION BY theme ORDER BY k, title, article_id)::INT AS place FROM t"""))  # fmt: skip
def x22_interests(spark, sf):
    named = articles(spark, sf).filter("title IS NOT NULL").select("article_id", "title", theme(F.col("title")).alias("theme"))
    members = numbered_within(named, ["theme"], [F.asc(F.lower("title")), F.asc("title"), F.asc("article_id")], "place")
    return members.select("article_id", "theme", F.col("place").cast("int").alias("place"))


TOKENS = [*LABELS, "other", "open_letter"]
LABEL_SQL = " ".join(f"WHEN {i} THEN '{LABELS.get(t, t.replace('_', ' '))}'" for i, t in enumerate(TOKENS) if t != "other")


@query("X25_sizes_and_labels", f"""WITH n AS (SELECT *, o_orderkey * 104729 % 6000000 AS n, o_orderkey * 15485863 % 5000000000 AS b FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) ELSE ceil(n / 1024.0)::BIGINT || ' KB' END AS download,
 CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' B' END AS size,
 url_encode(o_orderpriority || ' (é*~)/' || o_orderstatus) AS segment, CASE WHEN o_orderkey % 5000 >= 60 THEN (o_orderkey % 5000 // 60) || 'm' || lpad((o_orderkey % 5000 % 60)::VARCHAR, 2, '0') || 's' ELSE (o_orderkey % 5000) || 's' END AS took,
 CASE o_orderkey % {len(TOKENS)} {LABEL_SQL} END AS label FROM n""")  # fmt: skip
def x25_full(spark, sf):
    k = F.col("o_orderkey")
    token = F.get(F.array(*map(F.lit, TOKENS)), (k % len(TOKENS)).cast("int"))
    segment = percent_encoded(F.concat("o_orderpriority", F.lit(" (é*~)/"), "o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", download_size(k * 104729 % 6000000).alias("download"), file_size(k * 15485863 % 5000000000).alias("size"), segment.alias("segment"), took(k % 5000).alias("took"), label(token).alias("label")
    )


# ---- vectors ------------------------------------------------------------------------------------------------------------------


@F.pandas_udf(BinaryType())
def encoded_vector(v: pd.Series) -> pd.Series:
    """Components as little-endian 32-bit floats; null for null, and if one is missing or not finite."""

    def one(x):
        a = np.asarray([np.nan if c is None else c for c in x] if x is not None else [np.nan], dtype="<f4")
        return a.tobytes() if np.isfinite(a).all() else None

    return v.map(one)


def decoded_vector(blob: Column, dimension: int) -> Column:
    """Components of little-endian 32-bit floats; null for another length, and if one isn't finite."""
    return _decoded(blob, F.lit(dimension))


@F.pandas_udf(ArrayType(DoubleType()))
def _decoded(blob: pd.Series, dimension: pd.Series) -> pd.Series:
    def one(b, n):
        if b is None or len(b) != 4 * n:
            return None
        a = np.frombuffer(b, "<f4")
        return a.astype("f8") if np.isfinite(a).all() else None

    return pd.Series([one(b, n) for b, n in zip(blob, dimension, strict=True)], dtype=object)


@query("V2_stored_vectors", """SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) END AS square FROM embeddings""")
def v2_stored(spark, sf):
    """Vectors through their stored form; every seventh blob has lost a byte."""
    blob = encoded_vector(F.col("embedding").cast("array<float>"))
    stored = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n"), blob.alias("b"))
    cut = F.when(F.col("vec_id") % 7 == 0, F.substring("b", 1, F.octet_length("b") - 1)).otherwise(F.col("b"))
    read = stored.select("vec_id", _decoded(cut, F.col("n")).alias("v"))
    return read.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


# ---- replies and reports ------------------------------------------------------------------------------------------------------

# Kinds that a reply may name, and the fields that hold its list, in the order they are looked for.
KINDS_OF_ITEMS = "essay deep_dive report first_hand howto news announcement roundup marketing repo docs discussion paper media fiction other".split()
LIST_FIELDS = ["articles", "results", "items", "data"]


def unfenced(reply: Column) -> Column:
    """A reply without the fence of three marks round it."""
    t = F.regexp_replace(reply, r"^\s+|\s+\z", "")
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*(?:```)+\z", "")).otherwise(t)


def listed(reply: Column) -> Column:
    """JSON texts of the objects in a reply's list: the reply itself, a field of a known name, or the first field, by name, that
    is a list. Null if there is none or the reply isn't JSON."""
    is_list = lambda x: F.coalesce(F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")), F.lit(False))

    def found(text: Column) -> Column:
        fields = F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.from_json(text, "map<string,string>"))
        known = F.filter(F.transform(F.array(*map(F.lit, LIST_FIELDS)), lambda f: F.element_at(fields, f)), is_list)
        others = F.transform(F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: is_list(v)))), lambda e: e["value"])
        return F.coalesce(F.when(is_list(text), text), F.get(known, F.lit(0)), F.get(others, F.lit(0)))

    return F.from_json(bound(unfenced(reply), found), "array<string>")


def scored_items(df: DataFrame, key: str, reply: str) -> DataFrame:
    """key, id, interest (held between 0 and 10), kind, why (12 words) of the items of a model's reply. Numbers may stand in quotes;
    items without an id or a finite score are left out; an unknown kind is "other"."""
    items = df.select(key, F.explode(listed(F.col(reply))).alias("item")).select(key, F.from_json("item", "map<string,string>").alias("f"))
    get = lambda *names: F.coalesce(*[F.element_at("f", n) for n in names])
    number = F.trim(get("id"))
    whole = F.coalesce(number.try_cast("long"), number.try_cast("double").try_cast("long"))
    score = F.trim(get("interest", "score")).try_cast("double")
    kind = F.trim(get("kind"))
    rows = items.select(key, whole.alias("id"), score.alias("interest"), F.when(kind.isin(KINDS_OF_ITEMS), kind).otherwise("other").alias("kind"), first_words(F.coalesce(get("why", "rationale"), F.lit("")), 12).alias("why"))
    rows = rows.filter("id IS NOT NULL AND interest IS NOT NULL AND NOT isnan(interest)").filter(F.abs("interest") < float("inf"))
    return rows.withColumn("interest", F.least(F.greatest("interest", F.lit(0.0)), F.lit(10.0)))


@query("N1_scored_items", """WITH i AS (SELECT l_orderkey % 5 AS shape, * FROM lineitem)
SELECT l_orderkey, l_partkey AS id, least(l_quantity - 20, 10) AS interest, CASE l_returnflag WHEN 'R' THEN 'essay' WHEN 'A' THEN 'news' ELSE 'other' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'w w w w w w w w w w w w…' ELSE 'short' END AS why FROM i WHERE shape <> 4 AND l_quantity > 20
UNION ALL SELECT l_orderkey, l_partkey, 0.0, CASE l_returnflag WHEN 'R' THEN 'essay' WHEN 'A' THEN 'news' ELSE 'other' END, CASE WHEN l_linestatus = 'F' THEN 'w w w w w w w w w w w w…' ELSE 'short' END FROM i WHERE shape <> 4 AND l_quantity <= 20 AND l_quantity > 5""")  # fmt: skip
def n1_items(spark, sf):
    """Replies of five forms, written from the line items of an order each; items of few units have no score."""
    q = F.col("l_quantity") - 20
    score = F.when(F.col("l_quantity") > 5, F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit('"'), q.cast("string"), F.lit('"'))).otherwise(q.cast("string"))).otherwise(F.lit('"high"'))
    id_ = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit('" '), F.col("l_partkey").cast("string"), F.lit('"'))).otherwise(F.col("l_partkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "essay").when(F.col("l_returnflag") == "A", "news").otherwise("rant")
    field = F.when(F.col("l_linenumber") % 2 == 0, "score").otherwise("interest")
    why = F.when(F.col("l_linestatus") == "F", F.repeat(F.lit("w "), 14)).otherwise("short")
    item = F.concat(F.lit('{"id":'), id_, F.lit(',"'), field, F.lit('":'), score, F.lit(',"kind":" '), kind, F.lit('","why":"'), why, F.lit('"}'))
    orders = table(spark, sf, "lineitem").select("l_orderkey", item.alias("i")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("i"), ",").alias("i"))
    k, listing = F.col("l_orderkey") % 5, F.concat(F.lit("["), "i", F.lit("]"))
    reply = (
        F.when(k == 0, listing)
        .when(k == 1, F.concat(F.lit("```json\n"), listing, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit('{"a": [1], "results": '), listing, F.lit("}")))
        .when(k == 3, F.concat(F.lit(' {"z": [{"id": 1, "score": 2}], "b": "x", "m": '), listing, F.lit("} ")))
        .otherwise(F.concat(F.lit("Sure: "), listing))
    )
    return scored_items(orders.select("l_orderkey", reply.alias("reply")), "l_orderkey", "reply")


def stored_model(config: Column, role: str) -> Column:
    """The model of a role in the settings of three generations: by role, within the role, or of the provider that the role names."""
    within = F.get_json_object(config, f"$.llm.{role}")
    providers = F.from_json(F.get_json_object(config, "$.providers"), "map<string,struct<model:string>>")
    return F.coalesce(F.get_json_object(config, f"$.models.{role}"), F.get_json_object(config, f"$.llm.{role}.model"), F.try_element_at(providers, within)["model"])


def editor_model(config: Column, bulk: Column, current: str) -> Column:
    said = stored_model(config, "editor")
    return F.when(said.isin("disabled", "none"), F.concat(bulk, F.lit(" (bulk fallback)"))).otherwise(F.coalesce(said, F.lit(current)))


def provider_costs(costs: Column) -> Column:
    """Costs by provider: numbers, or objects that hold them; others are left out."""
    each = F.transform_values(F.from_json(costs, "map<string,string>"), lambda k, v: F.coalesce(v.try_cast("double"), F.get_json_object(v, "$.cost_usd").try_cast("double")))
    return F.map_filter(each, lambda k, v: v.isNotNull())


@query("N4_legacy_reports", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'now' ELSE o_orderpriority END AS bulk, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ' (bulk fallback)' WHEN 1 THEN 'e' || o_orderstatus WHEN 2 THEN 'now' ELSE 'now' END AS editor,
 round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS cost, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS selected FROM orders""")  # fmt: skip
def n4_legacy(spark, sf):
    """Settings and reports of four generations, written from the orders and read back."""
    k, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    config = (
        F.when(k == 0, F.to_json(F.struct(F.struct(p.alias("bulk"), F.lit("disabled").alias("editor")).alias("models"))))
        .when(k == 1, F.to_json(F.struct(F.struct(F.struct(p.alias("model")).alias("bulk"), F.struct(F.concat(F.lit("e"), "o_orderstatus").alias("model")).alias("editor")).alias("llm"))))
        .when(k == 2, F.to_json(F.struct(F.struct(F.lit("a-1").alias("bulk"), F.lit("gone").alias("editor")).alias("llm"), F.create_map(F.lit("a-1"), F.struct(p.alias("model"))).alias("providers"))))
        .otherwise("{}")
    )
    flat = F.to_json(F.create_map(F.lit("a"), F.col("o_totalprice")))
    nested = F.to_json(F.create_map(F.lit("a"), F.struct(F.col("o_totalprice").alias("cost_usd")), F.lit("b"), F.struct(F.lit(1.0).alias("cost_usd")), F.lit("c"), F.struct(F.lit(None).cast("double").alias("cost_usd"))))
    report = F.when(F.col("o_orderkey") % 3 == 0, F.format_string('{"counts":{"selected":%d}}', "o_custkey")).when(F.col("o_orderkey") % 3 == 1, "{}")
    bulk = F.coalesce(stored_model(config, "bulk"), F.lit("now"))
    total = F.aggregate(F.map_values(provider_costs(F.when(F.col("o_orderkey") % 2 == 0, nested).otherwise(flat))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "orders").select(
        "o_orderkey", bulk.alias("bulk"), editor_model(config, bulk, "now").alias("editor"), F.round(total, 2).alias("cost"), F.get_json_object(report, "$.counts.selected").cast("long").alias("selected")
    )


# ---- caches and categories ----------------------------------------------------------------------------------------------------

KEYS = ["id", "model", "dimension", "input"]


def through_cache(wanted: DataFrame, stored: DataFrame, keys: list[str], compute: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """What is stored under all keys of the wanted rows with what ``compute`` makes of the others, batch by batch; and the store after
    the latter were written back, where they replace rows of their first key. ``wanted`` holds the keys once."""
    missing = wanted.join(stored.select(*keys), keys, "left_anti")
    fresh = missing.mapInPandas(compute, stored.schema)
    held = stored.join(wanted.select(*keys), keys, "left_semi").withColumn("origin", F.lit("stored"))
    return held.unionByName(fresh.withColumn("origin", F.lit("computed"))), upsert(stored, fresh, keys[0])


def digest_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a remote model: a share of one from the digest of the text."""
    for b in batches:
        value = b["text"].map(lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16) / 2**32)
        yield b[KEYS].assign(value=value)


CACHED = """a AS (SELECT doc_id AS id, 'm2' AS model, 4 AS dimension, sha256(coalesce(text, '')) AS input, ('0x' || md5(coalesce(text, ''))[1:8])::BIGINT / 4294967296 AS fresh FROM documents),
c AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN id % 11 = 0 THEN 8 ELSE 4 END AS dimension, CASE WHEN id % 10 = 0 THEN 'old' ELSE input END AS input, 2.0::DOUBLE AS value FROM a WHERE id % 3 <> 0)"""


def cached_values(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("m2").alias("model"), F.lit(4).alias("dimension"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("input"), "text")
    i = F.col("id")
    stored = wanted.filter(i % 3 != 0).select(
        "id", F.when(i % 7 == 0, "m1").otherwise("m2").alias("model"), F.when(i % 11 == 0, 8).otherwise(4).alias("dimension"), F.when(i % 10 == 0, "old").otherwise(F.col("input")).alias("input"), F.lit(2.0).alias("value")
    )
    return through_cache(wanted, stored, KEYS, digest_values)


@query("K9_cached_or_computed", f"WITH {CACHED} SELECT a.id, a.input, CASE WHEN c.id IS NULL THEN 'computed' ELSE 'stored' END AS origin, round(coalesce(c.value, fresh), 9) AS value FROM a LEFT JOIN c USING (id, model, dimension, input)")
def k9_values(spark, sf):
    return cached_values(spark, sf)[0].select("id", "input", "origin", F.round("value", 9).alias("value"))


@query("K9_written_back", f"WITH {CACHED} SELECT a.id, a.model, a.dimension, a.input, round(coalesce(c.value, fresh), 9) AS value FROM a LEFT JOIN c USING (id, model, dimension, input)")
def k9_store(spark, sf):
    return cached_values(spark, sf)[1].select("id", "model", "dimension", "input", F.round("value", 9).alias("value"))


def assigned(interests: DataFrame, answers: DataFrame, most: int = 60) -> DataFrame:
    """id, category, new of the interests (id, name, category) without a category that the answers (place, interest, category) give
    one: the first answer of 1 to ``most`` characters counts; names match in any case, of equal names the last interest is meant;
    an existing category keeps its spelling."""
    existing = interests.filter("category IS NOT NULL").groupBy(F.lower("category").alias("__key")).agg(F.max("category").alias("__known"))
    pending = interests.filter("category IS NULL").groupBy(F.lower("name").alias("__name")).agg(F.max("id").alias("id"))
    said = answers.select("place", F.lower(F.trim("interest")).alias("__name"), F.trim("category").alias("category")).filter(F.length("category").between(1, most))
    first = said.groupBy("__name").agg(F.min_by("category", "place").alias("category"))
    rows = pending.join(first, "__name").withColumn("__key", F.lower("category")).join(existing, "__key", "left")
    return rows.select("id", F.coalesce("__known", "category").alias("category"), F.col("__known").isNull().alias("new"))


@query("K26_reused_spelling", """WITH i AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey % 50 AS name, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS category FROM part), e AS (SELECT lower(category) AS key, max(category) AS known FROM i WHERE category IS NOT NULL GROUP BY 1), p AS (SELECT lower(name) AS name, max(id) AS id FROM i WHERE category IS NULL GROUP BY 1),
a AS (SELECT lower(p_name || ' ' || p_partkey % 50) AS name, l_orderkey, l_linenumber, p_partkey, trim(CASE l_linenumber % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN '  ' ELSE p_type END) AS c FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT name, arg_min(c, (l_orderkey, l_linenumber, p_partkey)) AS c FROM a WHERE length(c) BETWEEN 1 AND 60 GROUP BY 1)
SELECT id, coalesce(known, c) AS category, known IS NULL AS new FROM p JOIN f USING (name) LEFT JOIN e ON key = lower(c)""")  # fmt: skip
def k26_reused(spark, sf):
    name = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), "p_brand", "p_type")
    n = F.col("l_linenumber") % 3
    answers = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("id")).select(
        F.struct("l_orderkey", "l_linenumber", "id").alias("place"), F.concat(F.lit(" "), F.upper("name")).alias("interest"), F.when(n == 0, F.upper("p_brand")).when(n == 1, "  ").otherwise(F.concat("p_type", F.lit(" "))).alias("category")
    )
    return assigned(part.select("id", "name", F.when(F.col("id") % 4 == 0, F.col("p_brand")).alias("category")), answers)


@query("S5_unescaped_bodies", "SELECT conv_id, turn, trim(text) AS text FROM conversations")
def s5_unescaped(spark, sf):
    """Bodies that were escaped come back as they were."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(unescaped(escaped(F.col("text"), quotes=True))).alias("text"))
