"""License scans by an exact set-similarity join, with DataFrame functions only.

A text block matches a license template when it holds at least ``threshold`` of the template's distinct words. Blocks are
runs of words, whatever the line breaks: of 32 words for templates of up to 16, of 256 for templates of up to 128, each
starting half a block after the one before, so that any run of up to half a block lies whole in one of them. Tokens are
put in one order, the rarest in the corpus first (counted over all documents, ties by token). With o = ceil(threshold * |template|) the overlap that is needed, a pair can only match if

* the block has at least o template words (length filter),
* the first common token stands among the first |template| - o + 1 tokens of the template and the first |block| - o + 1
  of the block (prefix filter), and
* what follows that token on either side is long enough to reach o (positional filter).

Pairs that pass are verified by their whole overlap, so the result is exact. Beside it, fixed phrases are looked up as
consecutive words.

One pass counts template words, a second writes the figures of each document with the blocks that hold a prefix token, and
the join runs over those blocks; texts are never shuffled. What reaches the driver or is broadcast has the size of the
templates, whatever the input.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned once each; a null
doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.9
SPANS = (32, 256)

# The phrases that always count, and the notices that the join looks for, in the words of the licenses.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("agpl", "this work is licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("public-domain", "this work has been released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in"
        " binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other"
        " materials provided with the distribution",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without"
        " warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
        " software foundation either version 3 of the license or at your option any later version",
    ),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(text: Column) -> Column:
    """The words of a lower-cased text, with one space between them."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def any_word(words: list[str]) -> str:
    """A pattern for any of the words, whole, in a lower-cased text."""
    around = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    return f"(?:^|{around})(?:{'|'.join(sorted(words))})(?:{around}|$)"


def token_ranks(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Place of each token in the global order: the rarest in the corpus first."""
    word = F.explode(F.split(lowered(F.col("text")), GAP)).alias("token")
    counts = {r["token"]: r["n"] for r in docs.select(word).filter(F.col("token").isin(tokens)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}


def span_of(template: str) -> int:
    """Words of the blocks that a template is compared with."""
    return next(s for s in SPANS if 2 * len(template.split()) <= s)


def word_blocks(words: Column, heads: dict[int, list[str]], vocabulary: list[str]) -> Column:
    """Structs (span, tokens) of the blocks of an array of words that hold one of the ``heads`` of their span; tokens are the
    distinct template words of the block."""
    known = F.array(*map(F.lit, vocabulary))

    def of(ws: Column, span: int) -> Column:
        steps = F.greatest(F.ceil(F.size(ws) * 2 / span) - 2, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), steps.cast("int")), lambda k: F.slice(ws, k * (span // 2) + 1, F.lit(span)))
        cut = F.filter(cut, lambda b: F.arrays_overlap(b, F.array(*map(F.lit, heads[span]))))
        return F.transform(cut, lambda b: F.struct(F.lit(span).alias("span"), F.array_intersect(b, known).alias("tokens")))

    # the array is bound once, so that it isn't cut anew for every block
    return F.get(F.transform(F.array(words), lambda ws: F.array_distinct(F.concat(*[of(ws, s) for s in heads]))), F.lit(0))


def phrase_figures(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels (an array) to rows with ``__lower``."""
    words = spaced(F.col("__lower"))
    out = docs.withColumn("__words", words).withColumn("n_words", F.when(F.col("__words") == "", 0).otherwise(spaces(F.col("__words")) + 1).cast("long"))
    out = out.withColumn("__words", F.concat(F.lit(" "), "__words", F.lit(" ")))
    found = []
    for i, (label, phrase) in enumerate(phrases.items()):
        # cut before each place; only the space in front of it is taken, so places may overlap
        out = out.withColumn(f"__cut{i}", F.when(F.contains("__words", F.lit(f" {phrase} ")), F.split("__words", f" (?={phrase} )")))
        cut = F.col(f"__cut{i}")
        found.append((label, F.coalesce(F.size(cut) - 1, F.lit(0)), spaces(F.get(cut, F.lit(0))), F.col("n_words") - spaces(F.element_at(cut, -1))))
    counts, firsts, lasts = ([x[k] for x in found] for k in (1, 2, 3))
    edge = lambda of, all_: of(*all_) if len(all_) > 1 else all_[0]
    labels = F.filter(F.array(*[F.when(n > 0, F.lit(label)) for label, n, _, _ in found]), lambda x: x.isNotNull())
    return out.withColumns(
        {
            "n_base": reduce(Column.__add__, counts).cast("long"),
            "first_word": edge(F.least, firsts).cast("long"),
            "last_word": edge(F.greatest, lasts).cast("long"),
            "base_labels": F.array_sort(F.array_distinct(labels)),
        }
    ).drop("__words", *[f"__cut{i}" for i in range(len(found))])


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 with a base label, else the largest
    share of a matching template that a block holds, else 0."""
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(text.split())), span_of(text)) for i, (label, text) in enumerate(templates)]
    vocabulary = sorted({t for _, _, tokens, _ in sets for t in tokens})
    rank = token_ranks(docs, vocabulary)
    need = {i: math.ceil(threshold * len(tokens) - 1e-9) for i, _, tokens, _ in sets}
    ordered = {i: sorted(tokens, key=rank.get) for i, _, tokens, _ in sets}
    prefixes = {i: tokens[: len(tokens) - need[i] + 1] for i, tokens in ordered.items()}
    heads = {span: sorted({t for i, _, _, s in sets if s == span for t in prefixes[i]}) for span in sorted({s for *_, s in sets})}
    rare = any_word(sorted({t for tokens in heads.values() for t in tokens}))

    base = phrase_figures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("__lower")), phrases)
    blocks = word_blocks(F.split(spaced(F.col("__lower")), " "), heads, vocabulary)
    base = base.withColumn("blocks", F.when(F.col("__lower").rlike(rare), blocks)).drop("__lower")
    base = staged(base.withColumn("at", F.monotonically_increasing_id()), "license-blocks")

    # the template side has a row for each prefix token: as long as the list above, whatever the documents are
    sides = [(rank[t], span, place, i, label, [rank[x] for x in ordered[i]], need[i]) for i, label, _, span in sets for place, t in enumerate(prefixes[i])]
    template = spark.createDataFrame(sides, "token int, span int, t_at int, template int, label string, t_tokens array<int>, need int")
    places = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    block = base.filter(F.size("blocks") > 0).select("at", F.inline("blocks"))
    block = block.select("at", "span", F.array_sort(F.transform("tokens", lambda w: F.try_element_at(places, w))).alias("b_tokens"))
    least = F.create_map(*[F.lit(x) for span in heads for x in (span, min(need[i] for i, _, _, s in sets if s == span))])[F.col("span")]
    first = F.slice("b_tokens", 1, F.greatest(F.size("b_tokens") - least + 1, F.lit(0)))
    probes = block.filter(F.size("b_tokens") >= least).select("at", "span", "b_tokens", F.posexplode(first).alias("b_at", "token"))
    left_b, left_t = F.size("b_tokens") - F.col("b_at"), F.size("t_tokens") - F.col("t_at")
    pairs = probes.join(F.broadcast(template), ["token", "span"]).filter((F.size("b_tokens") >= F.col("need")) & (F.least(left_b, left_t) >= F.col("need")))
    overlap = F.size(F.array_intersect("b_tokens", "t_tokens"))
    matched = pairs.filter(overlap >= F.col("need")).groupBy("at").agg(F.collect_set("label").alias("found"), F.max(overlap / F.size("t_tokens")).alias("share"))

    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return base.join(matched, "at", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def oracle(phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows by comparing every block with every template."""
    words = "regexp_extract_all(translate(coalesce({}, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    longest = max(len(p.split()) for p in phrases.values())
    ahead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, longest))
    tests = " ".join(
        "WHEN " + " AND ".join(f"{'w' if k == 0 else f'w{k}'} = '{w}'" for k, w in enumerate(phrase.split())) + f" THEN '{label}'" for label, phrase in phrases.items()
    )
    rows = ", ".join(f"({i}, '{label}', {span_of(text)}, {sorted(set(text.split()))!r})" for i, (label, text) in enumerate(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {words.format("text")} AS ws, text FROM d),
each AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM words),
near AS (SELECT r, w, i, {ahead} FROM each),
places AS (SELECT r, i, CASE {tests} END AS label FROM near),
base AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, list_sort(list(DISTINCT label)) AS labels FROM places WHERE label IS NOT NULL GROUP BY r),
template(t, label, span, tokens) AS (VALUES {rows}),
told AS (SELECT r, i, w FROM each WHERE w IN (SELECT unnest(tokens) FROM template)),
block AS (SELECT r, s.span, i // (s.span // 2) - o.d AS k, list(DISTINCT w) AS b FROM told, (SELECT DISTINCT span FROM template) s, (VALUES (0), (1)) o(d)
          WHERE i // (s.span // 2) >= o.d GROUP BY ALL),
hit AS (SELECT r, label, len(list_intersect(b, tokens)) / len(tokens) AS share FROM block JOIN template USING (span)
        WHERE len(list_intersect(b, tokens)) >= ceil({threshold} * len(tokens) - 1e-9)),
best AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word, base.l::BIGINT AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""
