"""Markup for a small reader that wraps no long words, ignores style sheets and folds white space, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.columns import bound
from gleanery.functions.markup import TAG, WHOLE, rewritten

# Attributes by which a document lays itself out.
LAYOUT = ["style", "align", "width", "height", "srcset", "sizes", "loading", "hspace", "vspace", "border"]
# Fixed value: the longest word that is laid out whole, in units; a character or a reference is one.
LONGEST_WORD = 200
SOFT_HYPHEN, NO_BREAK = "\u00ad", "\u00a0"

BLANK = r"[ \t\n\f\r]"
AFTER = r"[ \t\n\r>/]"
ATTRIBUTE_PART = rf"""\G{BLANK}*+(?![>/])(?=.)[^ \t\n\f\r=>/]*+(?:{BLANK}*+={BLANK}*+(?:"[^"]*+"?|'[^']*+'?|[^ \t\n\f\r>]*+))?"""
"""An attribute and the white space before it; the first slash or end of the tag ends the row of them."""
CODE = rf"""<(script|style)(?={AFTER})(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?=</\1)"""
TOKEN = rf"(?si){CODE}|{TAG.removeprefix('(?s)')}|[^<]+"
"""A start tag of code with all the code, a comment, a tag, what follows a tag that never ends, or text; only text begins without <."""
PRE, END_OF_PRE, TRANSPARENT, LINE_BREAK = rf"(?i)^<pre{AFTER}", rf"(?i)^</pre{AFTER}", rf"(?i)^<(pre|code|br){AFTER}", rf"(?i)^<(pre|br){AFTER}"
ATOM = r"(?s)\r\n|[\r\n\t]| +|[^ \t\r\n].*?(?= *(?:[\t\r\n]|\z)|  )"
"""A line break, a tab, spaces, or words with one space between them, in preformatted text."""
UNITS = rf"(?:(?<![^\p{{IsWhite_Space}}])|\G)((?>(?>&[^;\p{{IsWhite_Space}}\P{{ASCII}}]{{0,14}};|[^\p{{IsWhite_Space}}]){{{LONGEST_WORD}}}))(?=[^\p{{IsWhite_Space}}])"


def without_attributes(html: Column, names: list[str] = LAYOUT) -> Column:
    """``html`` without these attributes of its start tags, all else letter by letter. What follows a slash in a tag stays, and so
    does a tag that never ends."""

    def kept(tag: Column) -> Column:
        head = F.regexp_extract(tag, r"^<[^ \t\n\f\r>]*", 0)
        inside = F.substr(tag, F.length(head) + 1)

        def joined(parts: Column) -> Column:
            stay = F.filter(parts, lambda a: ~F.lower(F.regexp_extract(a, rf"^{BLANK}*([^ \t\n\f\r=>/]*)", 1)).isin(names))
            return F.concat(head, F.array_join(stay, ""), F.substr(inside, F.length(F.array_join(parts, "")) + 1))

        whole = tag.rlike(rf"(?s)^(?=<[^!?/]){WHOLE}\z")
        return F.when(whole, bound(F.regexp_extract_all(inside, F.lit("(?s)" + ATTRIBUTE_PART), F.lit(0)), joined)).otherwise(tag)

    return rewritten(html, TAG, kept)


def softened(text: Column) -> Column:
    """``text`` with a soft hyphen after every 200 units of a word that goes on. A reference in ASCII of at most 16 bytes is one unit."""
    return F.regexp_replace(text, UNITS, "$1" + SOFT_HYPHEN)


def stretches(tokens: Column, begins: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """``tokens`` cut before each one that ``begins`` a stretch, with ``rule`` applied to every stretch (an array), joined again; the work
    grows with the number of tokens, whatever the number of stretches."""

    def cut(at: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: rule(F.slice(tokens, F.get(at, k - 1), F.get(at, k) - F.get(at, k - 1)))))

    def edges(marks: Column) -> Column:
        inner = F.filter(marks, lambda m: m > 1)
        return F.concat(F.array(F.lit(1)), inner, F.array(F.size(tokens) + 1))

    marks = F.filter(F.transform(tokens, lambda t, i: F.when(begins(t), i + 1)), lambda m: m.isNotNull())
    return F.when(F.size(tokens) > 0, bound(edges(marks), cut)).otherwise(tokens)


def explicit_white_space(block: Column) -> Column:
    """The tokens of a preformatted stretch, its start tag first, with line breaks as elements, tabs as four no-break spaces, and spaces
    that begin a line or stand together as no-break spaces. A line break right after the start tag is none."""

    def opened(first: Column) -> Column:
        cut = lambda t, i: F.when((i + 1 == first) & ~F.startswith(t, F.lit("<")), F.regexp_replace(t, r"^(?:\r\n|[\r\n])", "")).otherwise(t)
        return F.transform(block, cut)

    first = F.array_position(F.transform(block, lambda t: t.rlike(TRANSPARENT)), F.lit(False))
    atoms = lambda t: F.when(F.startswith(t, F.lit("<")), F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(ATOM), F.lit(0)))
    breaks = lambda t: t.rlike(LINE_BREAK) | t.rlike(r"^[\r\n]")
    word = lambda t: ~t.rlike(r"^[<\r\n\t ]")

    def line(part: Column) -> Column:
        fresh = breaks(F.get(part, F.lit(0)))

        def shown(t: Column) -> Column:
            spaces = F.when(fresh | (F.length(t) > 1), F.repeat(F.lit(NO_BREAK), F.length(t))).otherwise(t)
            return F.when(t.rlike(r"^[\r\n]"), "<br/>").when(t == "\t", NO_BREAK * 4).when(F.startswith(t, F.lit(" ")), spaces).when(word(t), softened(t)).otherwise(t)

        return F.transform(part, shown)

    return bound(F.flatten(F.transform(bound(first, opened), atoms)), lambda a: stretches(a, lambda t: breaks(t) | word(t), line))


def for_device(html: Column) -> Column:
    """``html`` without layout attributes, with soft hyphens in words over 200 units and with explicit white space in preformatted text.
    Comments and code stay as they are; preformatted text ends with the first end tag, or with the page. A null stays null."""

    def rule(part: Column) -> Column:
        plain = F.transform(part, lambda t: F.when(F.startswith(t, F.lit("<")), t).otherwise(softened(t)))
        return F.when(F.get(part, F.lit(0)).rlike(PRE), explicit_white_space(part)).otherwise(plain)

    tokens = F.regexp_extract_all(without_attributes(html), F.lit(TOKEN), F.lit(0))
    return F.array_join(bound(tokens, lambda t: stretches(t, lambda x: x.rlike(PRE) | x.rlike(END_OF_PRE), rule)), "")
