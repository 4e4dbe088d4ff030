"""Entities, tags, cuts and display forms of texts, as Column expressions without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.columns import bound

# Entities with a name.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
# What is read in bodies that were escaped twice, in this order.
TWICE = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x200B;", ""), ("&nbsp;", " "), ("&amp;", "&")]
# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# What readers see for a token of an assessment; other tokens are shown with spaces.
LABELS = {
    "software_engineering": "Software engineering", "ai_ml": "AI & ML", "science_space": "Science & space", "culture_arts": "Culture & arts",
    "books_writing": "Books & writing", "games": "Games", "hardware": "Hardware", "internet_web": "Internet & web", "business_economics": "Business & economics",
    "politics_policy": "Politics & policy", "boston_new_england": "Boston & New England", "outdoors_lifestyle": "Outdoors & lifestyle", "history": "History",
    "reported_news": "Reported", "analysis_essay": "Analysis", "how_to_technical": "How-to", "first_hand_account": "First person", "announcement_roundup": "Announcement",
    "code_repository": "Code", "documentation_reference": "Documentation", "tool_or_product_page": "Product page", "discussion_thread": "Discussion",
    "paper_or_report": "Paper", "interview_or_transcript": "Interview", "video_or_podcast": "Video or podcast", "fiction_or_humor": "Fiction & humor",
}

ENTITY = r"&(?:" + "|".join(NAMED) + r"|#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8});"
"""An entity whose semicolon stands within the first twelve bytes."""
WHOLE = r"""<(?!!--)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = rf"(?s)<!--.*?-->|{WHOLE}|<.*"
"""A comment, a tag with its quoted values, or all that follows a tag that never ends."""
ATTRIBUTE = r"""[^\s=/]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""


def rewritten(text: Column, pattern: str, rule: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` replaced by what ``rule`` makes of it; what stands between stays."""
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rule), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern), found, lambda between, mark: F.concat(between, mark)), "")


def entities_decoded(text: Column) -> Column:
    """Six named and all numeric entities as their signs, once; others, and numbers of no character, stay as they are."""

    def sign(mark: Column) -> Column:
        digits, hexa = (F.nullif(F.regexp_extract(mark, p, 1), F.lit("")) for p in (r"^&#(\d+);", r"^&#[xX]([0-9a-fA-F]+);"))
        n = F.coalesce(digits.cast("long"), F.conv(hexa, 16, 10).cast("long"))
        char = bound(n, lambda k: F.when(k.between(0, 0x10FFFF) & ~k.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")))
        named = F.coalesce(*[F.when(mark == f"&{name};", s) for name, s in NAMED.items()])
        return F.coalesce(named, char, mark)

    return rewritten(text, ENTITY, sign)


def escaped(text: Column, quotes: bool = False) -> Column:
    """``text`` for the body of markup; with ``quotes`` for an attribute between double quotes."""
    for sign, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else []):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    """Markup out of a body that was escaped twice."""
    for entity, sign in TWICE:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</*([^\s/>]*)", 1))


def tags(html: Column) -> Column:
    """Start tags in their order, quoted values respected; comments, end tags and a tag that never ends are none."""
    return F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.rlike(rf"^(?=<[a-zA-Z]){WHOLE}\z"))


def attributes(tag: Column) -> Column:
    """Structs (name, value) of a tag in their order; names in lower case, values without quotes and with entities decoded, empty
    without one."""
    inside = F.regexp_replace(F.regexp_replace(tag, r"^</?[^\s>]*", ""), r">\z", "")

    def pair(a: Column) -> Column:
        v = F.regexp_extract(a, r"(?s)^[^\s=/]+\s*=\s*(.*)\z", 1)
        bare = F.when(v.rlike("""^["']"""), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.struct(F.lower(F.regexp_extract(a, r"^([^\s=/]+)", 1)).alias("name"), entities_decoded(bare).alias("value"))

    return F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0)), pair)


def closed_voids(html: Column) -> Column:
    """Markup whose elements without an end tag close themselves, and without the one entity that XML doesn't know."""

    def closing(tag: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(tag, r"^<", ""), r"\s*>\z", "")
        return F.when(tag_name(tag).isin(VOID) & tag.rlike(rf"^{WHOLE}\z") & ~F.endswith(inner, F.lit("/")), F.concat(F.lit("<"), inner, F.lit("/>"))).otherwise(tag)

    return F.replace(rewritten(html, TAG, closing), F.lit("&nbsp;"), F.lit("&#160;"))


def first_words(text: Column, most: int) -> Column:
    """The first words, one blank between them, with an ellipsis if more follow."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return bound(words, lambda w: F.concat(F.array_join(F.slice(w, 1, most), " "), F.when(F.size(w) > most, "…").otherwise("")))


def first_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that splits no character."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def first_tokens(text: Column, most: int) -> Column:
    """About ``most`` tokens of four bytes, cut at the last blank, with an ellipsis if anything is left out."""
    return F.when(F.octet_length(text) <= 4 * most, text).otherwise(F.concat(F.regexp_replace(first_bytes(text, 4 * most), r" [^ ]*\z", ""), F.lit("…")))


def first_characters(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def one_place(value: Column, unit: str) -> Column:
    return F.format_string(f"%.1f {unit}", F.bround(value, 1))


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, one decimal place from KB on."""
    k = 1024.0
    return F.when(n >= k**3, one_place(n / k**3, "GB")).when(n >= k**2, one_place(n / k**2, "MB")).when(n >= k, one_place(n / k, "KB")).otherwise(F.format_string("%d B", n))


def download_size(n: Column) -> Column:
    """Bytes as MB with one decimal place, or as whole KB, rounded up."""
    return F.when(n >= 1024**2, one_place(n / 1024.0**2, "MB")).otherwise(F.format_string("%d KB", F.ceil(n / 1024.0)))


def percent_encoded(part: Column) -> Column:
    """A segment of a path: all but letters, digits and -._~ as bytes."""
    done = F.url_encode(part)
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        done = F.replace(done, F.lit(sign), F.lit(code))
    return done


def took(seconds: Column) -> Column:
    """23m12s, or 48s below a minute; negative counts as none."""
    return bound(F.greatest(seconds, F.lit(0)).cast("long"), lambda s: F.when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s)))


def label(token: Column) -> Column:
    """What readers see for a token; nothing for the token that says nothing."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(token != "other", F.coalesce(F.element_at(known, token), F.replace(token, F.lit("_"), F.lit(" "))))
