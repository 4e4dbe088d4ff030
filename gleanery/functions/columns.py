"""Scalar rules as Column expressions, all inside code generation or higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Query parameters that only track, beside all that begin with utm_.
TRACKING_NAMES = ["ref", "fbclid", "gclid", "s", "si", "mc_cid", "mc_eid"]
# Phrases that mark a title as a round-up.
ROUNDUP_PHRASES = [
    "link roundup", "links for", "weekly digest", "release notes", "changelog", "sponsored", "this week in", "linkdump", "link dump", "weekly roundup", "roundup:",
    "in case you missed it", "what we're reading", "sponsor post", "now available", "is now generally available", "release candidate", "patch notes", "job board",
    "who's hiring", "newsletter #", "digest #",
]
# Hosts and path endings that are never articles.
MEDIA_HOSTS = ["youtube.com", "www.youtube.com", "youtu.be", "vimeo.com", "open.spotify.com", "podcasts.apple.com"]
MEDIA_ENDINGS = [".mp3", ".m4a", ".m4v", ".mp4", ".ogg", ".oga", ".opus", ".wav", ".flac", ".aac", ".mov", ".webm", ".mkv"]


def roundup_title(title: Column) -> Column:
    """One of the phrases stands in the title, in any case; false without a title."""
    return F.coalesce(F.lower(title), F.lit("")).rlike("|".join(ROUNDUP_PHRASES))


def word_count(text: Column) -> Column:
    """Tokens between white space that hold a letter or digit."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def title_key(title: Column) -> Column:
    """Letters and digits of a title, lower case; null if too short to identify it (12 bytes)."""
    key = F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]", ""))
    return F.when(F.octet_length(key) >= 12, key)


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def under_domain(name: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))


def plain_text(html: Column) -> Column:
    """Text of markup without scripts and styles; eight common entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&mdash;", "—")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is computed once, however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def decoded(part: Column) -> Column:
    """A form-encoded part of a query as text; one that can't be decoded as it is."""
    return F.coalesce(F.try_url_decode(part), part)


def query_pairs(url: Column) -> Column:
    """Structs (k, v) of the parameters of an address, decoded, in order."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))


WEB = r"(?i)^https?://[^/?#\s]+"


def unwrapped(url: Column) -> Column:
    """The address that a known redirector names in its query or path, else the address itself."""
    name = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    news = (name == "news.google.com") | F.endswith(name, F.lit(".news.google.com")) | (name == "news.url.google.com")
    search = name.isin("www.google.com", "google.com") & (path == "/url")
    named = F.get(F.filter(query_pairs(url), lambda p: p["k"].isin("url", "q")), F.lit(0))["v"]
    in_path = F.when(name.isin("scour.ing", "www.scour.ing") & F.startswith(path, F.lit("/r/rss/")), decoded(F.replace(F.substring(path, 8, 1 << 20), F.lit("+"), F.lit("%2B"))))
    target = F.trim(F.coalesce(in_path, F.when(news | search, named)))
    return F.when(target.rlike(WEB), target).otherwise(url)


def canonical_url(url: Column) -> Column:
    """An http(s) address with a lower-cased host, without default port, fragment, tracking parameters and trailing slashes; the
    other parameters are encoded anew in their order; up to three redirectors are unwrapped. Null for anything else."""

    def rebuilt(u: Column) -> Column:
        head = F.lower(F.regexp_extract(u, WEB.replace("(?i)^", "(?i)^(") + ")", 1))
        head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
        path = F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
        wanted = F.filter(query_pairs(u), lambda p: ~F.lower(p["k"]).isin(TRACKING_NAMES) & ~F.startswith(F.lower(p["k"]), F.lit("utm_")))
        kept = F.array_join(F.transform(wanted, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
        return F.when(u.rlike(WEB), F.concat(head, F.when((path == "") & (kept != ""), "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))

    return bound(bound(bound(bound(F.trim(url), unwrapped), unwrapped), unwrapped), rebuilt)


def age_days(then: Column, now: Column) -> Column:
    """Whole seconds since ``then``, never negative, in days."""
    return F.greatest(F.timestamp_diff("SECOND", F.date_trunc("second", then), now), F.lit(0)) / F.lit(86400.0)


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life) if half_life > 0 else F.lit(1.0)


def gate(n: Column, floor: float, full: float) -> Column:
    """0 up to ``floor``, 1 from ``full`` on, a ramp between."""
    return F.when(n <= floor, 0.0).when(n >= full, 1.0).otherwise((n - floor) / (full - floor))


def long_form(words: Column, excerpt: Column, roundup: Column) -> Column:
    """Points for length, less those for an excerpt and a round-up."""
    share = F.least(F.greatest((words - 300) / 2200.0, F.lit(0.0)), F.lit(1.0))
    return 35 * F.pow(share, F.lit(0.65)) - F.when(excerpt, 20.0).otherwise(0.0) - F.when(roundup, 15.0).otherwise(0.0)


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.ceil(words / 220), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product of double arrays of one length; null if lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the values that are present, by their weights; null if none is."""
    used = [(v, w) for v, w in parts if w > 0]
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in used), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in used), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def paywalled(words: Column, blocked_host: Column) -> Column:
    return F.when(words < 120, True).when(words >= 400, False).otherwise(blocked_host)


def sample_words(text: Column, whole: int = 1500, head: int = 600, middle: int = 500, tail: int = 400) -> Column:
    """A text of at most ``whole`` words as it is; of a longer one the beginning, middle and end."""
    words = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    n = F.size(words)
    cut = F.concat(F.slice(words, 1, head), F.slice(words, ((n - middle) / 2).cast("int") + 1, middle), F.slice(words, n - tail + 1, tail))
    return F.array_join(F.when(n <= whole, words).otherwise(cut), " ")
