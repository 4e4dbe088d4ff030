"""What comes into the store: chosen bodies, imported ratings, a discovery pass over hosts, and what calls have cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import canonical_url, host, paywalled, under_domain, word_count
from gleanery.operators.ranking import numbered

# A body of so many words is a full text; what is said below an excerpt.
FULL_TEXT, EXCERPT_NOTE = 250, "(excerpt only — read online)"
# How long a look at a host holds, how many of its feeds are kept, how many hosts a pass looks up.
RECHECK_DAYS, FEEDS_OF_A_HOST, LOOKUPS = 90, 3, 30


def chosen_body(feed: Column, feed_words: Column, page: Column, page_words: Column, blocked_host: Column) -> Column:
    """A struct (body, method, words, excerpt_only): the body of the feed if it is a full text, else the page if that has more words, else
    the body of the feed with a note below, which is added once however often the choice is made. A null page was not fetched; a null
    body or one of blanks, no-break ones included, gives the note alone."""
    own, note = F.coalesce(feed, F.lit("")), F.lit(f"<p>{EXCERPT_NOTE}</p>")
    blank, noted, added = ~own.rlike(r"\P{Zs}"), F.contains(own, F.lit(EXCERPT_NOTE)), word_count(F.lit(EXCERPT_NOTE))
    excerpt = F.when(blank, note).when(noted, own).otherwise(F.concat(own, note))
    below = F.when(blank, added).when(noted, feed_words).otherwise(feed_words + added)

    def chosen(body: Column, method: str, n: Column) -> Column:
        return F.struct(body.alias("body"), F.lit(method).alias("method"), n.cast("long").alias("words"), (F.lit(method == "excerpt") | paywalled(n, blocked_host)).alias("excerpt_only"))

    better = page.isNotNull() & F.coalesce(page_words > feed_words, F.lit(False))
    return F.when(feed_words >= FULL_TEXT, chosen(own, "feed", feed_words)).when(better, chosen(page, "page", page_words)).otherwise(chosen(excerpt, "excerpt", below))


@dataclass(frozen=True)
class Imported:
    """``requests``: request, status, message, article_id, created. ``articles``: article_id, url of the articles that were inserted.
    ``events``: article_id, label, note of the ratings to append."""

    requests: DataFrame
    articles: DataFrame
    events: DataFrame


def import_ratings(queue: DataFrame, stored: DataFrame, pages: DataFrame, embedded: DataFrame, labels: list[str]) -> Imported:
    """Ratings of a queue (request, url, label, note) against stored (article_id, url): an address is one article by its canonical form,
    the least id if several have it. One that isn't stored is inserted from pages (url), where that has it, by its first request; ids
    go on behind the largest, in the order of these requests. A rating counts if its label is one of ``labels``; an article that a
    request with another label has inserted stays. Requests fail on addresses that aren't of the web, pages that can't be had and
    unknown labels, in this order. ``embedded`` (article_id) are those with a vector. Hot addresses meet one row of a distinct table."""
    wanted = queue.withColumn("canonical", canonical_url(F.col("url")))
    known = stored.withColumn("canonical", canonical_url(F.col("url"))).filter("canonical IS NOT NULL").groupBy("canonical").agg(F.min("article_id").alias("stored_id"))
    had = pages.select(canonical_url(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL").distinct()
    first = wanted.filter("canonical IS NOT NULL").groupBy("canonical").agg(F.min("request").alias("first"))
    missing = first.join(known, "canonical", "left_anti").join(had, "canonical", "left_semi")
    last = stored.agg(F.coalesce(F.max("article_id"), F.lit(0)).alias("last"))  # one row
    inserted = numbered(missing, "first").join(F.broadcast(last)).select("canonical", "first", (F.col("last") + F.col("n")).alias("new_id"))
    found = wanted.join(known, "canonical", "left").join(inserted, "canonical", "left")
    found = found.withColumn("article_id", F.coalesce("stored_id", "new_id")).withColumn("created", F.coalesce(F.col("request") == F.col("first"), F.lit(False)))
    ok = F.col("article_id").isNotNull() & F.col("label").isin(labels)
    vectors = embedded.select("article_id", F.lit(True).alias("vector")).distinct()
    said = F.concat(F.when(F.col("created"), "created").otherwise("existing article"), F.when(F.col("vector"), " + embedded").otherwise("; no embedding"))
    why = F.when(F.col("canonical").isNull(), "invalid URL").when(F.col("article_id").isNull(), "no page").otherwise("unknown label")
    done = found.join(vectors, "article_id", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
    requests = done.select(
        "request", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), F.when(F.col("ok"), said).otherwise(why).alias("message"),
        F.when(F.col("ok"), F.col("article_id")).alias("article_id"), (F.col("ok") & F.col("created")).alias("created"),
    )
    return Imported(requests, inserted.select(F.col("new_id").alias("article_id"), F.col("canonical").alias("url")), done.filter("ok").select("request", "article_id", "label", "note"))


@dataclass(frozen=True)
class Discovery:
    """``queue``: host, url, score, articles of the hosts to look up. ``links``: host, feed_url, article_id, reused."""

    queue: DataFrame
    links: DataFrame


def kept_feeds(found: DataFrame) -> DataFrame:
    """host, feed_url of at most three of each host's feeds from (host, place, feed_url, title, kind, guess): one for each title, the
    first that isn't JSON if there is one, in the order of their first places, then the first guess of a path."""
    form = F.struct(F.coalesce(F.lower("kind") == "json", F.lit(False)).alias("json"), "place")
    titled = found.filter("NOT guess").groupBy("host", "title").agg(F.min_by("feed_url", form).alias("feed_url"), F.min("place").alias("place"))
    guessed = found.filter("guess").groupBy("host").agg(F.min_by("feed_url", "place").alias("feed_url"), F.min("place").alias("place"))
    both = titled.select("host", "feed_url", "place", F.lit(0).alias("last")).union(guessed.select("host", "feed_url", "place", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("last", "place", "feed_url"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= FEEDS_OF_A_HOST).select("host", "feed_url")


def discovery_pass(
    articles: DataFrame, subscribed: DataFrame, memo: DataFrame, known: DataFrame, found: DataFrame, now: Column, skip: list[str] = [], most: int = LOOKUPS, days: int = RECHECK_DAYS  # noqa: B006
) -> Discovery:
    """A pass over articles (article_id, url, score, aggregator_only): those that only aggregators carried, by host, without hosts below
    ``skip`` and subscribed ones (host). A host that memo (host, checked_at) knows from the last ``days`` days links its articles with the
    known feeds (host, feed_url); the ``most`` best others are looked up, by their best score, then by name, and link theirs with the feeds
    that are kept of those found. The link goes to an article for each feed, at most three; the address to look up is that of the best
    article, the least id among equals. Articles without a web address go; a null score counts as 0."""
    mine = articles.filter("aggregator_only").withColumn("host", host(F.col("url"))).filter(F.coalesce(F.col("host"), F.lit("")) != "").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if skip:
        mine = mine.filter(~under_domain(F.col("host"), skip))
    mine = mine.join(subscribed.select("host").distinct(), "host", "left_anti")
    since = now - F.make_dt_interval(F.lit(days))
    fresh = memo.filter(F.col("checked_at") >= since).select("host").distinct()
    best = F.max_by("url", F.struct("score", (-F.col("article_id")).alias("id")))
    hosts = mine.groupBy("host").agg(best.alias("url"), F.max("score").alias("score"), F.count("*").alias("articles"))
    queue = hosts.join(fresh, "host", "left_anti").orderBy(F.desc("score"), "host").limit(most)
    new = kept_feeds(found.join(F.broadcast(queue.select("host")), "host"))  # at most three rows for each of the hosts looked up
    old = known.join(fresh, "host", "left_semi").select("host", "feed_url").distinct()
    links = mine.join(F.broadcast(new), "host").select("host", "feed_url", "article_id", F.lit(False).alias("reused"))
    return Discovery(queue, links.union(mine.join(old, "host").select("host", "feed_url", "article_id", F.lit(True))))


COUNTERS = ["input", "cache_read", "cache_write", "output"]


def usage_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """provider, calls, the four counters, cost from calls (provider and counters) and prices (provider and dollars for a million of each
    counter); a null counter counts none, a provider without prices costs nothing, and calls without a provider stand together. Where
    there are calls, the row whose ``total`` is true adds all providers up. Counters are added before the prices are joined."""
    used = calls.groupBy("provider").agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    price = prices.select("provider", *[F.col(c).alias(f"p_{c}") for c in COUNTERS])
    cost = sum((F.col(c) * F.coalesce(f"p_{c}", F.lit(0.0)) / 1e6 for c in COUNTERS), F.lit(0.0))
    each = used.join(F.broadcast(price), "provider", "left").withColumn("cost", cost).select("provider", "calls", *COUNTERS, "cost")  # prices are a list of settings
    sums = [F.sum(c).alias(c) for c in ("calls", *COUNTERS, "cost")]
    return each.rollup("provider").agg(*sums, (F.grouping("provider") == 1).alias("total"))
