"""Credit rates, the signal matrix with its blends, explanations, reports, comment trees, retention, sort menus, publishing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.columns import ROUNDUP_PHRASES, TRACKING_NAMES, age_days, bound, canonical_url, decay, gate, long_form, reading_minutes, roundup_title, under_domain, weighted_mean, word_count
from gleanery.operators.admission import Retriever, admit, lineup
from gleanery.operators.ranking import diversified, leader_clusters, mid_ranks, numbered_within, smoothed_rates, top_k
from gleanery.operators.trees import pruned, within_word_budget
from gleanery.params import RANKING, Ranking
from gleanery.sources.sinks import append, drafts, kept_files, named_by_day, publish, staged
from gleanery.sources.views import NOW, articles, candidates, runs, table, verdicts, with_views

from .catalog import ORACLE, QUERIES, query
from . import costs  # noqa: F401  (its queries are part of the statistics)
from .composites import top_interests
from .lookups import CANONICAL, O12_DAYS
from .reports import HALF_LIFE, latest_verdicts, now
from .signals import KNN, MIDRANK, PAIRS, WORDS, interest_scores, neighbours, rated, rounds_sql

# ---------------------------------------------------------------- credit

AGGREGATOR_SHARE = 0.25
DECAYED = f"value * pow(0.5, greatest(date_diff('second', date_trunc('second', event_at), TIMESTAMP '{NOW}'), 0) / 86400.0 / {HALF_LIFE})"
#: Line items tie articles to feeds; suppliers of every fifth nation are aggregators; two thirds of the articles have an author.
FEEDS = """carried AS (SELECT DISTINCT l_partkey AS article_id, l_suppkey AS feed, s_nationkey % 5 <> 0 AS direct FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
of_article AS (SELECT article_id, CASE WHEN bool_or(direct) THEN list_sort(list(feed) FILTER (direct)) ELSE [min(feed)] END AS feeds, NOT bool_or(direct) AS aggregator_only, CASE WHEN article_id % 3 <> 0 THEN 'writer ' || (article_id % 50) END AS author FROM carried GROUP BY article_id)"""


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, feeds, aggregator_only, author: the feeds that carried an article directly, else one of its aggregators."""
    direct = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5 != 0).alias("direct"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article_id"), "l_suppkey").join(direct, "l_suppkey")
    of = seen.groupBy("article_id").agg(F.array_sort(F.collect_set(F.when(F.col("direct"), F.col("l_suppkey")))).alias("own"), F.min("l_suppkey").alias("any"))
    alone = F.size("own") == 0
    author = F.when(F.col("article_id") % 3 != 0, F.concat(F.lit("writer "), (F.col("article_id") % 50).cast("string")))
    return of.select("article_id", F.when(alone, F.array("any")).otherwise(F.col("own")).alias("feeds"), alone.alias("aggregator_only"), author.alias("author"))


def decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest verdicts with their decayed weight."""
    return latest_verdicts(spark, sf_dir).withColumn("weight", F.col("value") * decay(age_days(F.col("event_at"), now()), HALF_LIFE))


def credit_rates(rated: DataFrame) -> DataFrame:
    """kind, key, n, up, down, rate of feeds and authors from verdicts (weight, feeds, aggregator_only, author): a weight is split
    over the feeds, and counts a quarter where only an aggregator carried the article."""
    share = F.col("weight") * F.when(F.col("aggregator_only"), AGGREGATOR_SHARE).otherwise(1.0) / F.size("feeds")
    feeds = rated.select(F.lit("feed").alias("kind"), F.explode(F.col("feeds").cast("array<string>")).alias("key"), share.alias("credit"))
    authors = rated.filter("author IS NOT NULL").select(F.lit("author").alias("kind"), F.col("author").alias("key"), F.col("weight").alias("credit"))
    return smoothed_rates(feeds.union(authors), ["kind", "key"])


RATES = f"""rated AS (SELECT article_id, {DECAYED} AS weight, feeds, aggregator_only, author FROM latest JOIN of_article USING (article_id)),
credits AS (SELECT 'feed' AS kind, unnest(feeds)::VARCHAR AS key, weight * CASE WHEN aggregator_only THEN {AGGREGATOR_SHARE} ELSE 1 END / len(feeds) AS credit FROM rated UNION ALL SELECT 'author', author, weight FROM rated WHERE author IS NOT NULL),
rates AS (SELECT kind, key, count(*) AS n, sum(greatest(credit, 0)) AS up, sum(greatest(-credit, 0)) AS down, (sum(greatest(credit, 0)) + 1) / (sum(abs(credit)) + 2) AS rate FROM credits GROUP BY 1, 2)"""


@query("A14_feed_and_author_rates", with_views("verdicts latest", f", {FEEDS}, {RATES} SELECT kind, key, n, round(up, 9) AS up, round(down, 9) AS down, round(rate, 9) AS rate FROM rates"))
def a14(spark, sf):
    rates = credit_rates(decayed(spark, sf).join(carriers(spark, sf), "article_id"))
    return rates.select("kind", "key", "n", *[F.round(c, 9).alias(c) for c in ("up", "down", "rate")])


Z_ROWS = f"{PAIRS}, z AS (SELECT *, (score - avg(score) OVER (PARTITION BY right_id)) / greatest(stddev_pop(score) OVER (PARTITION BY right_id), 1e-3) AS z FROM s), top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(z, 9) DESC, right_id) AS rank FROM z) WHERE rank <= 3)"


def interest_rates(ratings: DataFrame, matches: DataFrame) -> DataFrame:
    """right_id, n, up, down, rate, attributable from ratings (article_id, weight) and matches (left_id, right_id, z): the
    weight counts with the strength z / 3, held between 0 and 1; matches without strength count nowhere. ``attributable`` is the
    number of ratings that any match took up."""
    strong = matches.withColumn("strength", F.least(F.greatest(F.col("z") / 3, F.lit(0.0)), F.lit(1.0))).filter("strength > 0")
    joined = ratings.join(strong, ratings["article_id"] == strong["left_id"]).withColumn("credit", F.col("weight") * F.col("strength"))
    taken = joined.agg(F.count_distinct("article_id").alias("attributable"))  # one row
    return smoothed_rates(joined, "right_id").join(F.broadcast(taken))


@query("A15_interest_rates", with_views("verdicts latest", f""", {Z_ROWS}, m AS (SELECT article_id, right_id, {DECAYED} * least(z / 3, 1) AS credit FROM latest JOIN top3 ON left_id = article_id WHERE z > 0)
SELECT right_id, count(*) AS n, round(sum(greatest(credit, 0)), 6) AS up, round(sum(greatest(-credit, 0)), 6) AS down, round((sum(greatest(credit, 0)) + 1) / (sum(abs(credit)) + 2), 6) AS rate, (SELECT count(DISTINCT article_id) FROM m) AS attributable FROM m GROUP BY 1"""))  # fmt: skip
def a15(spark, sf):
    rates = interest_rates(decayed(spark, sf).select("article_id", "weight"), top_interests(spark, sf).select("left_id", "right_id", "z"))
    return rates.select("right_id", "n", *[F.round(c, 6).alias(c) for c in ("up", "down", "rate")], "attributable")


@query("A16_interest_statistics", f"WITH {PAIRS} SELECT right_id, round(avg(score), 9) AS mean, round(greatest(stddev_pop(score), 1e-3), 9) AS std FROM s GROUP BY 1")
def a16(spark, sf):
    return interest_scores(spark, sf).groupBy("right_id").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.greatest(F.stddev_pop("score"), F.lit(1e-3)), 9).alias("std"))


@query("A28_neighbour_usage", with_views("candidates", ", " + KNN.removeprefix("WITH ") + ", stage AS (SELECT article_id, arg_max(stage, run_id) AS stage FROM candidates GROUP BY 1), n AS (SELECT left_id, right_id FROM s QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) <= 3) SELECT right_id, count(DISTINCT left_id) AS listed, count(DISTINCT left_id) FILTER (stage = 'R') AS selected FROM n LEFT JOIN stage ON article_id = left_id GROUP BY 1"))
def a28(spark, sf):
    """For each rated article the candidates that have it among their three nearest, whatever their sign, and how many of them were
    selected. A candidate counts once, however often its row or the rated one is repeated."""
    last = candidates(spark, sf).groupBy(F.col("article_id").alias("left_id")).agg(F.max_by("stage", "run_id").alias("stage"))
    near = top_k(neighbours(spark, sf).drop("rank"), "left_id", [F.desc(F.round("score", 9)), F.asc("right_id")], 3)
    each = near.select("left_id", "right_id").distinct().join(last, "left_id", "left").select("right_id", (F.coalesce("stage", F.lit("")) == "R").alias("hit"))
    return each.groupBy("right_id").agg(F.count("*").alias("listed"), F.count_if("hit").alias("selected"))


# ---------------------------------------------------------------- interest scores

LEAST_ARTICLES, LEAST_Z = 30, 1.0


def interest_matches(scores: DataFrame, cohort: str) -> DataFrame:
    """left_id, score, top1, matches of each article from (left_id, right_id, score, cohort): 0.7 of its best z and 0.3 of the mean of
    its three best; its largest cosine in a cohort of fewer than 30 articles. Matches below 1 go after scoring."""
    stats = scores.groupBy(cohort, "right_id").agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-3)).alias("std"))
    sizes = scores.groupBy(cohort).agg(F.count_distinct("left_id").alias("size"))
    z = scores.join(F.broadcast(stats), [cohort, "right_id"]).withColumn("z", (F.col("score") - F.col("mean")) / F.col("std"))
    top = top_k(z, "left_id", [F.desc(F.round("z", 9)), F.asc("right_id")], 3)
    kept = F.array_sort(F.collect_list(F.when(F.col("z") >= LEAST_Z, F.struct("rank", "right_id"))))
    by = top.groupBy(cohort, "left_id").agg((0.7 * F.max("z") + 0.3 * F.avg("z")).alias("by_z"), F.transform(kept, lambda x: x["right_id"].cast("string")).alias("matches"))
    best = scores.groupBy("left_id").agg(F.max("score").alias("top1"))
    joined = by.join(F.broadcast(sizes), cohort).join(best, "left_id")
    return joined.select("left_id", F.when(F.col("size") < LEAST_ARTICLES, F.col("top1")).otherwise(F.col("by_z")).alias("score"), "top1", "matches")


@query("V7_interest_score", f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN left_id < 50 THEN left_id // 25 ELSE 9 END AS cohort FROM s),
z AS (SELECT *, (score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-3) AS z FROM c WINDOW w AS (PARTITION BY cohort, right_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(z, 9) DESC, right_id) AS rank, max(score) OVER (PARTITION BY left_id) AS top1 FROM z), n AS (SELECT cohort, count(DISTINCT left_id) AS size FROM c GROUP BY 1)
SELECT left_id, round(CASE WHEN any_value(size) < 30 THEN max(top1) ELSE 0.7 * max(z) + 0.3 * avg(z) END, 6) AS score, round(max(top1), 6) AS top1, coalesce(string_agg(right_id::VARCHAR, ',' ORDER BY rank) FILTER (z >= 1), '') AS matches FROM r JOIN n USING (cohort) WHERE rank <= 3 GROUP BY 1""")  # fmt: skip
def v7(spark, sf):
    """The first fifty articles stand for two small cohorts."""
    cohort = F.when(F.col("left_id") < 50, F.floor(F.col("left_id") / 25)).otherwise(9)
    found = interest_matches(interest_scores(spark, sf).withColumn("cohort", cohort), "cohort")
    return found.select("left_id", F.round("score", 6).alias("score"), F.round("top1", 6).alias("top1"), F.array_join("matches", ",").alias("matches"))


# ---------------------------------------------------------------- the matrix, the blend, the utility

SIGNALS = ("interest", "knn", "affinity", "heuristic", "feed", "social")
GATED = ("knn", "affinity", "feed")


def affinities(matches: DataFrame, rates: DataFrame) -> DataFrame:
    """article_id, affinity: the mean of (rate - 0.5) over an article's rated interests, by strength z / 3 held between 0 and 1. Interests
    that nobody rated are left out."""
    strength = F.least(F.greatest(F.col("z") / 3, F.lit(0.0)), F.lit(1.0))
    joined = matches.join(F.broadcast(rates.filter("n > 0").select("right_id", "rate")), "right_id").withColumn("strength", strength)  # a row for each interest
    sums = joined.groupBy(F.col("left_id").alias("article_id")).agg(F.sum(F.col("strength") * (F.col("rate") - 0.5)).alias("x"), F.sum("strength").alias("y"))
    return sums.filter("y > 0").select("article_id", F.round(F.col("x") / F.col("y"), 6).alias("affinity"))


RATED_INTERESTS = f"""m AS (SELECT article_id, right_id, {DECAYED} * least(z / 3, 1) AS credit FROM latest JOIN top3 ON left_id = article_id WHERE z > 0),
interest_rates AS (SELECT right_id, (sum(greatest(credit, 0)) + 1) / (sum(abs(credit)) + 2) AS rate FROM m GROUP BY 1),
m_affinity AS (SELECT left_id AS article_id, round(sum(least(greatest(z / 3, 0), 1) * (rate - 0.5)) / sum(least(greatest(z / 3, 0), 1)), 6) AS affinity FROM top3 JOIN interest_rates USING (right_id) GROUP BY 1 HAVING sum(least(greatest(z / 3, 0), 1)) > 0)"""


@query("V9_affinity", with_views("verdicts latest", f", {Z_ROWS}, {RATED_INTERESTS} SELECT article_id AS left_id, affinity FROM m_affinity"))
def v9(spark, sf):
    z = top_interests(spark, sf)
    rates = interest_rates(decayed(spark, sf).select("article_id", "weight"), z.select("left_id", "right_id", "z"))
    return affinities(z, rates).withColumnRenamed("article_id", "left_id")


def signal_matrix(spark: SparkSession, sf_dir: str, ranking: Ranking = RANKING) -> DataFrame:
    """A row for each document: the six raw signals (null where there is none), slop (its author was reported), and the gates, which
    open with the number of ratings that a signal can use: rated articles with a vector, with a feed, with an interest. A signal
    behind a closed gate is absent."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), word_count(F.col("text")).alias("w"), "lang")
    heuristic = F.round(long_form(F.col("w"), F.col("w") < 60, F.coalesce(F.col("lang") == "fr", F.lit(False))), 6)
    six = lambda c: F.round(c, 6)
    z = staged(top_interests(spark, sf_dir), "top-interests")
    interest = z.groupBy(F.col("left_id").alias("article_id")).agg(six(0.7 * F.max("z") + 0.3 * F.avg("z")).alias("interest"))
    given = staged(decayed(spark, sf_dir), "verdicts")
    by_interest = interest_rates(given.select("article_id", "weight"), z.select("left_id", "right_id", "z"))
    affinity = affinities(z, by_interest)
    mean = lambda sign: F.coalesce(F.avg(F.when(F.col("value") == sign, F.col("score"))), F.lit(0.0))
    knn = neighbours(spark, sf_dir, ranking.neighbours).groupBy(F.col("left_id").alias("article_id")).agg(six(mean(1.0) - ranking.negative_coefficient * mean(-1.0)).alias("knn"))
    of = staged(carriers(spark, sf_dir), "carriers")
    rates = credit_rates(given.join(of, "article_id")).select("kind", "key", "rate")
    keys = of.select("article_id", F.explode(F.concat(F.transform("feeds", lambda f: F.struct(F.lit("feed").alias("kind"), f.cast("string").alias("key"))), F.array(F.struct(F.lit("author").alias("kind"), F.col("author").alias("key"))))).alias("k")).select("article_id", "k.*")
    feed = keys.join(rates, ["kind", "key"]).groupBy("article_id").agg(six(F.avg("rate")).alias("feed"))
    social = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("article_id")).agg(six(F.sum(F.log10(1 + F.greatest("value", F.lit(0.0)))) + 0.5 * F.log10(1 + F.count("*"))).alias("social"))
    reported = given.filter("label = 'slop'").join(of, "article_id").filter("author IS NOT NULL").select("author").distinct().withColumn("slop", F.lit(True))
    slop = of.join(reported, "author").select("article_id", "slop")
    out = d.select("article_id", heuristic.alias("heuristic"))
    for part in (interest, affinity, knn, feed, social, slop):
        out = out.join(part, "article_id", "left")
    counts = (
        ("knn", ranking.knn_gate, rated(spark, sf_dir).agg(F.count("*").alias("knn_n"))),
        ("affinity", ranking.affinity_gate, by_interest.agg(F.coalesce(F.max("attributable"), F.lit(0)).alias("affinity_n"))),
        ("feed", ranking.feed_gate, given.join(of, "article_id").agg(F.count("*").alias("feed_n"))),
    )
    for name, limits, n in counts:  # one row each
        out = out.join(F.broadcast(n)).withColumn(f"{name}_gate", gate(F.col(f"{name}_n"), limits.floor, limits.full).cast("double"))
    open_ = lambda s: F.when(F.col(f"{s}_gate") > 0, F.col(s)).alias(s) if s in GATED else F.col(s)
    return out.select("article_id", *map(open_, SIGNALS), F.coalesce("slop", F.lit(False)).alias("slop"), *[f"{g}_gate" for g in GATED])


# The numbers of the SQL are written out; they are not taken from the parameters that they check.
MATRIX = f"""{FEEDS}, {RATES}, {Z_ROWS}, {RATED_INTERESTS},
m_interest AS (SELECT left_id AS article_id, round(0.7 * max(z) + 0.3 * avg(z), 6) AS interest FROM top3 GROUP BY 1),
m_knn AS (SELECT left_id AS article_id, knn FROM ({ORACLE["V8_knn_score"]})),
m_keys AS (SELECT article_id, 'feed' AS kind, unnest(feeds)::VARCHAR AS key FROM of_article UNION ALL SELECT article_id, 'author', author FROM of_article),
m_feed AS (SELECT article_id, round(avg(rate), 6) AS feed FROM m_keys JOIN rates USING (kind, key) GROUP BY 1),
m_social AS (SELECT user_id AS article_id, round(sum(log10(1 + greatest(value, 0))) + 0.5 * log10(1 + count(*)), 6) AS social FROM events GROUP BY 1),
m_slop AS (SELECT article_id, true AS slop FROM of_article WHERE author IN (SELECT author FROM latest JOIN of_article USING (article_id) WHERE label = 'slop' AND author IS NOT NULL)),
m_words AS (SELECT doc_id AS article_id, lang, {WORDS} AS w FROM documents),
gates AS (SELECT CASE WHEN k <= 8 THEN 0.0 WHEN k >= 25 THEN 1.0 ELSE (k - 8) / 17.0 END::DOUBLE AS knn_gate, CASE WHEN a <= 15 THEN 0.0 WHEN a >= 40 THEN 1.0 ELSE (a - 15) / 25.0 END::DOUBLE AS affinity_gate, CASE WHEN f <= 15 THEN 0.0 WHEN f >= 40 THEN 1.0 ELSE (f - 15) / 25.0 END::DOUBLE AS feed_gate
 FROM (SELECT (SELECT count(*) FROM labels JOIN embeddings ON vec_id = doc_id) AS k, (SELECT count(DISTINCT article_id) FROM m) AS a, (SELECT count(*) FROM rated) AS f)),
matrix AS MATERIALIZED (SELECT article_id, interest, CASE WHEN knn_gate > 0 THEN knn END AS knn, CASE WHEN affinity_gate > 0 THEN affinity END AS affinity, round(35 * pow(least(greatest((w - 300) / 2200.0, 0), 1), 0.65) - CASE WHEN w < 60 THEN 20 ELSE 0 END - CASE WHEN lang = 'fr' THEN 15 ELSE 0 END, 6)::DOUBLE AS heuristic, CASE WHEN feed_gate > 0 THEN feed END AS feed, social,
 coalesce(slop, false) AS slop, knn_gate, affinity_gate, feed_gate
 FROM m_words LEFT JOIN m_interest USING (article_id) LEFT JOIN m_affinity USING (article_id) LEFT JOIN m_knn USING (article_id) LEFT JOIN m_feed USING (article_id) LEFT JOIN m_social USING (article_id) LEFT JOIN m_slop USING (article_id), gates)"""


@query("K5_signal_matrix", with_views("verdicts latest", f", {MATRIX} FROM matrix"))
def k5(spark, sf):
    return signal_matrix(spark, sf)


def normalised(df: DataFrame) -> DataFrame:
    """Adds n_<signal>: mid-rank percentiles of the values present."""
    return mid_ranks(df, "article_id", {s: f"n_{s}" for s in SIGNALS})


def gated_mean(weights: Mapping[str, float], columns: dict[str, Column], slop_penalty: float) -> Column:
    """100 times the mean of the values present, by weight times gate, times what a reported author leaves; null if no weight is
    left."""
    gated = lambda name: F.col(f"{name}_gate") if name in GATED else F.lit(1.0)
    total = weight = F.lit(0.0)
    for name, w in weights.items():
        there = columns[name].isNotNull() & (gated(name) > 0)
        total = total + F.when(there, columns[name] * gated(name) * w).otherwise(0.0)
        weight = weight + F.when(there, gated(name) * w).otherwise(0.0)
    return F.when(weight > 0, total / weight * 100 * F.when(F.col("slop"), 1 - slop_penalty).otherwise(1.0))


def preliminary(matrix: DataFrame, ranking: Ranking = RANKING) -> DataFrame:
    """Adds the percentiles and the blend; the matrix is written once, since it is read three times."""
    blend = gated_mean(ranking.preliminary, {s: F.col(f"n_{s}") for s in SIGNALS}, ranking.slop_author_penalty)
    return normalised(staged(matrix, "matrix")).withColumn("blend", F.round(blend, 6))


def _norms(source: str, prefix: str) -> str:
    rank = lambda s: MIDRANK.format(s)
    return ", ".join(f"{prefix}_{s} AS (SELECT article_id, CASE WHEN count(*) OVER (PARTITION BY {s}) = count(*) OVER () THEN 0.5 ELSE {rank(s)} END AS n_{s} FROM {source} WHERE {s} IS NOT NULL)" for s in SIGNALS)


SQL_BLEND = {"interest": "0.30", "knn": "0.25", "heuristic": "0.20", "affinity": "0.10", "feed": "0.10", "social": "0.05"}
SQL_UTILITY = {"quality": "0.40", "fit": "0.20", "knn": "0.10", "interest": "0.10", "affinity": "0.05", "feed": "0.05", "triage": "0.05", "social": "0.03", "heuristic": "0.02"}


def _mean_sql(weights: dict[str, str], value: dict[str, str]) -> str:
    g = lambda s: f"{s}_gate" if s in GATED else "1.0"
    total = " + ".join(f"coalesce({value[s]} * {g(s)} * {w}, 0)" for s, w in weights.items())
    weight = " + ".join(f"CASE WHEN {value[s]} IS NULL THEN 0 ELSE {g(s)} * {w} END" for s, w in weights.items())
    return f"round(({total}) / nullif({weight}, 0) * 100 * CASE WHEN slop THEN 0.25 ELSE 1 END, 6)"


_joined = lambda source, prefix: source + "".join(f" LEFT JOIN {prefix}_{s} USING (article_id)" for s in SIGNALS)
BLENDED_SQL = f"{MATRIX}, {_norms('matrix', 'p')}, blended AS MATERIALIZED (SELECT article_id, {_mean_sql(SQL_BLEND, {s: f'n_{s}' for s in SIGNALS})}::DOUBLE AS blend FROM {_joined('matrix', 'p')})"


@query("V10_blend", with_views("verdicts latest", f", {BLENDED_SQL} SELECT article_id, blend FROM blended"))
def v10(spark, sf):
    return preliminary(signal_matrix(spark, sf)).select("article_id", "blend")


DAY, DAY_THRESHOLD = "2024-01-15", 0.3
"""The day of the flow. No two given vectors are as close as the default threshold asks, so clusters form at 0.3."""

JUDGES = {"triage": (7, 5), "quality": (3, 6), "fit": (5, 4)}
"""Rules on the id that stand in for the scores of a judge: id * a % 11, none for every b-th id."""


def judges(article_id: Column) -> dict[str, Column]:
    return {j: F.when(article_id % b != 0, (article_id * a % 11).cast("double")) for j, (a, b) in JUDGES.items()}


def with_utility(rows: DataFrame, ranking: Ranking = RANKING) -> DataFrame:
    """Adds the judges' scores, percentiles among the given rows (signals, slop, gates), and the utility."""
    rows = normalised(staged(rows.withColumns(judges(F.col("article_id"))), "deep"))
    absolute = {j: F.least(F.greatest(F.col(j) / 10, F.lit(0.0)), F.lit(1.0)) for j in JUDGES}
    return rows.withColumn("utility", F.round(gated_mean(ranking.utility, {s: F.col(f"n_{s}") for s in SIGNALS} | absolute, ranking.slop_author_penalty), 6))


def day_of(spark: SparkSession, sf_dir: str, ranking: Ranking = RANKING) -> dict[str, DataFrame]:
    """The day's flow from signals to the shortlist, each step written once: ``signals`` (matrix, blend), ``admitted`` (every article that
    hygiene lets in, with its stage), ``deep`` (the admitted ones with judges' scores and utility), ``clusters`` (in the order of
    utility), ``shortlist``."""
    signals = staged(preliminary(signal_matrix(spark, sf_dir, ranking), ranking), "signals")
    d = table(spark, sf_dir, "documents")
    auto = F.col("doc_id") % 97 == 0
    open_ = d.filter(auto | (F.col("source") != "src3") | F.col("source").isNull())
    facts = open_.select(F.col("doc_id").alias("article_id"), F.split("text", "\n")[0].alias("title"), word_count(F.col("text")).alias("words"), auto.alias("auto"))
    rows = facts.join(signals.select("article_id", "interest", "knn", "blend"), "article_id").withColumn("triage", judges(F.col("article_id"))["triage"])
    rows = staged(rows, "considered")
    sound = (F.col("words") >= ranking.semantic_min_words) & ~roundup_title(F.col("title"))
    floor = sound & F.coalesce(F.col("triage") >= 3, F.lit(True))
    retrievers = [
        Retriever("triage", F.when(F.col("triage") >= 5, F.col("triage")), ranking.triage_quota),
        Retriever("interest", F.when(floor, F.col("interest")), ranking.interest_quota),
        Retriever("knn", F.when(floor & (F.col("knn") > 0), F.col("knn")), ranking.knn_quota),
    ]
    key = F.sha2(F.concat(F.lit(DAY), F.col("article_id").cast("string")), 256)
    admitted = staged(admit(rows, ranking.deep_keep, retrievers, sound & F.coalesce(F.col("triage") >= 4, F.lit(False)), ranking.exploration, key, F.col("blend")), "admitted")
    in_ = admitted.filter("stage = 'admitted'").select("article_id", "auto", "exploration", "title")
    deep = staged(with_utility(signals.select("article_id", *SIGNALS, "slop", *[f"{g}_gate" for g in GATED], "blend").join(in_, "article_id"), ranking), "judged")
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("v"))
    order = [F.desc_nulls_last("utility"), F.asc("article_id")]
    ranked = deep.join(held, "article_id", "left").select(F.col("article_id").alias("item"), "v", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # deep_keep rows and the automatic ones
    clusters = staged(leader_clusters(ranked, DAY_THRESHOLD, 2**31 - 1), "clusters")
    listed = clusters.join(deep.select(F.col("article_id").alias("item"), "auto", "exploration"), "item")
    shortlist = staged(diversified(listed, ranking.shortlist_keep, ranking.protected, ranking.per_cluster), "shortlist")
    return {"signals": signals, "admitted": admitted, "deep": deep, "clusters": clusters, "shortlist": shortlist}


def flow_sql() -> str:
    """admitted, deep, utility, ranked, clusters and the rounds of the shortlist, on top of matrix and blended."""
    phrases = "|".join(p.replace("'", "''") for p in ROUNDUP_PHRASES)
    sound = f"words >= 300 AND NOT regexp_matches(lower(coalesce(title, '')), '{phrases}')"
    floor = f"{sound} AND coalesce(triage >= 3, true)"
    ranked = lambda signal, test: f"SELECT article_id, auto, row_number() OVER (ORDER BY {signal} DESC, article_id) AS place FROM considered WHERE {signal} IS NOT NULL AND {test}"
    lists = [
        ("triage", "60", ranked("triage", "triage >= 5")),
        ("interest", "20", ranked("interest", floor)),
        ("knn", "20", ranked("knn", f"knn > 0 AND {floor}")),
        ("exploration", "5", f"SELECT article_id, auto, row_number() OVER (ORDER BY sha256('{DAY}' || article_id), article_id) AS place FROM (SELECT j.*, row_number() OVER (ORDER BY blend DESC, article_id) AS b FROM considered j WHERE blend IS NOT NULL) WHERE b > 120 AND b <= 300 AND {sound} AND coalesce(triage >= 4, false)"),
        ("blend", None, ranked("blend", "true")),
    ]
    parts = [
        f"considered AS MATERIALIZED (SELECT doc_id AS article_id, string_split(text, chr(10))[1] AS title, {WORDS} AS words, doc_id % 97 = 0 AS auto, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 7 % 11)::DOUBLE END AS triage, interest, knn, blend FROM documents JOIN matrix ON doc_id = article_id JOIN blended USING (article_id) WHERE doc_id % 97 = 0 OR source IS DISTINCT FROM 'src3')",
        "in0 AS (SELECT article_id FROM considered WHERE auto)",
        "s0 AS (SELECT article_id, 0 AS step, 'auto_include' AS name FROM considered WHERE auto)",
    ]
    for i, (name, quota, rows) in enumerate(lists, 1):
        room = f"(SELECT greatest(120 - count(*), 0) FROM in{i - 1})"
        own = room if quota is None else quota
        parts += [
            f"l{i} AS MATERIALIZED ({rows})",
            f"took{i} AS MATERIALIZED (SELECT article_id FROM (SELECT article_id, row_number() OVER (ORDER BY place) AS k FROM l{i} WHERE article_id NOT IN (FROM in{i - 1})) WHERE k <= least({own}, {room}))",
            f"s{i} AS (SELECT article_id, {i} AS step, '{name}' AS name FROM l{i} WHERE place <= {own} AND article_id IN (FROM in{i - 1}) UNION ALL SELECT article_id, {i}, '{name}' FROM took{i})",
            f"in{i} AS MATERIALIZED (FROM in{i - 1} UNION ALL FROM took{i})",
        ]
    every = " UNION ALL ".join(f"FROM s{i}" for i in range(len(lists) + 1))
    parts += [
        f"signed AS (SELECT article_id, string_agg(name, ',' ORDER BY step) AS admitted_by, arg_min(name, step) AS f FROM ({every}) GROUP BY 1)",
        "admitted AS MATERIALIZED (SELECT article_id, auto, CASE WHEN f IS NULL THEN 'not_admitted' ELSE 'admitted' END AS stage, admitted_by, coalesce(f = 'exploration', false) AS exploration FROM considered LEFT JOIN signed USING (article_id))",
        f"deep AS MATERIALIZED (SELECT matrix.*, blend, {', '.join(f'CASE WHEN article_id % {b} <> 0 THEN (article_id * {a} % 11)::DOUBLE END AS {j}' for j, (a, b) in JUDGES.items())} FROM matrix JOIN blended USING (article_id) JOIN admitted USING (article_id) WHERE stage = 'admitted')",
        _norms("deep", "q"),
        f"utility AS MATERIALIZED (SELECT article_id, {', '.join(JUDGES)}, blend, {_mean_sql(SQL_UTILITY, {s: f'n_{s}' for s in SIGNALS} | {j: f'least(greatest({j} / 10, 0), 1)' for j in JUDGES})}::DOUBLE AS utility FROM {_joined('deep', 'q')})",
    ]
    return ", ".join(parts)


DEEP_SQL = f"{BLENDED_SQL}, {flow_sql()}"
DAY_CLUSTERS = f"""{DEEP_SQL}, top AS MATERIALIZED (SELECT article_id AS item, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY utility DESC NULLS LAST, article_id)::INT AS rank FROM utility LEFT JOIN embeddings ON vec_id = article_id),
near AS MATERIALIZED (SELECT a.rank, coalesce(list(p.rank ORDER BY p.rank) FILTER (list_cosine_similarity(a.v, p.v) >= 0.3), []) AS near FROM top a LEFT JOIN top p ON p.rank < a.rank GROUP BY 1),
walk AS (SELECT 0 AS rank, []::INT[] AS leaders, 0 AS lead UNION ALL
 SELECT n.rank, CASE WHEN len(list_intersect(leaders, near)) = 0 THEN list_append(leaders, n.rank) ELSE leaders END, coalesce(list_min(list_intersect(leaders, near)), n.rank) FROM walk w JOIN near n ON n.rank = w.rank + 1),
clusters AS MATERIALIZED (SELECT t.item, t.rank, l.item AS cluster FROM walk w JOIN top t USING (rank) JOIN top l ON l.rank = w.lead)"""
DAY_SHORTLIST = f"{DAY_CLUSTERS}, cand AS MATERIALIZED (SELECT c.*, auto, row_number() OVER (PARTITION BY exploration ORDER BY rank) AS x, exploration FROM clusters c JOIN admitted ON article_id = item), {rounds_sql(60, 10, 2)}"
_RECURSIVE = lambda sql: with_views("verdicts latest", sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("K1_quota_admission", with_views("verdicts latest", f", {DEEP_SQL} SELECT article_id, stage, admitted_by, exploration FROM admitted"))
def k1(spark, sf):
    return day_of(spark, sf)["admitted"].select("article_id", "stage", "admitted_by", "exploration")


@query("K2_clusters_of_the_day", _RECURSIVE(f", {DAY_CLUSTERS} SELECT item, rank, cluster FROM clusters"))
def k2(spark, sf):
    return day_of(spark, sf)["clusters"]


@query("K3_shortlist_of_the_day", _RECURSIVE(f", {DAY_SHORTLIST} SELECT item, rank, cluster, CASE WHEN item IN (FROM i3) THEN 'shortlisted' ELSE 'assessed' END AS stage, CASE WHEN item IN (FROM i3) THEN NULL WHEN item IN (FROM suppressed) THEN 'cluster_suppressed' ELSE 'shortlist_cap' END AS reason FROM cand"))
def k3(spark, sf):
    return day_of(spark, sf)["shortlist"]


@query("K14_lineup_of_the_day", _RECURSIVE(f""", {DAY_SHORTLIST}, once AS (SELECT item, min({{'place': rank, 'section': coalesce(lang, 'other')}}) AS p FROM cand JOIN documents ON doc_id = item WHERE item IN (FROM i3) GROUP BY 1),
r AS (SELECT item AS article_id, auto, utility, p.section, p.place FROM once JOIN cand USING (item) JOIN utility ON utility.article_id = item), k AS (SELECT * FROM r ORDER BY auto DESC, utility DESC NULLS LAST, article_id LIMIT 28)
SELECT article_id, section, row_number() OVER (PARTITION BY section ORDER BY place, article_id)::INT AS position, row_number() OVER (ORDER BY place, article_id) = 1 AS is_lead FROM k"""))
def k14(spark, sf):
    """The shortlist is proposed in the order of utility, each article under its language."""
    day = day_of(spark, sf)
    home = F.coalesce("lang", F.lit("other"))
    known = day["deep"].join(table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), home.alias("home")), "article_id").select("article_id", "auto", F.col("utility").alias("score"), "home")
    picks = day["shortlist"].filter("stage = 'shortlisted'").select(F.col("item").alias("article_id"), F.col("rank").alias("place")).join(known.select("article_id", F.col("home").alias("section")), "article_id")
    return lineup(picks.select("article_id", "section", "place"), known.join(picks.select("article_id"), "article_id", "left_semi"), RANKING.hard_most)


@query("K20_funnel_of_the_day", _RECURSIVE(f""", {DAY_SHORTLIST} SELECT 'considered' AS state, count(*) AS n FROM documents UNION ALL SELECT 'let_in', count(*) FROM considered UNION ALL SELECT 'admitted', count(*) FROM admitted WHERE stage = 'admitted' UNION ALL SELECT 'explored', count(*) FROM admitted WHERE exploration UNION ALL SELECT 'clusters', count(DISTINCT cluster) FROM clusters
UNION ALL SELECT 'shortlisted', count(*) FROM i3 UNION ALL SELECT 'cluster_suppressed', count(*) FROM suppressed WHERE item NOT IN (FROM i3)"""))
def funnel_of_the_day(spark, sf):
    """How many articles reach each state of the day's flow."""
    day = day_of(spark, sf)
    count = lambda df, state, column="*": df.agg((F.count("*") if column == "*" else F.count_distinct(column)).alias("n")).select(F.lit(state).alias("state"), "n")
    out = count(table(spark, sf, "documents"), "considered").union(count(day["admitted"], "let_in")).union(count(day["admitted"].filter("stage = 'admitted'"), "admitted"))
    out = out.union(count(day["admitted"].filter("exploration"), "explored")).union(count(day["clusters"], "clusters", "cluster"))
    short = day["shortlist"]
    return out.union(count(short.filter("stage = 'shortlisted'"), "shortlisted")).union(count(short.filter("reason = 'cluster_suppressed'"), "cluster_suppressed"))


@query("K4_utility_over_the_deep_set", with_views("verdicts latest", f", {DEEP_SQL} SELECT article_id, utility FROM utility"))
def k4(spark, sf):
    return day_of(spark, sf)["deep"].select("article_id", "utility")


@query("K18_explained_item", with_views("verdicts latest candidates", f""", {DAY_CLUSTERS}, one AS (SELECT item AS article_id, rank, cluster FROM clusters WHERE rank = 1)
SELECT article_id, interest, knn, affinity, heuristic, feed, social, slop, u.triage, u.quality, u.fit, u.blend, u.utility, rank, cluster, (SELECT count(*) FROM clusters c WHERE c.cluster = one.cluster) AS cluster_size, (SELECT count(*) FROM candidates c WHERE c.article_id = one.article_id) AS runs,
 (SELECT arg_max(stage, run_id) FROM candidates c WHERE c.article_id = one.article_id) AS stage, (SELECT any_value(label) FROM latest l WHERE l.article_id = one.article_id) AS label,
 coalesce((SELECT string_agg(right_id::VARCHAR, ',' ORDER BY top3.rank) FROM top3 WHERE left_id = one.article_id), '') AS interests FROM one JOIN matrix USING (article_id) JOIN utility u USING (article_id)""").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def k18(spark, sf):
    """All that is known of the item with the largest utility: signals, judges' scores, rank, cluster, runs, verdict, interests."""
    day = day_of(spark, sf)
    placed = day["clusters"].withColumn("cluster_size", F.count("*").over(Window.partitionBy("cluster"))).filter("rank = 1").withColumnRenamed("item", "article_id")
    one = staged(day["deep"].join(F.broadcast(placed), "article_id").select("article_id", *SIGNALS, "slop", *JUDGES, "blend", "utility", "rank", "cluster", "cluster_size"), "one")
    seen = candidates(spark, sf).join(F.broadcast(one.select("article_id")), "article_id").groupBy("article_id").agg(F.count("*").alias("runs"), F.max_by("stage", "run_id").alias("stage"))
    said = latest_verdicts(spark, sf).select("article_id", "label")
    near = top_interests(spark, sf).join(F.broadcast(one.select(F.col("article_id").alias("left_id"))), "left_id")
    near = near.groupBy(F.col("left_id").alias("article_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "right_id"))), lambda x: x["right_id"].cast("string")), ",").alias("interests"))
    out = one.join(seen, "article_id", "left").join(said, "article_id", "left").join(near, "article_id", "left")
    return out.withColumns({"runs": F.coalesce("runs", F.lit(0)), "interests": F.coalesce("interests", F.lit(""))})


@query("K19_contributions", with_views("verdicts latest", f""", {FEEDS}, c AS (SELECT article_id, label, event_at, {DECAYED} AS credit FROM latest),
r AS (SELECT c.*, len(feeds) AS feeds, coalesce(aggregator_only, false) AS aggregator_only, round(credit * CASE WHEN aggregator_only THEN {AGGREGATOR_SHARE} ELSE 1 END / len(feeds), 9) AS feed_credit, author IS NOT NULL AS has_author,
 row_number() OVER (PARTITION BY label ORDER BY abs(round(credit, 9)) DESC, article_id)::INT AS rank FROM c LEFT JOIN of_article USING (article_id))
SELECT article_id, label, round(credit, 9) AS credit, event_at >= TIMESTAMP '2024-01-18' AS recent, feeds::INT AS feeds, aggregator_only, feed_credit, has_author, rank, rank <= 20 AS shown FROM r"""))  # fmt: skip
def k19(spark, sf):
    """What each current verdict gives to feeds and author; ``recent``: within the look-back; ``shown``: among the first twenty of its
    label."""
    share = F.col("weight") * F.when(F.col("aggregator_only"), AGGREGATOR_SHARE).otherwise(1.0) / F.size("feeds")
    rows = decayed(spark, sf).join(carriers(spark, sf), "article_id", "left").withColumn("credit", F.round("weight", 9))
    rows = numbered_within(rows, ["label"], [F.desc(F.abs("credit")), F.asc("article_id")]).withColumn("rank", F.col("rank").cast("int"))
    rows = rows.withColumns({"feed_credit": F.round(share, 9), "recent": F.col("event_at") >= F.lit("2024-01-18").cast("timestamp_ntz")})
    n = F.when(F.col("feeds").isNotNull(), F.size("feeds"))
    return rows.select("article_id", "label", "credit", "recent", n.alias("feeds"), F.coalesce("aggregator_only", F.lit(False)).alias("aggregator_only"), "feed_credit", F.col("author").isNotNull().alias("has_author"), "rank", (F.col("rank") <= 20).alias("shown"))


# ---------------------------------------------------------------- reports

#: The statistics report: query, columns that name a row, column of the value.
METRICS = (
    ("A1_count_selected", (), "n"), ("A2_verdicts_by_label", ("label",), "n"), ("A3_stage_by_reason", ("stage", "reason"), "n"), ("A4_funnel", ("stage",), "reached"), ("A4_funnel", ("stage",), "percent"),
    ("A7_cost_totals", ("level", "day", "provider"), "cost"), ("A8_week_by_label", ("week", "label"), "n"), ("A9_tally_by_stage", ("stage",), "up"), ("A9_tally_by_stage", ("stage",), "down"), ("A9_tally_by_stage", ("stage",), "ratio"),
    ("A10_mean_seconds_between_events", ("user_id",), "mean_s"), ("A11_ratio_by_day", ("day",), "ratio"), ("A12_exploration_yield", (), "selected"), ("A12_exploration_yield", (), "positive"), ("A13_spend_of_a_day", ("level", "provider"), "spent"),
)


@query("K20_statistics", " UNION ALL ".join(
    f"SELECT '{name.split('_')[0]}.{value}' AS metric, concat_ws('/', {', '.join(f'''coalesce({k}::VARCHAR, '-')''' for k in keys) or chr(39) * 2}) AS key, {value}::DOUBLE AS value FROM ({ORACLE[name]})" for name, keys, value in METRICS
))
def k20(spark, sf):
    """Counts, funnel, costs, weeks, tallies, durations, ratios, yield and spend as rows of (metric, key, value)."""
    out = None
    for name, keys, value in METRICS:
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]) if keys else F.lit("")
        part = QUERIES[name](spark, sf).select(F.lit(f"{name.split('_')[0]}.{value}").alias("metric"), key.alias("key"), F.col(value).cast("double").alias("value"))
        out = part if out is None else out.union(part)
    return out


@query("K21_run_report", with_views("runs candidates", """, c AS (SELECT run_id, count(*) AS considered, count(*) FILTER (stage <> 'N') AS eligible, count(*) FILTER (stage = 'R') AS selected, round(max(utility), 2)::DOUBLE AS best FROM candidates GROUP BY 1),
l AS (SELECT run_id, array_to_string(list(article_id::VARCHAR ORDER BY utility DESC, article_id)[1:3], ', ') AS leads FROM candidates WHERE stage = 'R' GROUP BY 1)
SELECT run_id, CASE status WHEN 'P' THEN 'running' WHEN 'F' THEN 'finished' ELSE 'open' END || ' run of ' || CAST(day AS VARCHAR) || chr(10) || coalesce(considered, 0) || ' considered, ' || coalesce(eligible, 0) || ' eligible, ' || coalesce(selected, 0) || ' selected' || chr(10)
 || 'spent ' || printf('%.2f', cost) || ' at ' || provider || chr(10) || coalesce('leads: ' || leads, 'no leads') AS summary, best FROM runs LEFT JOIN c USING (run_id) LEFT JOIN l USING (run_id)"""))  # fmt: skip
def k21(spark, sf):
    """Four lines for each run: what it is, the funnel, the money, the leads."""
    c = candidates(spark, sf)
    n = c.groupBy("run_id").agg(F.count("*").alias("considered"), F.count_if(F.col("stage") != "N").alias("eligible"), F.count_if(F.col("stage") == "R").alias("selected"), F.round(F.max("utility"), 2).cast("double").alias("best"))
    first = top_k(c.filter("stage = 'R'"), "run_id", [F.desc("utility"), F.asc("article_id")], 3)
    leads = first.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"].cast("string")), ", ").alias("leads"))
    said = lambda name, what: F.concat(F.coalesce(F.col(name), F.lit(0)).cast("string"), F.lit(f" {what}"))
    state = F.when(F.col("status") == "P", "running").when(F.col("status") == "F", "finished").otherwise("open")
    lines = [
        F.concat(state, F.lit(" run of "), F.col("day").cast("string")),
        F.concat_ws(", ", said("considered", "considered"), said("eligible", "eligible"), said("selected", "selected")),
        F.concat(F.lit("spent "), F.replace(F.format_number("cost", 2), F.lit(","), F.lit("")), F.lit(" at "), F.col("provider")),
        F.coalesce(F.concat(F.lit("leads: "), "leads"), F.lit("no leads")),
    ]
    return runs(spark, sf).join(n, "run_id", "left").join(leads, "run_id", "left").select("run_id", F.concat_ws("\n", *lines).alias("summary"), "best")


@query("K28_feed_candidates", with_views("verdicts latest candidates", """, e AS (SELECT article_id, arg_max(least(utility, 1000) / 1000, run_id)::DOUBLE AS v FROM candidates WHERE stage <> 'N' GROUP BY 1),
s AS (SELECT ps.l_suppkey AS feed, l_partkey AS article_id, p_brand AS brand, coalesce(l.value, e.v) AS v FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ps JOIN part ON p_partkey = l_partkey LEFT JOIN e ON e.article_id = l_partkey LEFT JOIN latest l ON l.article_id = l_partkey),
b AS (SELECT feed, string_agg(brand, ',' ORDER BY n DESC, brand) AS brands FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY n DESC, brand) AS k FROM (SELECT feed, brand, count(*) AS n FROM s GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1),
a AS (SELECT feed, string_agg(article_id::VARCHAR, ',' ORDER BY k) AS best FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY round(v, 9) DESC NULLS LAST, article_id) AS k FROM s) WHERE k <= 3 GROUP BY 1)
SELECT feed, count(*) AS links, count(v) AS scored, round(least(greatest((coalesce(sum(v), 0) + 0.6) / (count(v) + 2) * 100, 0), 100), 6)::DOUBLE AS evidence, any_value(brands) AS brands, any_value(best) AS best FROM s JOIN b USING (feed) JOIN a USING (feed) GROUP BY 1"""))  # fmt: skip
def k28(spark, sf):
    """Each feed with its evidence (the latest scored run of a linked article, which a verdict overrides), its three commonest brands, and
    its three best articles, those without a score last; the page is in the order of evidence."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_brand").alias("brand"))
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feed"), F.col("l_partkey").alias("article_id")).distinct().join(part, "article_id")
    scored = candidates(spark, sf).filter("stage <> 'N'").groupBy("article_id").agg(F.max_by(F.least("utility", F.lit(1000)).cast("double") / 1000, "run_id").alias("v"))
    rows = links.join(scored, "article_id", "left").join(latest_verdicts(spark, sf).select("article_id", "value"), "article_id", "left").withColumn("v", F.coalesce("value", "v"))
    share = (F.coalesce(F.sum("v"), F.lit(0.0)) + 0.6) / (F.count("v") + 2) * 100
    facts = rows.groupBy("feed").agg(F.count("*").alias("links"), F.count("v").alias("scored"), F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)), 6).alias("evidence"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).cast("string").alias("x")))), lambda x: x["x"]), ",")
    brands = top_k(rows.groupBy("feed", "brand").agg(F.count("*").alias("n")), "feed", [F.desc("n"), F.asc("brand")], 3).groupBy("feed").agg(joined("brand").alias("brands"))
    best = top_k(rows, "feed", [F.desc_nulls_last(F.round("v", 9)), F.asc("article_id")], 3).groupBy("feed").agg(joined("article_id").alias("best"))
    return facts.join(brands, "feed").join(best, "feed").orderBy(F.desc("evidence"), F.desc("links"), "feed")


# ---------------------------------------------------------------- comment trees, retention

TOP, CHILDREN, LEVELS, CHARS, CHAPTER_WORDS = 8, 4, 3, 1200, 4000
_SHOWN = "CASE WHEN length(text) <= 1200 THEN text WHEN strpos(reverse(left(text, 1200)), ' ') > 0 AND 1200 - strpos(reverse(left(text, 1200)), ' ') > 900 THEN rtrim(left(text, 1200 - strpos(reverse(left(text, 1200)), ' '))) || '…' ELSE rtrim(left(text, 1200)) || '…' END"
COMMENTS = f"""c AS (SELECT conv_id // 10 AS chapter, conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + CASE WHEN turn <= 5 THEN 0 ELSE turn - 5 END END AS parent, turn * 7 % 4 AS points, conv_id * 100 + turn AS seq, {_SHOWN} AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
l0 AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY points DESC, seq) AS k FROM c WHERE parent IS NULL), r0 AS (SELECT *, [k] AS path FROM l0 WHERE k <= {TOP}),
l1 AS (SELECT c.*, row_number() OVER (PARTITION BY c.parent ORDER BY c.points DESC, c.seq) AS k, r0.path AS up FROM c JOIN r0 ON c.parent = r0.id), r1 AS (SELECT *, list_append(up, k) AS path FROM l1 WHERE k <= {CHILDREN}),
l2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.parent ORDER BY c.points DESC, c.seq) AS k, r1.path AS up FROM c JOIN r1 ON c.parent = r1.id), r2 AS (SELECT *, list_append(up, k) AS path FROM l2 WHERE k <= {CHILDREN}),
pruned AS (SELECT chapter, id, parent, path, text FROM r0 UNION ALL SELECT chapter, id, parent, path, text FROM r1 UNION ALL SELECT chapter, id, parent, path, text FROM r2)"""


def comment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments: ten conversations make a chapter, each a thread; the first five answers hang on the root and later ones on
    the answer five before."""
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").filter("trim(coalesce(text, '')) <> ''")
    parent = F.when(t > 0, F.col("conv_id") * 100 + F.when(t <= 5, 0).otherwise(t - 5))
    return c.select(F.floor(F.col("conv_id") / 10).alias("chapter"), (F.col("conv_id") * 100 + t).alias("id"), parent.alias("parent"), (t * 7 % 4).alias("points"), (F.col("conv_id") * 100 + t).alias("seq"), clipped(F.col("text"), CHARS).alias("text"))


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` characters, back to a space in the last quarter if there is one, with an ellipsis if cut."""
    head = F.left(text, F.lit(most))
    at = most - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(F.reverse(head), " ") > 0) & (at > most * 3 // 4), F.left(head, at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


@query("D8_comment_tree", f"WITH {COMMENTS} SELECT chapter, id, parent, array_to_string(path, '.') AS path, text FROM pruned")
def d8(spark, sf):
    kept = pruned(comment_trees(spark, sf), "chapter", TOP, CHILDREN, LEVELS)
    return kept.select("chapter", "id", "parent", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "text")


@query("K16_comment_budget", f"""WITH RECURSIVE {COMMENTS}, o AS (SELECT chapter, id, coalesce(parent, -1) AS parent, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY chapter ORDER BY path) AS k FROM pruned),
w AS (SELECT chapter, 0::BIGINT AS k, {CHAPTER_WORDS // 8}::BIGINT AS room, [-1]::BIGINT[] AS open, -2::BIGINT AS id, false AS kept FROM (SELECT DISTINCT chapter FROM o) UNION ALL
 SELECT o.chapter, o.k, CASE WHEN list_contains(open, parent) AND words <= room THEN room - words ELSE room END,
  CASE WHEN list_contains(open, parent) AND words <= room THEN list_append(open, o.id) WHEN list_contains(open, parent) THEN list_filter(open, lambda x: x <> parent) ELSE open END, o.id, list_contains(open, parent) AND words <= room
 FROM w JOIN o ON o.chapter = w.chapter AND o.k = w.k + 1)
SELECT chapter, id FROM w WHERE kept""")  # fmt: skip
def k16(spark, sf):
    """The pruned trees within a budget of words for each chapter, an eighth of the production one, which the given turns would not
    reach."""
    kept = pruned(comment_trees(spark, sf), "chapter", TOP, CHILDREN, LEVELS)
    kept = kept.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return within_word_budget(kept, "chapter", CHAPTER_WORDS // 8).select("chapter", "id")


@query("K17_retention", with_views("verdicts candidates runs", """, e AS (SELECT vec_id AS key, DATE '2023-01-01' + (vec_id * 13 % 400)::INT AS first_seen FROM embeddings)
SELECT 'embeddings' AS store, key::VARCHAR AS key FROM e WHERE first_seen >= DATE '2023-09-01' OR key IN (SELECT article_id FROM verdicts) OR key IN (SELECT article_id FROM candidates WHERE stage = 'R')
UNION ALL SELECT 'telemetry', run_id || '/' || article_id FROM candidates WHERE run_id NOT IN (SELECT run_id FROM runs WHERE day < DATE '1997-01-01')
UNION ALL SELECT 'assessments', event_id::VARCHAR FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15'"""))  # fmt: skip
def k17(spark, sf):
    """What three sweeps leave: vectors that are young, rated or published; candidates of runs that aren't old; young assessments."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("vec_id") * 13 % 400).cast("int")).alias("first_seen"))
    old = e.filter(F.col("first_seen") < F.lit("2023-09-01").cast("date")).select("article_id")
    for used in (verdicts(spark, sf), candidates(spark, sf).filter("stage = 'R'")):
        old = old.join(used.select("article_id"), "article_id", "left_anti")
    vectors = e.join(old, "article_id", "left_anti").select(F.lit("embeddings").alias("store"), F.col("article_id").cast("string").alias("key"))
    late = runs(spark, sf).filter(F.col("day") < F.lit("1997-01-01").cast("date")).select("run_id")
    telemetry = candidates(spark, sf).join(late, "run_id", "left_anti").select(F.lit("telemetry"), F.concat_ws("/", F.col("run_id").cast("string"), F.col("article_id").cast("string")))
    young = (F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return vectors.union(telemetry).union(table(spark, sf, "events").filter(young).select(F.lit("assessments"), F.col("event_id").cast("string")))


# ---------------------------------------------------------------- sort menus

#: Menu entry -> column and whether the largest come first; text columns are compared without case.
ARTICLE_SORTS = {"first_seen": ("first_seen", True), "match": ("match", True), "utility": ("utility", True), "quality": ("quality", True), "fit": ("fit", True), "triage": ("triage", True), "words": ("words", True), "title": ("title", False)}
CANDIDATE_SORTS = {"utility": ("utility", True), "rank": ("rank", False), "triage": ("triage", True), "quality": ("quality", True), "fit": ("fit", True), "title": ("title", False)}
INTEREST_SORTS = {"weight": ("weight", True), "name": ("name", False), "matches": ("matches", True), "added": ("added", True)}


def sorted_page(df: DataFrame, sorts: dict[str, tuple[str, bool]], wanted: str, tie: list[Column], n: int) -> DataFrame:
    """The first rows in an allowed order, nulls last; what isn't on the menu is its first entry."""
    name, largest = sorts.get(wanted, next(iter(sorts.values())))
    by = F.lower(name) if name in ("title", "name") else F.col(name)
    return df.orderBy(by.desc_nulls_last() if largest else by.asc_nulls_last(), *tie).limit(n)


ROWS = f"""a AS (SELECT doc_id AS id, doc_id * 13 % 400 AS first_seen, doc_id * 7 % 31 AS match, doc_id * 3 % 101 AS utility, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 3 % 11 END AS quality, doc_id * 5 % 11 AS fit, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7 % 11 END AS triage, doc_id % 60 AS rank, {WORDS}::INT AS words, string_split(text, chr(10))[1] AS title FROM documents),
i AS (SELECT label AS id, 'Interest ' || (label * 7 % 10) AS name, label % 4 / 4.0 AS weight, count(*) AS matches, label * 3 % 8 AS added FROM embeddings GROUP BY label)"""


def _menu_sql() -> str:
    order = {"title": "lower(title) ASC", "name": "lower(name) ASC", "rank": "rank ASC"}
    pages = []
    for menu, source, sorts, tie in (("articles", "a", [*ARTICLE_SORTS, "bogus"], "id DESC"), ("candidates", "a", [*CANDIDATE_SORTS], "id ASC"), ("interests", "i", [*INTEREST_SORTS], "lower(name), name, id")):
        for s in sorts:
            first = {"articles": "first_seen", "candidates": "utility", "interests": "weight"}[menu]
            by = order.get(s, f"{first if s == 'bogus' else s} DESC")
            own = "id ASC" if menu == "articles" and s == "title" else tie
            pages.append(f"SELECT '{menu}' AS menu, '{s}' AS sort, id FROM (SELECT id FROM {source} ORDER BY {by} NULLS LAST, {own} LIMIT 15)")
    return f"WITH {ROWS} " + " UNION ALL ".join(pages)


@query("O2_sort_menus", _menu_sql())
def o2(spark, sf):
    """A page in each order of the three menus, and one in an order that no menu has."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        i.alias("id"), (i * 13 % 400).alias("first_seen"), (i * 7 % 31).alias("match"), (i * 3 % 101).alias("utility"), F.when(i % 4 != 0, i * 3 % 11).alias("quality"), (i * 5 % 11).alias("fit"),
        F.when(i % 3 != 0, i * 7 % 11).alias("triage"), (i % 60).alias("rank"), word_count(F.col("text")).alias("words"), F.split("text", "\n")[0].alias("title"),
    )
    label = F.col("label")
    interests = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("matches")).select(label.alias("id"), F.concat(F.lit("Interest "), (label * 7 % 10).cast("string")).alias("name"), (label % 4 / 4.0).alias("weight"), "matches", (label * 3 % 8).alias("added"))
    out = None
    for menu, rows, sorts, wanted, tie in (("articles", d, ARTICLE_SORTS, [*ARTICLE_SORTS, "bogus"], [F.desc("id")]), ("candidates", d, CANDIDATE_SORTS, CANDIDATE_SORTS, [F.asc("id")]), ("interests", interests, INTEREST_SORTS, INTEREST_SORTS, [F.lower("name"), F.asc("name"), F.asc("id")])):
        for s in wanted:
            own = [F.asc("id")] if menu == "articles" and s == "title" else tie
            page = sorted_page(rows, sorts, s, own, 15).select(F.lit(menu).alias("menu"), F.lit(s).alias("sort"), F.col("id").cast("long").alias("id"))
            out = page if out is None else out.union(page)
    return out


@query("K27_interest_page", with_views("verdicts latest", f""", {Z_ROWS}, m AS (SELECT right_id, {DECAYED} * least(z / 3, 1) AS credit FROM latest JOIN top3 ON left_id = article_id WHERE z > 0),
t AS (SELECT right_id, (sum(greatest(credit, 0)) + 1) / (sum(abs(credit)) + 2) AS rate, count(*) AS n FROM m GROUP BY 1), c AS (SELECT right_id, count(*) AS matches FROM top3 WHERE z >= 1 GROUP BY 1)
SELECT i.right_id, round(coalesce(rate, 0.5), 6)::DOUBLE AS rate, coalesce(n, 0) AS rated, coalesce(matches, 0) AS matches FROM i LEFT JOIN t USING (right_id) LEFT JOIN c USING (right_id) WHERE i.right_id % 2 = 1 OR coalesce(matches, 0) > 0"""))  # fmt: skip
def k27(spark, sf):
    """The interests that have matches or are of the wanted category (odd ids), with their rates and match counts, by rate."""
    from .signals import interests

    z = top_interests(spark, sf)
    rates = interest_rates(decayed(spark, sf).select("article_id", "weight"), z.select("left_id", "right_id", "z")).select("right_id", "rate", F.col("n").alias("rated"))
    matches = z.filter("z >= 1").groupBy("right_id").agg(F.count("*").alias("matches"))
    page = interests(spark, sf).select("right_id").join(rates, "right_id", "left").join(matches, "right_id", "left").na.fill(0, ["rated", "matches"])
    page = page.select("right_id", F.round(F.coalesce("rate", F.lit(0.5)), 6).alias("rate"), "rated", "matches")
    return page.filter((F.col("right_id") % 2 == 1) | (F.col("matches") > 0)).orderBy(F.desc("rate"), "right_id")


# ---------------------------------------------------------------- addresses

# Addresses with what becomes of them.
ADDRESSES = (
    ("HTTP://Site.EXAMPLE.com:80/A/B//?b=2&a=1#x", "http://site.example.com/A/B?b=2&a=1"),
    ("https://example.org/?q=a+b%2Bc&UTM_Campaign=z", "https://example.org/?q=a+b%2Bc"),
    ("https://example.org/p?empty=&flag&mc_eid=9", "https://example.org/p?empty=&flag="),
    ("https://example.org/p?q=caf%C3%A9%20au+lait~", "https://example.org/p?q=caf%C3%A9+au+lait%7E"),
    ("https://news.google.com/x/y?hl=de&url=https%3A%2F%2Fexample.net%2Fstory%2F%3Fref%3Dz%26n%3D1", "https://example.net/story?n=1"),
    ("https://www.google.com/url?sa=t&q=http://news.google.com/z?url=https%3A%2F%2Fexample.net%2Fdeep%2F", "https://example.net/deep"),
    ("https://www.google.com/url?q=ftp://example.net/file", "https://www.google.com/url?q=ftp%3A%2F%2Fexample.net%2Ffile"),
    ("https://www.google.com/search?q=https://example.net/", "https://www.google.com/search?q=https%3A%2F%2Fexample.net%2F"),
    ("https://scour.ing/r/rss/https%3A%2F%2Fexample.net%2Fpost%2F%3Fsi%3D3%26k%3Dv", "https://example.net/post?k=v"),
    ("https://scour.ing/r/rss/mailto%3Asomebody", "https://scour.ing/r/rss/mailto%3Asomebody"),
    ("  https://example.org/trimmed/  ", "https://example.org/trimmed"),
    ("https://example.org:8443/a", "https://example.org:8443/a"),
    ("ftp://example.org/a", None), ("example.org/a", None), ("https://", None), ("", None), (None, None),
)
_sql_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
CASES = ", ".join(f"({i}, {_sql_text(raw)}, {_sql_text(want)})" for i, (raw, want) in enumerate(ADDRESSES))


@query("X1_canonical_url", f"WITH canon AS ({CANONICAL}) SELECT 'page' AS kind, page_id AS id, canonical FROM canon UNION ALL SELECT 'redirect', page_id, canonical FROM canon UNION ALL SELECT 'again', page_id, canonical FROM canon UNION ALL SELECT 'case', c.i::BIGINT, c.want FROM (VALUES {CASES}) c(i, raw, want)")
def x1(spark, sf):
    """Addresses of pages as they are, behind a redirector, and canonical already; and the listed cases."""
    p = table(spark, sf, "pages").select("page_id", "url")
    out = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), canonical_url(F.col("url")).alias("canonical"))
    out = out.union(p.select(F.lit("redirect"), "page_id", canonical_url(F.concat(F.lit("https://www.google.com/url?sa=D&q="), F.url_encode("url"), F.lit("&ust=1")))))
    out = out.union(p.select(F.lit("again"), "page_id", canonical_url(canonical_url(F.col("url")))))
    cases = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(ADDRESSES)], "i long, raw string")
    return out.union(cases.select(F.lit("case"), "i", canonical_url(F.col("raw"))))


# ---------------------------------------------------------------- entries of single rules

@query("F7_text_probe", "SELECT event_id FROM events WHERE props LIKE '%\"k\": 7%' OR props LIKE '%\"k\":7%'")
def f7(spark, sf):
    """A cheap look into stored JSON before it is parsed: the text has the key with a value that begins with the sign."""
    return table(spark, sf, "events").filter(F.contains("props", F.lit('"k": 7')) | F.contains("props", F.lit('"k":7'))).select("event_id")


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@query("F18_skipped_hosts", f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages) SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' OR host = 'm.ththth.example.net' OR host LIKE '%.m.ththth.example.net' AS skipped FROM h")
def f18(spark, sf):
    from gleanery.functions.columns import host

    return table(spark, sf, "pages").select("page_id", under_domain(host(F.col("url")), ["example.com", "m.ththth.example.net"]).alias("skipped"))


@query("J15_small_list_membership", f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), s(domain) AS (VALUES ('example.com'), ('example.org')) SELECT page_id, list_sort(list(domain) FILTER (host = domain OR host LIKE '%.' || domain)) AS domains FROM h, s GROUP BY 1 HAVING count(*) FILTER (host = domain OR host LIKE '%.' || domain) > 0")
def j15(spark, sf):
    from gleanery.functions.columns import host

    name = host(F.col("url"))
    hit = F.filter(F.array(F.lit("example.com"), F.lit("example.org")), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))
    return table(spark, sf, "pages").select("page_id", F.array_sort(hit).alias("domains")).filter(F.size("domains") > 0)


@query("U1_first_wins_union", "WITH u AS (SELECT 0 AS src, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 1, user_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 2, vec_id FROM embeddings) SELECT id, ['stage', 'verdict', 'vector'][min(src) + 1] AS admitted_by, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM u GROUP BY 1")
def u1(spark, sf):
    """Ids of three lists, each once, under the first list that has it, with all lists that have it."""
    parts = [table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")), table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id"), table(spark, sf, "embeddings").select("vec_id")]
    out = None
    for i, part in enumerate(parts):
        part = part.select(F.lit(i).alias("src"), F.col(part.columns[0]).alias("id"))
        out = part if out is None else out.union(part)
    names = F.array(F.lit("stage"), F.lit("verdict"), F.lit("vector"))
    return out.groupBy("id").agg(F.min("src").alias("first"), F.array_sort(F.collect_set("src")).alias("s")).select("id", F.get(names, F.col("first")).alias("admitted_by"), F.array_join(F.col("s").cast("array<string>"), ",").alias("sources"))


@query("T4_half_lives", f"WITH a AS (SELECT event_id, greatest(date_diff('second', date_trunc('second', ts), TIMESTAMP '{NOW}'), 0) / 86400.0 AS age FROM events) SELECT event_id, round(pow(0.5, age / 7), 9) AS week, round(pow(0.5, age / 60), 9) AS months, 1.0::DOUBLE AS none, 1.0::DOUBLE AS negative FROM a")
def t4(spark, sf):
    age = age_days(F.col("ts"), now())
    return table(spark, sf, "events").select("event_id", *[F.round(decay(age, half), 9).alias(name) for half, name in ((7.0, "week"), (60.0, "months"), (0.0, "none"), (-5.0, "negative"))])


@query("V5_reading_minutes", f"SELECT doc_id, greatest(1, ceil({WORDS} / 220))::BIGINT AS minutes FROM documents")
def v5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reading_minutes(word_count(F.col("text"))).alias("minutes"))


# ---------------------------------------------------------------- sinks

@query("S15_appended_events", with_views("verdicts", "SELECT label, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM (SELECT * FROM verdicts WHERE explicit UNION ALL SELECT * FROM verdicts WHERE NOT explicit) GROUP BY 1"))
def s15(spark, sf):
    """Verdicts appended in two goes, read back."""
    path = drafts(spark, "events")
    for explicit in (True, False):
        append(verdicts(spark, sf).filter(F.col("explicit") == explicit).select("id", "label"), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("S17_published_days", "WITH e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, 'issue-' || CAST(day AS VARCHAR) AS name, n::VARCHAR AS value FROM e WHERE day IN (SELECT day FROM e ORDER BY day DESC LIMIT 3)")
def s17(spark, sf):
    """The three newest days, each written to a draft and moved into place as a whole, then found again by the dates in their names."""
    folder = drafts(spark, "issues")
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    for r in e.orderBy(F.desc("day")).limit(3).collect():  # three rows
        publish(spark.createDataFrame([(str(r["n"]),)], "value string"), folder, f"issue-{r['day']}")
    return named_by_day(spark, f"{folder}/*").select(F.col("day").cast("string").alias("day"), "name", "value")


@query("O11_kept_files", f"WITH f AS (SELECT DISTINCT {O12_DAYS} AS day FROM orders), n AS (SELECT day, 'issue-' || CAST(day AS VARCHAR) || '.epub' AS name FROM f) SELECT 'newest' AS rule, name FROM (SELECT * FROM n ORDER BY day DESC LIMIT 14) UNION ALL SELECT 'younger', name FROM n WHERE day >= DATE '1998-07-01'")
def o11(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    files = days.select("day", F.concat(F.lit("issue-"), F.col("day").cast("string"), F.lit(".epub")).alias("name"))
    young = kept_files(files, oldest="1998-07-01")
    return kept_files(files, 14).select(F.lit("newest").alias("rule"), "name").union(young.select(F.lit("younger"), "name"))
