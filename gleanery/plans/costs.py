"""Costs and signals that runs store as JSON maps, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.ranking import top_k
from gleanery.sources.views import table, with_views

from .catalog import query
from .reports import latest_verdicts

EMBEDDER = "p0"
"""The provider of vectors: its tokens are no tokens of judges."""


def stored_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, day, costs as runs store them: a JSON map from provider to its cost, or to an object of cost and tokens (even runs); null
    where nothing was stored (every eleventh). Suppliers are dealt to seven providers."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("provider"))
    used = li.agg(F.round(F.sum("l_extendedprice"), 2).alias("cost_usd"), F.sum("l_quantity").cast("long").alias("input"), F.sum("l_linenumber").cast("long").alias("output"))
    whole = F.to_json(F.struct("cost_usd", "input", "output"))
    entry = F.concat(F.lit('"'), "provider", F.lit('":'), F.when(F.col("l_orderkey") % 2 == 0, whole).otherwise(F.col("cost_usd").cast("decimal(18,2)").cast("string")))
    maps = used.groupBy("l_orderkey").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("costs"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.join(maps, F.col("run_id") == F.col("l_orderkey"), "left").select("run_id", "day", F.when(F.col("run_id") % 11 != 0, F.col("costs")).alias("costs"))


def usage(runs: DataFrame) -> DataFrame:
    """A row for each run and provider of its stored map: cost, input and output tokens (0 where the map holds only numbers). A map that
    can't be read has no rows."""
    each = runs.select("run_id", "day", F.explode(F.from_json("costs", "map<string,string>")).alias("provider", "raw"))
    of = lambda name, kind: F.get_json_object("raw", f"$.{name}").cast(kind)
    plain = F.when(~F.col("raw").startswith("{"), F.expr("try_cast(raw AS double)"))
    return each.select("run_id", "day", "provider", F.coalesce(of("cost_usd", "double"), plain, F.lit(0.0)).alias("cost"), *[F.coalesce(of(t, "long"), F.lit(0)).alias(t) for t in ("input", "output")])


USAGE = """u AS MATERIALIZED (SELECT l_orderkey AS run_id, strftime(any_value(o_orderdate), '%Y-%m-%d') AS day, 'p' || (l_suppkey % 7) AS provider, round(sum(l_extendedprice), 2) AS cost,
 CASE WHEN l_orderkey % 2 = 0 THEN sum(l_quantity)::BIGINT ELSE 0 END AS input, CASE WHEN l_orderkey % 2 = 0 THEN sum(l_linenumber)::BIGINT ELSE 0 END AS output
 FROM lineitem JOIN (SELECT o_orderkey, o_orderdate FROM orders) ON o_orderkey = l_orderkey WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey, 'p' || (l_suppkey % 7))"""


@query("A7_cost_by_day_and_provider", f"WITH {USAGE} SELECT day, " + ", ".join(f"round(sum(cost) FILTER (provider = 'p{i}'), 2) AS p{i}" for i in range(7)) + " FROM u GROUP BY 1")
def a7(spark, sf):
    """A column for each provider that the maps hold."""
    used = usage(stored_costs(spark, sf))
    pivoted = used.groupBy("day").pivot("provider").agg(F.round(F.sum("cost"), 2))
    return pivoted


@query("A7_cost_totals", f"WITH {USAGE} SELECT CASE WHEN grouping(day) = 0 AND grouping(provider) = 0 THEN 'cell' WHEN grouping(day) = 0 THEN 'day' WHEN grouping(provider) = 0 THEN 'provider' ELSE 'all' END AS level, day, provider, round(sum(cost), 2) AS cost, count(DISTINCT run_id) AS runs FROM u GROUP BY GROUPING SETS ((day, provider), (day), (provider), ()) HAVING count(*) > 0")
def a7_totals(spark, sf):
    """Cells, days, providers and all in one pass of grouping sets."""
    used = usage(stored_costs(spark, sf))
    day, provider = F.grouping("day") == 0, F.grouping("provider") == 0
    level = F.when(day & provider, "cell").when(day, "day").when(provider, "provider").otherwise("all")
    return used.cube("day", "provider").agg(level.alias("level"), F.round(F.sum("cost"), 2).alias("cost"), F.count_distinct("run_id").alias("runs")).select("level", "day", "provider", "cost", "runs")


@query("A13_spend_of_a_day", f"WITH {USAGE} SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' ELSE 'all' END AS level, provider, round(sum(cost), 2) AS spent, count(DISTINCT run_id) AS runs FROM u WHERE day = '1998-10-03' GROUP BY GROUPING SETS ((provider), ()) HAVING count(*) > 0")
def a13(spark, sf):
    """What the day's runs have spent so far: by provider, and in all."""
    mine = usage(stored_costs(spark, sf).filter("day = '1998-10-03'"))
    level = F.when(F.grouping("provider") == 0, "provider").otherwise("all")
    return mine.rollup("provider").agg(level.alias("level"), F.round(F.sum("cost"), 2).alias("spent"), F.count_distinct("run_id").alias("runs")).select("level", "provider", "spent", "runs")


@query("A27_run_rollup", f"WITH {USAGE}, s AS (SELECT run_id, round(sum(cost), 2) AS cost, sum(input) FILTER (provider <> 'p0') AS input, sum(output) FILTER (provider <> 'p0') AS output, bool_or(provider = 'p0') AS embedded FROM u GROUP BY 1) SELECT o_orderkey AS run_id, round(coalesce(cost, 0) + CASE WHEN coalesce(embedded, false) THEN 0 ELSE round(o_totalprice / 1000) END, 2)::DOUBLE AS cost, coalesce(input, 0)::BIGINT AS input, coalesce(output, 0)::BIGINT AS output FROM orders LEFT JOIN s ON run_id = o_orderkey")
def a27(spark, sf):
    """Cost and tokens of each run; the vectors' provider counts in the cost alone, through its entry, else by the run's own figure."""
    used = usage(stored_costs(spark, sf))
    judge = F.col("provider") != EMBEDDER
    sums = used.groupBy("run_id").agg(F.round(F.sum("cost"), 2).alias("cost"), *[F.sum(F.when(judge, F.col(t))).alias(t) for t in ("input", "output")], F.bool_or(~judge).alias("embedded"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.round(F.col("o_totalprice") / 1000).alias("own"))
    cost = F.coalesce("cost", F.lit(0.0)) + F.when(F.coalesce("embedded", F.lit(False)), 0.0).otherwise(F.col("own"))
    return own.join(sums, "run_id", "left").select("run_id", F.round(cost, 2).alias("cost"), *[F.coalesce(t, F.lit(0)).alias(t) for t in ("input", "output")])


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, article_id, stage, utility (null for most), signals: the JSON of a candidate's normalised values and effective weights."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("article_id"))
    rows = li.agg(F.min("l_returnflag").alias("stage"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_quantity").alias("q"), F.max("l_suppkey").alias("s"))
    norm = F.struct((F.col("d") * 10).alias("interest"), F.when(F.col("s") % 3 != 0, F.col("t") * 10).alias("knn"), (F.col("q") / 50).alias("feed"))
    weights = F.when(F.col("s") % 5 != 0, F.to_json(F.struct(F.lit(0.5).alias("interest"), F.lit(0.3).alias("knn"), F.when(F.col("s") % 2 == 0, 0.2).alias("feed")))).otherwise("{}")
    text = F.concat(F.lit('{"norm":'), F.to_json(norm), F.lit(',"weights":'), weights, F.lit("}"))
    return rows.select("run_id", "article_id", "stage", F.when(F.col("s") % 7 == 0, F.round(F.col("q"), 2)).alias("utility"), text.alias("signals"))


def stored_blend(signals: Column) -> Column:
    """100 times the sum of weight times value over the names that both stored maps hold; null if they share none. What a reported author
    costs isn't part of it."""
    maps = F.from_json(signals, "norm map<string,double>, weights map<string,double>")
    weights, norm = F.map_entries(maps["weights"]), maps["norm"]
    shared = F.filter(weights, lambda e: e["value"].isNotNull() & F.element_at(norm, e["key"]).isNotNull())
    total = F.aggregate(shared, F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at(norm, e["key"]))
    return F.when(F.size(shared) > 0, total * 100)


@query("O8_near_misses", """WITH c AS (SELECT l_orderkey AS run_id, l_partkey AS article_id, min(l_returnflag) AS stage, min(l_discount) * 10 AS d, min(l_tax) * 10 AS t, min(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN s % 7 = 0 THEN round(q, 2) END AS utility, CASE WHEN s % 5 <> 0 THEN (0.5 * d + CASE WHEN s % 3 <> 0 THEN 0.3 * t ELSE 0 END + CASE WHEN s % 2 = 0 THEN 0.2 * q / 50 ELSE 0 END) * 100 END AS blend FROM c WHERE stage <> 'R'),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(coalesce(utility, blend), 6) DESC NULLS LAST, article_id) AS rank FROM b)
SELECT run_id, article_id, stage, round(coalesce(utility, blend), 6)::DOUBLE AS score, rank::INT AS rank FROM r WHERE rank <= 3""")  # fmt: skip
def o8(spark, sf):
    """The three best of each run that weren't selected, by utility or else by the blend that their stored signals give."""
    rows = stored_signals(spark, sf).filter("stage <> 'R'").withColumn("score", F.round(F.coalesce("utility", stored_blend(F.col("signals"))), 6))
    return top_k(rows, "run_id", [F.desc_nulls_last("score"), F.asc("article_id")], 3).select("run_id", "article_id", "stage", "score", "rank")


@query("V11_evidence", with_views("verdicts latest", """, c AS (SELECT l_orderkey AS run_id, l_partkey AS article_id, min(l_returnflag) AS stage, min(l_discount) * 10 AS d, min(l_tax) * 10 AS t, min(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN s % 7 = 0 THEN round(q, 2) END AS utility, CASE WHEN s % 5 <> 0 THEN (0.5 * d + CASE WHEN s % 3 <> 0 THEN 0.3 * t ELSE 0 END + CASE WHEN s % 2 = 0 THEN 0.2 * q / 50 ELSE 0 END) * 100 END AS blend FROM c WHERE stage <> 'N'),
v AS (SELECT article_id, max_by(CASE WHEN stage = 'R' THEN 0.85 ELSE least(greatest(coalesce(utility, blend) / 100, 0), 1) END, run_id) FILTER (stage = 'R' OR coalesce(utility, blend) IS NOT NULL) AS v FROM b GROUP BY 1)
SELECT article_id, round(coalesce(l.value, v.v), 6)::DOUBLE AS evidence FROM v LEFT JOIN latest l USING (article_id)"""))  # fmt: skip
def v11(spark, sf):
    """What speaks for an article: its verdict, else of its newest run that tells anything 0.85 if it was selected, or its utility, or the
    blend that its stored signals give, on a scale of one."""
    rows = stored_signals(spark, sf).filter("stage <> 'N'")
    told = F.coalesce("utility", stored_blend(F.col("signals"))) / 100
    value = F.when(F.col("stage") == "R", 0.85).otherwise(F.when(told.isNotNull(), F.least(F.greatest(told, F.lit(0.0)), F.lit(1.0))))
    scored = rows.withColumn("v", value).groupBy("article_id").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("run_id"))).alias("v"))
    said = latest_verdicts(spark, sf).select("article_id", "value")
    return scored.join(said, "article_id", "left").select("article_id", F.round(F.coalesce("value", "v"), 6).alias("evidence"))
