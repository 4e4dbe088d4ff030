"""Trees, budgets and settings: rows under their ancestors, ordered budgets, nested documents side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.sinks import staged


def leaves(nodes: DataFrame, links: str = "links", most_depth: int = 16) -> DataFrame:
    """id, labels from the root down and distinct inherited links of the nodes (id, parent, label, links) without children.

    One join for each level, the level's rows against the nodes; it ends when a level is empty, and fails beyond ``most_depth``.
    """
    inner = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    level = nodes.filter("parent IS NULL").select("id", F.array("label").alias("labels"), F.array_distinct(F.coalesce(links, F.array())).alias("links"))
    found = level
    for _ in range(most_depth):
        if level.isEmpty():
            return found.join(inner, "id", "left_anti")
        above = level.select(F.col("id").alias("parent"), F.col("labels").alias("__labels"), F.col("links").alias("__links"))
        level = nodes.join(above, "parent").select("id", F.concat("__labels", F.array("label")).alias("labels"), F.array_distinct(F.concat("__links", F.coalesce(links, F.array()))).alias("links"))
        found = found.union(level)
    raise ValueError(f"a tree is deeper than {most_depth}")


def within_budget(items: Column, cost: str, budget: float) -> Column:
    """Of an ordered array of structs those that fit, one after the other, into the budget; one that doesn't is skipped and the
    next is tried."""
    start = F.struct(F.lit(0.0).alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    spent = lambda acc, x: acc["used"] + x[cost].cast("double")
    add = lambda acc, x: F.when(spent(acc, x) <= budget, F.struct(spent(acc, x).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    return F.aggregate(items, start, add, lambda acc: acc["kept"])


def until_budget(items: Column, cost: str, budget: float) -> Column:
    """Of an ordered array of structs the first ones that fit into the budget together; nothing is tried after one that
    doesn't."""
    start = F.struct(F.lit(0.0).alias("used"), F.lit(True).alias("open"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    spent = lambda acc, x: acc["used"] + x[cost].cast("double")
    add = lambda acc, x: F.struct(spent(acc, x).alias("used"), F.lit(True).alias("open"), F.concat(acc["kept"], F.array(x)).alias("kept"))
    stop = lambda acc: F.struct(acc["used"].alias("used"), F.lit(False).alias("open"), acc["kept"].alias("kept"))
    return F.aggregate(items, start, lambda acc, x: F.when(acc["open"] & (spent(acc, x) <= budget), add(acc, x)).otherwise(stop(acc)), lambda acc: acc["kept"])


def pruned(nodes: DataFrame, group: str, top: int, children: int, depth: int) -> DataFrame:
    """The nodes (group, id, parent, points, seq and others) of trees that stay: of the roots of a group the ``top`` first, of
    each node's children the ``children`` first, both by points and then in the order of seq, down to ``depth`` levels. Adds
    path, the places from the root down. One join for each level."""
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("points"), "seq"))
    level = nodes.filter("parent IS NULL").withColumn("__k", place([group])).filter(F.col("__k") <= top)
    level = level.withColumn("path", F.array("__k")).drop("__k")
    found = level
    for _ in range(depth - 1):
        above = level.select(F.col(group).alias("__g"), F.col("id").alias("__up"), F.col("path").alias("__path"))
        below = nodes.join(above, (F.col(group) == F.col("__g")) & (F.col("parent") == F.col("__up")))
        below = below.withColumn("__k", place([group, "parent"])).filter(F.col("__k") <= children)
        level = below.withColumn("path", F.concat("__path", F.array("__k"))).select(*level.columns)
        found = found.union(level)
    return found


def within_word_budget(nodes: DataFrame, group: str, budget: int) -> DataFrame:
    """Of pruned nodes (group, id, parent, path, words) those that a walk in render order keeps: a node that doesn't fit ends the
    list it stands in, with all below, and the walk goes on after its parent. A group is as small as its pruning leaves it."""
    row = F.struct("path", "id", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("words").cast("long").alias("words"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array(F.lit(-1).cast("long")).alias("open"), F.array().cast("array<long>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        in_ = F.array_contains(acc["open"], x["parent"])
        fits = in_ & (x["words"] <= acc["left"])
        took = F.struct((acc["left"] - x["words"]).alias("left"), F.concat(acc["open"], F.array(x["id"])).alias("open"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))
        shut = F.struct(acc["left"].alias("left"), F.array_remove(acc["open"], x["parent"]).alias("open"), acc["kept"].alias("kept"))
        return F.when(fits, took).when(in_, shut).otherwise(acc)

    kept = nodes.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(group, F.explode(F.aggregate("rows", start, step, lambda acc: acc["kept"])).alias("id"))
    return nodes.join(kept, [group, "id"], "left_semi")


def dotted(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, value of the leaves of JSON documents of any depth, names parted by dots. Values are text; an array stays whole, as compact
    JSON, so one in another order is one change; a null within a document is ``null``; empty objects have no leaves. A text that isn't
    JSON, or null, has none either.

    Objects are opened a level at a time, until none is left; a level is written once."""
    rows = df.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("v")).filter("v IS NOT NULL AND NOT is_variant_null(v)")
    value = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    done = None
    while True:
        level = staged(rows.select(key, "path", F.to_json("v").alias("text"), F.schema_of_variant("v").startswith("OBJECT<").alias("opens"), value.alias("value")), "dotted")
        flat = level.filter("NOT opens").select(key, F.substring("path", 2, 2**31 - 1).alias("path"), "value")
        done = flat if done is None else done.union(flat)
        below = level.filter("opens")
        if below.isEmpty():
            return done
        below.select(key, "path", F.parse_json("text").alias("v")).createOrReplaceTempView("__dotted")
        rows = df.sparkSession.sql(f"SELECT t.`{key}`, concat(t.path, '.', e.key) AS path, e.value AS v FROM __dotted t, LATERAL variant_explode(t.v) e")


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, old_value, new_value where the values differ or only one side has the keys."""
    both = old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), keys, "full")
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
