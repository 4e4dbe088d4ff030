"""Settings as documents of any depth: what changed from one to the next, and its record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.trees import changes, dotted
from gleanery.sources.sinks import append, drafts
from gleanery.sources.views import table

from .catalog import query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, old, new: settings of six levels with arrays; some are text that isn't JSON, some have lost or won parts."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def text(shift: int) -> F.Column:
        deep = F.struct(F.struct(F.struct(((k + shift * (k % 5 == 0).cast("int")) % 100).alias("floor"), F.lit(True).alias("on")).alias("knn")).alias("gates"))
        names = F.when(k % 3 == 0, F.array(F.lit("a"), F.col("c_mktsegment"))).otherwise(F.array(F.lit("a"), F.col("c_mktsegment"), F.lit("b") if shift else F.lit("c")))
        body = F.struct(F.struct(F.struct(deep.alias("signals")).alias("ranking"), F.when(k % 4 != shift, F.col("c_nationkey")).alias("nation")).alias("curation"), names.alias("sections"), F.array(F.struct(F.lit("x").alias("name"), (k % 7 + shift).alias("n"))).alias("providers"))
        return F.when(k % 50 == 49, "not json").otherwise(F.to_json(body))

    return c.select(k.alias("run"), text(0).alias("old"), text(1).alias("new"))


SIDES = """k AS (SELECT c_custkey AS run, c_nationkey AS nation, c_mktsegment AS seg FROM customer WHERE c_custkey % 50 <> 49),
o AS (SELECT run, 'curation.ranking.signals.gates.knn.floor' AS path, (run % 100)::VARCHAR AS value FROM k UNION ALL SELECT run, 'curation.ranking.signals.gates.knn.on', 'true' FROM k UNION ALL SELECT run, 'curation.nation', nation::VARCHAR FROM k WHERE run % 4 <> 0
 UNION ALL SELECT run, 'sections', '["a","' || seg || CASE WHEN run % 3 <> 0 THEN '","c"]' ELSE '"]' END FROM k UNION ALL SELECT run, 'providers', '[{"n":' || (run % 7) || ',"name":"x"}]' FROM k),
n AS (SELECT run, 'curation.ranking.signals.gates.knn.floor' AS path, ((run + (run % 5 = 0)::INT) % 100)::VARCHAR AS value FROM k UNION ALL SELECT run, 'curation.ranking.signals.gates.knn.on', 'true' FROM k UNION ALL SELECT run, 'curation.nation', nation::VARCHAR FROM k WHERE run % 4 <> 1
 UNION ALL SELECT run, 'sections', '["a","' || seg || CASE WHEN run % 3 <> 0 THEN '","b"]' ELSE '"]' END FROM k UNION ALL SELECT run, 'providers', '[{"n":' || (run % 7 + 1) || ',"name":"x"}]' FROM k),
d AS (SELECT run, path, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n USING (run, path) WHERE o.value IS DISTINCT FROM n.value)"""


@query("A29_config_changes", f"WITH {SIDES} SELECT run, path, old_value, new_value FROM d")
def a29(spark, sf):
    docs = documents(spark, sf)
    return changes(dotted(docs, "run", "old"), dotted(docs, "run", "new"), ["run", "path"])


@query("K33_settings_changes", f"WITH {SIDES} SELECT 'setup' AS who, run, path, NULL AS old_value, value AS new_value FROM o UNION ALL SELECT 'user ' || (run % 3), run, path, old_value, new_value FROM d")
def k33(spark, sf):
    """The record of changes: the first save appends every setting, the second what changed; the record is read back."""
    docs, path = documents(spark, sf), drafts(spark, "audit")
    old, new = dotted(docs, "run", "old"), dotted(docs, "run", "new")
    columns = ["who", "run", "path", "old_value", "new_value"]
    append(old.select(F.lit("setup").alias("who"), "run", "path", F.lit(None).cast("string").alias("old_value"), F.col("value").alias("new_value")), path)
    append(changes(old, new, ["run", "path"]).withColumn("who", F.concat(F.lit("user "), (F.col("run") % 3).cast("string"))).select(*columns), path)
    return spark.read.schema("who string, run long, path string, old_value string, new_value string").parquet(path)
