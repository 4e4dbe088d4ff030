"""Writes that behave like queries: cascades, guarded inserts, replaced and upserted partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators.writes import Child, cascaded, insert_guarded, upsert_partitions
from gleanery.sources.sinks import drafts, replace_partitions
from gleanery.sources.views import table

from .catalog import query

GONE = "c_acctbal < 0"


@query("W_cascade_delete", f"""WITH c AS (SELECT * FROM customer WHERE NOT coalesce({GONE}, false)), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {GONE})), l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)))
SELECT 'customer' AS tbl, c_custkey AS key, c_nationkey::BIGINT AS pointer, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'orders', o_orderkey, o_custkey, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'lineitem', l_orderkey, NULL, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 'events', event_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE {GONE}) THEN user_id END, count(*) FROM events GROUP BY ALL""")  # fmt: skip
def cascade(spark, sf):
    """Customers with debts go, with their orders and the items of those; events stay and forget them."""
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem", "events")}
    down = [Child("orders", "customer", "o_custkey", "c_custkey"), Child("lineitem", "orders", "l_orderkey", "o_orderkey"), Child("events", "customer", "user_id", "c_custkey", keep=True)]
    left = cascaded(tables, "customer", F.expr(GONE), down)
    count = lambda n, key, pointer: left[n].select(F.lit(n).alias("tbl"), F.col(key).cast("long").alias("key"), pointer.cast("long").alias("pointer")).groupBy("tbl", "key", "pointer").agg(F.count("*").alias("n"))
    out = count("customer", "c_custkey", F.col("c_nationkey"))
    for n, key, pointer in (("orders", "o_orderkey", F.col("o_custkey")), ("lineitem", "l_orderkey", F.lit(None)), ("events", "event_id", F.col("user_id"))):
        out = out.unionByName(count(n, key, pointer))
    return out


@query("W_guarded_insert", """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'User' ELSE 'user' END || user_id || '@example.com' AS email, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'open' END AS status FROM events),
a AS (SELECT *, lower(email) AS k FROM r), held AS (SELECT * FROM a WHERE id < 100 AND (status = 'done' OR id = (SELECT min(id) FROM a b WHERE b.k = a.k AND b.status = 'open'))),
new AS (SELECT *, row_number() OVER (PARTITION BY k, status ORDER BY id) AS place FROM a WHERE id >= 100)
SELECT id, email, status FROM held UNION ALL SELECT id, email, status FROM new WHERE status = 'done' OR (place = 1 AND k NOT IN (SELECT k FROM held WHERE status = 'open'))""")  # fmt: skip
def guarded(spark, sf):
    """Requests by e-mail, of which one may be open, whatever the case of its letters; handled ones don't count."""
    e = table(spark, sf, "events")
    email = F.concat(F.when(F.col("event_id") % 3 == 0, "User").otherwise("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    rows = e.select(F.col("event_id").alias("id"), email.alias("email"), F.when(F.col("event_type") == "purchase", "done").otherwise("open").alias("status"))
    open_, key = F.col("status") == "open", F.lower("email")
    none = rows.filter(F.lit(False))
    held = insert_guarded(none, rows.filter("id < 100"), key, open_, ["id"])
    return insert_guarded(held, rows.filter("id >= 100"), key, open_, ["id"])


ORDERS_BY_MONTH = "o AS (SELECT o_orderkey AS k, o_totalprice AS cost, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


def by_month(spark, sf, name):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("cost"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    path = drafts(spark, name)
    o.repartition("month").write.partitionBy("month").parquet(path)
    return o, path


def read_back(spark, path):
    return spark.read.schema("k long, cost double, month string").parquet(path)


@query("S14_written_months", f"WITH {ORDERS_BY_MONTH}, n AS (SELECT k, 0.0::DOUBLE AS cost, month FROM o WHERE k % 1999 = 1) SELECT k, cost::DOUBLE AS cost, month FROM o WHERE month NOT IN (SELECT month FROM n) UNION ALL FROM n")
def written_months(spark, sf):
    """The months of the new rows are replaced on disk by these rows; the answer is read back."""
    o, path = by_month(spark, sf, "s14")
    replace_partitions(o.filter("k % 1999 = 1").withColumn("cost", F.lit(0.0)).repartition("month"), path, "month")
    return read_back(spark, path)


@query("S11_written_upserts", f"WITH {ORDERS_BY_MONTH}, n AS (SELECT k, cost + 1 AS cost, CASE WHEN k % 2 = 0 THEN month ELSE '2031-01' END AS month FROM o WHERE k % 997 = 3 UNION ALL SELECT -k - 1, cost, month FROM o WHERE k % 997 = 4) SELECT k, cost::DOUBLE AS cost, month FROM (FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL FROM n)")
def written_upserts(spark, sf):
    """Changed rows, some of them moved to another month, and new ones; untouched months keep their files."""
    o, path = by_month(spark, sf, "s11")
    changed = o.filter("k % 997 = 3").select("k", (F.col("cost") + 1).alias("cost"), F.when(F.col("k") % 2 == 0, F.col("month")).otherwise("2031-01").alias("month"))
    upsert_partitions(spark, path, changed.union(o.filter("k % 997 = 4").select((-F.col("k") - 1).alias("k"), "cost", "month")), "k", "month")
    return read_back(spark, path)
