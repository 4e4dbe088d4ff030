"""Budgets against a walk, trees and documents by hand, writes and streams by their round trips."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.operators.ranking import latest
from gleanery.operators.trees import changes, dotted, leaves
from gleanery.plans.composites import discussion_refs, section_items
from gleanery.sources import sinks
from gleanery.streaming.verdicts import keep_latest, verdict_stream, weekly_counts

GIVEN = "/root/testdata/sf0.001"


def test_budget_skips_what_does_not_fit(spark):
    orders = {}
    for r in spark.read.parquet(f"{GIVEN}/lineitem.parquet").collect():
        orders.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"], r["l_quantity"]))
    want = []
    for order, items in orders.items():
        used = 0.0
        for item in sorted(items):
            if used + float(item[2]) <= 60:
                used += float(item[2])
                want.append((order, *item))
    got = [tuple(r) for r in registry.queries()["W12_running_budgets"](spark, GIVEN).filter("form = 'skip'").drop("form").collect()]
    assert sorted(got) == sorted(want) and len(got) < sum(map(len, orders.values()))


def test_leaves_inherit_labels_and_links(spark):
    rows = [(1, None, "a", ["x"]), (2, 1, "b", None), (3, 1, "c", ["x", "y"]), (4, 2, "d", ["z"]), (5, None, "e", None)]
    nodes = spark.createDataFrame(rows, "id long, parent long, label string, links array<string>")
    got = {r["id"]: (r["labels"], r["links"]) for r in leaves(nodes).collect()}
    assert got == {3: (["a", "c"], ["x", "y"]), 4: (["a", "b", "d"], ["x", "z"]), 5: (["e"], [])}
    with pytest.raises(ValueError):
        leaves(nodes, most_depth=2)


def test_dotted_paths_and_changes(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":1}},"d":"x","n":null}', '{"a":{"b":{"c":2}},"d":"x","e":[1]}'), (2, None, "{}")], "k int, old string, new string")
    old, new = dotted(docs, "k", "old"), dotted(docs, "k", "new")
    assert sorted((r["path"], r["value"]) for r in old.collect()) == [("a.b.c", "1"), ("d", "x"), ("n", "null")]
    got = sorted((r["path"], r["old_value"], r["new_value"]) for r in changes(old, new, ["k", "path"]).collect())
    assert got == [("a.b.c", "1", "2"), ("e", None, "[1]"), ("n", "null", None)]


def test_readers_leave_other_texts_out(spark):
    bodies = spark.createDataFrame([(1, "nothing"), (2, None), (3, '{"hits":[]}'), (4, '{"hits":[{"objectID":"9","points":3}]}')], "k int, b string")
    assert [tuple(r) for r in discussion_refs(bodies, "k", "b").collect()] == [(4, "hits", 9, 3, None)]
    notes = spark.createDataFrame([(1, "- no\n# Interests\n- one\n  * two\nthree\n# Next\n- no"), (2, "# Other\n- no"), (3, None)], "k int, n string")
    assert [tuple(r) for r in section_items(notes, "k", "n", "interests").collect()] == [(1, 1, "one"), (1, 2, "two")]


def test_partitions_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, day string")
    new = spark.createDataFrame([(9, "b"), (8, "c")], "n int, day string")
    sinks.replace_partitions(old, path, "day")
    sinks.replace_partitions(new, path, "day")
    want = sorted(tuple(r) for r in sinks.replaced(old, new, "day").select("n", "day").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("n", "day").collect()) == want == [(1, "a"), (2, "a"), (8, "c"), (9, "b")]
    sinks.append(new.drop("day"), str(tmp_path / "log"))
    sinks.append(new.drop("day"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_files_by_day_and_feed(spark, tmp_path):
    for name in ("issue-2024-01-02.txt", "issue-2024-01-03.txt", "issue-2024-13-01.txt", "notes.txt"):
        (tmp_path / name).write_text(name)
    files = sinks.named_by_day(spark, f"{tmp_path}/*.txt")
    assert sorted(str(r["day"]) for r in files.collect()) == ["2024-01-02", "2024-01-03"]
    assert [r["name"] for r in sinks.kept_files(files, 1).collect()] == ["issue-2024-01-03.txt"]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert [r["item"] for r in sinks.feed(rows, [F.desc("n")], 1, ["n", "s"]).collect()] == ['{"n":2,"s":null}']


SCHEMA = "event_id long, article_id long, ts timestamp, label string"


def test_stream_equals_the_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 5, at + datetime.timedelta(hours=7 * i), "good" if i % 3 else "loved") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        df.filter(F.col("event_id").between(20 * part, 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the edges come twice
    stream = verdict_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    query = keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    versions = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    want = sorted(map(tuple, latest(df, "article_id", [F.col("ts"), F.col("event_id")]).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(versions[-1])).select(*df.columns).collect())) == want

    counts = weekly_counts(verdict_stream(spark, str(tmp_path / "in"), SCHEMA))
    done = counts.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    by_week = df.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "label").agg(F.count("*").alias("n"))
    closed = by_week.filter(F.date_add("week", 7) < F.lit("2024-01-17"))
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, closed.collect())) != []
