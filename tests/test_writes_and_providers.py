import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators.providers import EMBEDDINGS, OfflineEmbedder, decoded, embedded, scored, through_cache
from gleanery.operators.trees import dotted
from gleanery.operators.writes import Child, cascaded, insert_guarded, upsert_partitions
from gleanery.plans.costs import stored_blend, usage
from gleanery.streaming.latest_state import EVENTS, current, kept
from gleanery.sources.views import verdicts_of


class Counting(OfflineEmbedder):
    """Gives nothing for texts with a question mark, and writes down what it is asked."""

    def __init__(self, folder):
        super().__init__(8)
        self.folder = folder

    def embed(self, texts):
        for t in texts:
            with open(os.path.join(self.folder, f"{abs(hash(t))}-{os.getpid()}-{os.urandom(4).hex()}"), "w") as f:
                f.write(t)
        return [None if "?" in t else v for t, v in zip(texts, super().embed(texts), strict=True)]


def test_offline_vectors_are_unit_and_depend_on_the_text():
    a, b, c = OfflineEmbedder(512).embed(["x", "y", "x"])
    assert np.array_equal(a, c) and not np.array_equal(a, b) and a.dtype == np.dtype("<f4")
    assert abs(float((a.astype(float) ** 2).sum()) - 1) < 1e-6 and np.array_equal(a[:32], a[32:64])


def test_cache_is_asked_by_four_keys_and_written_back(spark, tmp_path):
    texts = [(1, "one"), (2, "two"), (3, None), (4, "why?"), (5, "five"), (6, "six"), (7, "seven")]
    inputs = spark.createDataFrame(texts, "id long, text string")
    provider = Counting(str(tmp_path))
    full = embedded(inputs.withColumn("input_hash", F.sha2(F.coalesce("text", F.lit("")), 256)), OfflineEmbedder(8))
    stored = full.filter("id < 7 AND id <> 4").select(
        "id", F.when(F.col("id") == 2, "other").otherwise(F.col("model")).alias("model"), "dimension",
        F.when(F.col("id") == 5, "old").otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(F.col("id") == 6, F.substring("embedding", 1, 5)).otherwise(F.col("embedding")).alias("embedding"),
    )
    stored = spark.createDataFrame(stored.collect(), EMBEDDINGS)
    found, cache = through_cache(inputs, stored, provider)
    assert {r.id: r.origin for r in found.collect()} == {1: "stored", 3: "stored", 2: "computed", 5: "computed", 6: "computed", 7: "computed"}
    asked = sorted(open(tmp_path / f).read() for f in os.listdir(tmp_path))
    assert asked == ["five", "seven", "six", "two", "why?"]  # each miss once, no hit
    rows = {r.id: r for r in decoded(cache).collect()}
    assert sorted(rows) == [1, 2, 3, 5, 6, 7] and all(len(r.v) == 8 and r.model == "offline-sha256" for r in rows.values())
    again, _ = through_cache(inputs, spark.createDataFrame(cache.collect(), EMBEDDINGS), OfflineEmbedder(8))
    assert {r.id for r in again.filter("origin = 'computed'").collect()} == {4}
    assert through_cache(inputs.limit(0), stored, OfflineEmbedder(8))[0].count() == 0


def test_scores_come_in_batches(spark):
    class Length:
        model = "length"

        def score(self, texts):
            assert len(texts) <= 3
            return [None if not t else float(len(t)) for t in texts]

    rows = scored(spark.createDataFrame([(i, "x" * i or None) for i in range(10)], "id long, text string"), Length(), batch=3).collect()
    assert sorted((r.id, r.score) for r in rows) == [(0, None)] + [(i, float(i)) for i in range(1, 10)]


def test_deletes_reach_all_children(spark):
    tables = {
        "a": spark.createDataFrame([(1, True), (2, False), (None, True), (3, None)], "id long, gone boolean"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 1)], "id long, a long"),
        "c": spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 13), (104, 99)], "id long, b long"),
        "d": spark.createDataFrame([(7, 1), (8, 3)], "id long, a long"),
    }
    left = cascaded(tables, "a", F.col("gone"), [Child("b", "a", "a", "id"), Child("c", "b", "b", "id"), Child("d", "a", "a", "id", keep=True)])
    ids = lambda n: sorted((tuple(r) for r in left[n].collect()), key=str)
    assert ids("a") == [(2, False), (3, None)]
    assert ids("b") == [(11, 2), (12, None)]
    assert ids("c") == [(101, 11), (102, 12), (104, 99)]
    assert ids("d") == [(7, None), (8, 3)]


def test_a_guard_holds_for_open_rows_alone(spark):
    schema = "id long, mail string, status string"
    held = spark.createDataFrame([(1, "A@x", "open"), (2, "b@x", "done")], schema)
    new = spark.createDataFrame([(3, "a@X", "open"), (4, "B@x", "open"), (5, "b@x", "open"), (6, "a@x", "done"), (7, None, "open"), (8, None, "open"), (9, "c@x", None)], schema)
    got = insert_guarded(held, new, F.lower("mail"), F.col("status") == "open", ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 6, 7, 8, 9]


def test_upserts_leave_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", "b"), (4, "x", "c"), (5, "x", "d")], "k long, v string, p string")
    old.repartition("p").write.partitionBy("p").parquet(path)
    files = lambda p: sorted((f, os.stat(f"{path}/p={p}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/p={p}"))
    before = {p: files(p) for p in "abcd"}
    new = spark.createDataFrame([(2, "y", "b"), (4, "y", "b"), (9, "y", "e")], "k long, v string, p string")
    for _ in range(2):  # a repeated run leaves the same
        upsert_partitions(spark, path, new, "k", "p")
        rows = spark.read.schema("k long, v string, p string").parquet(path)
        assert sorted(map(tuple, rows.collect())) == [(1, "x", "a"), (2, "y", "b"), (3, "x", "b"), (4, "y", "b"), (5, "x", "d"), (9, "y", "e")]
    assert (files("a"), files("d")) == (before["a"], before["d"])
    assert not os.path.exists(f"{path}/p=c")


def test_dotted_documents_of_any_depth(spark):
    deep = '{"a":' * 9 + "1" + "}" * 9
    docs = spark.createDataFrame([(1, deep), (2, '{"x":[1,{"y":null}],"e":{},"l":[],"s":"t.u","n":1.5,"b":false,"o":{"z":null}}'), (3, "no json"), (4, None), (5, "7"), (6, "null")], "k long, d string")
    got = sorted((r.k, r.path, r.value) for r in dotted(docs, "k", "d").collect())
    assert got == [(1, "a." * 8 + "a", "1"), (2, "b", "false"), (2, "l", "[]"), (2, "n", "1.5"), (2, "o.z", "null"), (2, "s", "t.u"), (2, "x", '[1,{"y":null}]'), (5, "", "7")]


def test_maps_of_costs_in_both_forms(spark):
    runs = spark.createDataFrame([(1, "d", '{"p":1.5,"q":{"cost_usd":2,"input":7}}'), (2, "d", None), (3, "d", "broken"), (4, "e", '{"p":{"output":3},"r":"x"}')], "run_id long, day string, costs string")
    got = sorted(tuple(r) for r in usage(runs).collect())
    assert got == [(1, "d", "p", 1.5, 0, 0), (1, "d", "q", 2.0, 7, 0), (4, "e", "p", 0.0, 0, 3), (4, "e", "r", 0.0, 0, 0)]


def test_a_stored_blend_folds_over_shared_names(spark):
    rows = spark.createDataFrame([(1, '{"norm":{"a":0.5,"b":1},"weights":{"a":0.4,"c":0.6}}'), (2, '{"norm":{"a":1},"weights":{}}'), (3, '{"norm":{"b":1},"weights":{"a":1}}'), (4, None), (5, "{}")], "id long, s string")
    assert {r.id: r.b for r in rows.select("id", stored_blend(F.col("s")).alias("b")).collect()} == {1: pytest.approx(20), 2: None, 3: None, 4: None, 5: None}


def test_late_and_repeated_rows_and_tombstones_of_the_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 10) + datetime.timedelta(hours=h)
    row = lambda i, h, who, kind, k=2: (i, at(h), who, kind, 1.0, f'{{"k": {k}}}')
    batches = [
        [row(1, 0, 1, "click"), row(2, 1, 1, "purchase"), row(3, 1, 2, "click"), row(9, 5, 2, "error", k=3), row(4, 3, None, "click")],
        [row(5, 0.5, 1, "error"), row(2, 1, 1, "purchase"), row(6, 2, 2, "view"), row(3, 1, 2, "click"), row(11, 4, 3, "click"), row(10, 4, 3, "error")],
        [row(7, 1.5, 2, "purchase"), row(8, 60, 4, "click")],
        [row(12, 61, 2, "signup"), row(1, 0, 1, "click")],
    ]
    want = [{1: 2, 2: 3}, {1: 2, 3: 11}, {1: 2, 3: 11, 4: 8}, {1: 2, 2: 12, 3: 11, 4: 8}]
    for rows, now in zip(batches, want, strict=True):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        kept(verdicts_of(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "log"))), str(tmp_path))
        assert {r.article_id: r.id for r in current(spark, str(tmp_path)).collect()} == now
