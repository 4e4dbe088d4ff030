"""Admission, the lineup and entity resolution against walks through the rows in their order."""

import random

from pyspark.sql import functions as F

from gleanery import registry
from gleanery.operators.admission import Retriever, admit, lineup, pool
from gleanery.operators.resolution import merge, resolve


def walked(rows):
    """Clusters by a walk: first key, else second key, else a new one."""
    one, two, out = {}, {}, {}
    for seq, a, b in rows:
        cluster = one.get(a, two.get(b, seq) if b is not None else seq) if a is not None else two.get(b, seq) if b is not None else seq
        if a is not None:
            one.setdefault(a, cluster)
        if b is not None:
            two.setdefault(b, cluster)
        out[seq] = cluster
    return out


def test_resolution_equals_the_walk(spark):
    draw = random.Random(5)
    for keys in (4, 12, 40):
        rows = [(i, draw.choice([None, *"abcdefghijklmnopqrstuvwxyz"[: min(keys, 26)]]), draw.choice([None, *map(str, range(keys))])) for i in range(60)]
        df = spark.createDataFrame(rows, "seq long, a string, b string")
        assert {r["seq"]: r["cluster"] for r in resolve(df, "seq", "a", "b").collect()} == walked(rows)


def test_resolution_of_a_long_chain_and_of_nothing(spark):
    rows = [(0, "u0", "t0")] + [(i, f"u{i // 2 if i % 2 == 0 else i // 2 + 1}x", f"t{(i + 1) // 2}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    assert {r["seq"]: r["cluster"] for r in resolve(df, "seq", "a", "b").collect()} == walked(rows)
    assert resolve(df.limit(0), "seq", "a", "b").count() == 0


def test_merge_prefers_direct_authors_and_the_last_best_link(spark):
    rows = [
        (1, 1, "u1", 10, None, "d3", "https://lobste.rs/s/1", "submitter", False),
        (2, 1, "u2", 50, "d2", "d4", "https://news.ycombinator.com/1", " ", True),
        (3, 1, "u3", 50, "d5", "d5", "https://news.ycombinator.com/2", "writer", True),
        (4, 4, "u4", 0, None, "d9", None, None, False),
    ]
    df = spark.createDataFrame(rows, "entry_id long, cluster long, url string, words int, published string, fetched string, comments string, author string, direct boolean")
    first, second = sorted(merge(df).collect(), key=lambda r: r["cluster"])
    assert (first["best_entry"], first["first_seen"], first["published"], first["sources"], first["comments"], first["author"]) == (2, "d2", "d2", [1, 2, 3], "https://news.ycombinator.com/2", "writer")
    assert (second["best_entry"], second["comments"], second["author"]) == (4, None, None)


CANDIDATES = "article_id long, auto boolean, t double, b double"


def admitted(spark, rows, keep, quota, slots=1):
    df = spark.createDataFrame(rows, CANDIDATES)
    out = admit(df, keep, [Retriever("judge", F.col("t"), quota)], F.lit(True), slots, F.col("article_id").cast("string"), F.col("b"))
    return {r["article_id"]: r["admitted_by"] for r in out.collect()}


def test_admission_by_hand(spark):
    rows = [(1, True, None, None), (2, False, 9.0, 1.0), (3, False, 8.0, 9.0), (4, False, 7.0, 8.0), (5, False, None, 7.0), (6, False, None, 6.0), (7, False, None, 5.0), (8, False, None, 4.0)]
    got = admitted(spark, rows, keep=5, quota=2)
    # the automatic one, two judged, one explorer from the places 6 and 7 of the blend (2, which is in and gets signed, and 8),
    # then the best of the blend, which has one place left and signs the first of its own list
    assert got == {1: "auto_include", 2: "judge,exploration", 3: "judge,blend", 4: "blend", 5: None, 6: None, 7: None, 8: "exploration"}


def test_automatic_rows_are_all_in_and_leave_no_room(spark):
    rows = [(i, i < 6, float(i), float(i)) for i in range(9)]
    got = admitted(spark, rows, keep=3, quota=2)
    assert [got[i] is not None for i in range(9)] == [True] * 6 + [False] * 3
    assert admitted(spark, [], keep=3, quota=2) == {}


def test_pool_fills_up_and_never_drops(spark):
    rows = [(i, i == 9, None if i % 2 else float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, CANDIDATES)
    got = {r["article_id"] for r in pool(df, 5, 0.4, 2, "b", ["t"]).collect() if r["pooled"]}
    assert got == {9, 8, 6, 7, 5}  # nine and eight by blend, eight and six by signal, then the fill


def test_lineup_by_hand(spark):
    picks = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 2), (99, "a", 0)], "article_id long, section string, place int")
    known = spark.createDataFrame([(1, False, 1.0, "h"), (2, False, 5.0, "h"), (3, True, None, "h"), (4, False, 9.0, "h")], "article_id long, auto boolean, score double, home string")
    got = sorted(tuple(r) for r in lineup(picks, known, 3).collect())
    assert got == [(1, "b", 1, True), (2, "a", 1, False), (3, "h", 1, False)]
    assert {r["article_id"] for r in lineup(picks, known, 2).collect()} == {2, 3}


def test_ranks_inside_clusters_are_gapless(spark):
    rows = registry.queries()["W9_rank_inside_cluster"](spark, "/root/testdata/sf0.001").collect()
    by_cluster = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by_cluster.setdefault(r["cluster"], []).append(r["cluster_rank"])
    assert by_cluster and all(ranks == list(range(1, len(ranks) + 1)) for ranks in by_cluster.values())
