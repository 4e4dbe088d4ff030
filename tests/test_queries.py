"""Every registered query of the reference's own operators against its SQL, and those without SQL against brute force."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.operators import ranking
from gleanery.sources import sinks, views
from gleanery.plans import curation, lookups, signals

GIVEN = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{GIVEN}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    df = registry.queries()[name](spark, GIVEN)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    rows = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == rows


def test_leader_clusters_by_hand(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, near), (2, 2, [0.9, 0.1]), (3, 3, far), (4, 4, None), (5, 5, [0.0, 0.0]), (6, 6, [0.1, 0.9]), (7, 7, near)]
    df = spark.createDataFrame(rows, "item long, rank int, v array<double>")
    got = {r["item"]: r["cluster"] for r in ranking.leader_clusters(df, 0.9, 6).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3}


def test_the_flagship_shortlists_the_day_by_utility(spark):
    day = curation.day_of(spark, GIVEN)
    held = {r.vec_id: np.array(r.v) / np.linalg.norm(r.v) for r in views.vectors(spark, GIVEN).collect()}
    order = [r.article_id for r in day["deep"].orderBy(F.desc_nulls_last("utility"), "article_id").collect()]
    leaders, want = [], {}
    for item in order:
        v = held.get(item)
        want[item] = next((i for i in leaders if v is not None and v @ held[i] >= curation.DAY_THRESHOLD), item)
        if want[item] == item and v is not None:
            leaders.append(item)
    got = sorted(registry.flagship(spark, GIVEN).collect(), key=lambda r: r["rank"])
    assert [r["item"] for r in got] == order and {r["item"]: r["cluster"] for r in got} == want
    assert sum(r["stage"] == "shortlisted" for r in got) == min(60, len(order))
    assert all(r["stage"] == "shortlisted" for r in got[:10])


def test_clusters_of_the_shortlist_by_brute_force(spark):
    rows = sorted(signals.ranked_vectors(spark, GIVEN).collect(), key=lambda r: r["rank"])
    leaders, want = [], {}
    for r in rows:
        v = np.array(r["v"]) / np.linalg.norm(r["v"])
        lead = next((i for i, w in leaders if v @ w >= signals.CLUSTER_THRESHOLD), None)
        if lead is None:
            leaders.append((r["item"], v))
        want[r["item"]] = lead or r["item"] if lead is not None else r["item"]
    got = signals.shortlist(spark, GIVEN).collect()
    assert {r["item"]: r["cluster"] for r in got} == want
    assert all(r["stage"] == "shortlisted" for r in got if r["rank"] <= 10)


def test_shortlist_relaxes_its_caps_by_hand(spark):
    # one cluster of nine, two of two; an automatic item and explorers stand at the end
    rows = [(i, i, 1 if i <= 9 else 2 if i <= 11 else 3, i == 13, i in (8, 9)) for i in range(1, 14)]
    df = spark.createDataFrame(rows, "item long, rank int, cluster long, auto boolean, exploration boolean")
    out = lambda keep: {r["item"]: (r["stage"] == "shortlisted", r["reason"]) for r in ranking.diversified(df, keep, 1, 2, explorers=1).collect()}
    # 1 is protected, 13 automatic, 8 explored: cluster 1 holds two, so 10, 11 and 12 come before 2 to 7 and 9
    got = out(6)
    assert [i for i, (kept, _) in got.items() if kept] == [1, 8, 10, 11, 12, 13]
    assert all(got[i][1] == "cluster_suppressed" for i in (2, 3, 4, 5, 6, 7, 9))
    assert [i for i, (kept, _) in out(8).items() if kept] == [1, 2, 3, 8, 10, 11, 12, 13]  # a third one, then no cap
    got = out(4)
    assert [i for i, (kept, _) in got.items() if kept] == [1, 8, 10, 13] and got[11][1] == "shortlist_cap" and got[12][1] == "shortlist_cap" and got[2][1] == "cluster_suppressed" and got[9][1] == "cluster_suppressed"
    assert sum(kept for kept, _ in out(1).values()) == 2
    assert ranking.diversified(df.limit(0), 5, 1, 2).collect() == []


def test_nearest_in_blocks_equals_trying_every_pair(spark):
    r = np.random.default_rng(0)
    v = np.round(r.standard_normal((90, 6)), 1)
    v[40:60] = v[3]  # ties
    left = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "left_id long, v array<double>")
    right = spark.createDataFrame([(i, v[i].tolist(), 1.0 if i % 3 else -1.0) for i in range(0, 90, 2)] + [(902, None, 1.0)], "right_id long, w array<double>, value double")
    want = set()
    for i in range(90):
        for value in (1.0, -1.0):
            found = sorted((-round(float(np.cumsum(v[i] * v[j])[-1]), 9), j) for j in range(0, 90, 2) if j != i and (1.0 if j % 3 else -1.0) == value)[:4]
            want |= {(i, value, j, rank, -s) for rank, (s, j) in enumerate(found, 1)}
    for how in ({}, {"most": 10, "block": 16}):
        got = {(x["left_id"], x["value"], x["right_id"], x["rank"], round(x["score"], 9)) for x in ranking.nearest(left, right, 4, **how).collect()}
        assert got == {(*w[:4], w[4] + 0.0) for w in want}
    assert ranking.nearest(left, right.limit(0), 4).collect() == []


def test_a_candidate_counts_once_for_each_rated_article(spark, tmp_path):
    """Repeated rows of vectors and labels, against the three nearest and the set of ids seen of the reference."""
    r = np.random.default_rng(4)
    drawn = np.round(r.standard_normal((9, 3)), 2).tolist()
    held = [(i, drawn[i]) for i in [*range(9), 2, 5, 5]]
    given = [(i, i % 2, 0) for i in [0, 2, 4, 5, 6, 2]]
    lines = [(run, i, "R" if (run + i) % 3 else "A", "O", 1.0) for run in (1, 2) for i in range(7)]
    tables = {
        "embeddings": spark.createDataFrame([(i, v, 0) for i, v in held], "vec_id long, embedding array<float>, label int"),
        "labels": spark.createDataFrame(given, "doc_id long, quality int, toxic int"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_extendedprice double"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    vector = {i: np.array(v, np.float32).astype(float) for i, v in held}
    rated = [i for i, _, _ in given for j, _ in held if i == j]
    want = {}
    for i in vector:
        copies = sum(j == i for j, _ in held)
        scored = sorted((-round(float(np.cumsum(vector[i] * vector[j])[-1]), 9), j) for j in rated * copies if j != i)[:3]
        for j in {j for _, j in scored}:
            listed, selected = want.get(j, (0, 0))
            want[j] = (listed + 1, selected + (i < 7 and (2 + i) % 3 != 0))
    got = registry.queries()["A28_neighbour_usage"](spark, str(tmp_path)).collect()
    assert {x["right_id"]: (x["listed"], x["selected"]) for x in got} == want
    assert {j: (a, b) for j, a, b in con.sql(registry.oracle_sql()["A28_neighbour_usage"]).fetchall()} == want


def test_mid_rank_of_equal_and_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 2), (3, None, None)], "id int, x double, y int")
    got = {r["id"]: (r["p"], r["q"]) for r in ranking.mid_ranks(df, "id", {"x": "p", "y": "q"}).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.5, 1.0), 3: (None, None)}
    many = spark.createDataFrame([(i, float(i // 3)) for i in range(300)], "id int, x double")
    got = {r["id"]: r["p"] for r in ranking.mid_ranks(many, "id", {"x": "p"}).collect()}
    assert all(abs(got[i] - (i // 3 * 3 + 2) / 300) < 1e-12 for i in range(300))


def test_similarities_in_slices(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "left_id long, v array<double>")
    right = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "right_id long, w array<double>")
    whole = sorted(ranking.similarities(left, right).collect())
    assert sorted(ranking.similarities(left, right, most=2).collect()) == whole and len(whole) == 14


def test_writes_by_key_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, s string, n int")
    once = ranking.upsert(old, new, "k")
    assert sorted(once.collect()) == sorted(ranking.upsert(once, new, "k").collect())
    kept = sorted(ranking.upsert_keeping(old, new, "k", ["s", "n"]).collect(), key=lambda r: r["k"])
    assert [tuple(r) for r in kept] == [(1, "a", 1), (2, "b", 5), (3, "c", None)]


def test_optional_filters_and_pages(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 2)
    assert lookups.matching(df, x=None, id=None).count() == 10 and lookups.matching(df, x=1).count() == 5
    assert [r["id"] for r in lookups.page(df, 0, 3, [F.desc("id")]).collect()] == [9, 8, 7]
    assert [r["id"] for r in lookups.page(df, 4, 3, [F.desc("id")]).collect()] == [0]


def test_canonical_addresses_are_idempotent(spark):
    cases = spark.createDataFrame([(raw,) for raw, want in curation.ADDRESSES if want], "raw string")
    rows = cases.select(curation.canonical_url(F.col("raw")).alias("once")).withColumn("twice", curation.canonical_url(F.col("once"))).collect()
    assert rows and all(r["once"] == r["twice"] for r in rows)


def test_files_are_published_as_a_whole_and_again(spark, tmp_path):
    for text in ("old", "new"):
        sinks.publish(spark.createDataFrame([(text,)], "value string"), str(tmp_path), "issue-2024-02-03")
    sinks.publish(spark.createDataFrame([("x",)], "value string"), str(tmp_path), "notes")
    (tmp_path / ".draft-issue-2024-02-04-z").mkdir()
    rows = sinks.named_by_day(spark, f"{tmp_path}/*").collect()
    assert [(str(r["day"]), r["name"], r["value"]) for r in rows] == [("2024-02-03", "issue-2024-02-03", "new")]
