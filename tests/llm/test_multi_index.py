import math

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, cell long"


def brute(rows, every, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scores = [(-float(np.cumsum(q * v)[-1]), j) for j, v in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def search(df, every=20, **how):
    out = {}
    for r in sorted(multi_index.search(df, "vec_id", "embedding", F.col("vec_id") % every == 0, **how).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_the_whole_walk_is_the_exact_search_with_ties_and_awkward_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(100)]  # copies: ties by id
    rows += [(600, None), (620, [0.0] * 8), (640, [float("nan")] + [1.0] * 7), (660, [1.0] * 7 + [None]), (680, [float("inf")] + [0.0] * 7), (700, [1.0] * 3)]
    want = brute([x for x in rows if x[0] != 700], 20)
    got = search(table(spark, rows), share=1.0)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])]
    assert {q: [v for v, _ in x] for q, x in search(table(spark, rows)).items()} == {0: [1, 2]}
    assert search(table(spark, [])) == {} and search(table(spark, [(0, None)])) == {}


def recall_of(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in x}) for q, x in want.items()) / sum(map(len, want.values()))


def visited(x, per_cell=48, recall=0.95):
    """The share that walks pass over these vectors."""
    half, k = x.shape[1] // 2, int(np.sqrt(len(x) / per_cell))
    index = multi_index.Index(multi_index.lloyd(x[:, :half], k), multi_index.lloyd(x[:, half:], k), np.arange(len(x)), x)
    sizes = np.bincount(index.cells(x), minlength=len(index.first) * len(index.second))
    return multi_index.measured_share(index, sizes, 20, recall)


def test_recall_and_share_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    given = [(r["vec_id"], np.array(r["embedding"])) for r in df.collect()]
    for norms, most in ((lambda r: 1, 0.85), (lambda r: r.uniform(0.5, 1.5), 0.96), (lambda r: r.lognormal(0, 0.5), 0.99)):
        r = np.random.default_rng(6)
        rows = [(i, (v * norms(r)).astype(np.float32).tolist()) for i, v in given]
        assert recall_of(search(table(spark, rows)), brute(rows, 20)) >= 0.9
        assert visited(np.array([v for _, v in rows])) < most


def test_fifty_thousand_vectors(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((400, 32))[r.integers(0, 400, 50_000)] + 0.7 * r.standard_normal((50_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)], SCHEMA)
    got, y, found = search(df, every=500), x.astype(float), 0
    for q in range(0, 50_000, 500):
        scores = y @ y[q]
        scores[q] = -np.inf
        found += len({v for v, _ in got[q]} & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert found >= 0.9 * 100 * 20
    assert visited(y[:20_000], per_cell=20) < 0.4


def test_walk_visits_cells_by_summed_distance():
    r = np.random.default_rng(1)
    a, b, sizes = r.random(5), r.random(6), np.ones(30, int)
    order, last = multi_index.walk(a, b, sizes, 30)
    sums = [a[c // 6] + b[c % 6] for c in order]
    assert sorted(order) == list(range(30)) and sums == sorted(sums) and last == sums[-1]
    short, last = multi_index.walk(a, b, sizes * 10, 95)
    assert short == order[:10] and last == sums[9]


def test_mixed_norms_lose_nothing(spark):
    given = [(r["vec_id"], np.array(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for norms in (lambda r: r.uniform(0.5, 1.5), lambda r: r.lognormal(0, 0.5), lambda r: r.lognormal(0, 1)):
        r = np.random.default_rng(2)
        rows = [(i, (v * norms(r)).astype(np.float32).tolist()) for i, v in given]
        want = brute(rows, 20)
        for how in ({}, {"sample_size": 300}, {"per_cell": 4}):
            how = how | {"share": 1.0}
            assert {q: [v for v, _ in x] for q, x in search(table(spark, rows), **how).items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_bounds_leave_cells_out_and_answers_in():
    r = np.random.default_rng(3)
    x = r.standard_normal((40, 8))[r.integers(0, 40, 3000)] * r.lognormal(0, 1, 3000)[:, None] + 0.01 * r.standard_normal((3000, 8))
    first, second = multi_index.lloyd(x[:, :4], 16), multi_index.lloyd(x[:, 4:], 16)
    index = multi_index.Index(first, second, np.arange(3000), x)
    cells = index.cells(x)
    bounds = []
    for h, of, c in ((x[:, :4], cells // len(second), first), (x[:, 4:], cells % len(second), second)):
        far = [[np.linalg.norm(y, axis=1).max() if len(y) else 0 for y in (h[of == k] - d, h[of == k])] for k, d in enumerate(c)]
        bounds.append(multi_index.at_most(h[:50], c, *np.array(far).T))
    sizes, passed = np.bincount(cells, minlength=len(first) * len(second)), 0
    for q, (a, b, beat) in enumerate(zip(*bounds, multi_index.to_beat(np.arange(50), x[:50], index, 20), strict=True)):
        seen = np.flatnonzero((a[:, None] + b).ravel() >= beat - 1e-9)
        best = [j for j in np.argsort(-(x @ x[q])) if j != q][:20]
        assert set(cells[best]) <= set(seen)
        passed += sizes[seen].sum()
    assert passed < 0.9 * 50 * 3000


def test_exact_ties_of_large_components():
    r = np.random.default_rng(4)
    for _ in range(30):
        a, x, y = r.random(3) * 1e8
        q = np.zeros(64)
        q[[0, 32]] = a
        have = r.random((40, 64)) * 1e8
        have[::2, [0, 32]], have[1::2, [0, 32]] = (y, x), (x, y)
        got = list(multi_index.best_of_block(np.array([99]), q[None], np.ones((1, 1), bool), np.arange(40), np.zeros(40, int), have, 4))
        assert [v for _, v, _ in got] == [0, 1, 2, 3]


def test_clustered_vectors_leave_most_cells_out():
    r = np.random.default_rng(5)
    x = r.standard_normal((30, 16))[r.integers(0, 30, 4000)] * 4 + 0.05 * r.standard_normal((4000, 16))
    assert visited(x) < 0.2
