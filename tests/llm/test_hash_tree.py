import hashlib
import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import hash_tree

from .fixtures import awkward, documents


def draw(key, name, weight):
    u = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16)
    return -math.log((u + 0.5) / 2**52) / weight


def brute(key, tree):
    region = min(sorted({s.region for s in tree}), key=lambda r: draw(key, str(r), sum(s.weight for s in tree if s.region == r)))
    inside = [s for s in tree if s.region == region]
    rack = min(sorted({s.rack for s in inside}), key=lambda k: draw(key, f"{region}.{k}", sum(s.weight for s in inside if s.rack == k)))
    return min((s for s in inside if s.rack == rack), key=lambda s: draw(key, f"{region}.{rack}.{s.shard}", s.weight)).shard


def test_shards_slots_and_growth(spark):
    docs = documents(spark, [f"text {i % 7}" for i in range(600)]).union(awkward(spark))
    rows = hash_tree.shard_documents(docs).collect()
    source = docs.collect()
    tree = hash_tree.base_tree()
    assert len(rows) == len(source)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute(key, tree)
        assert r.grown_shard in (r.shard, 24) and r.grown_shard == brute(key, hash_tree.grown(tree))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def descended(spark, tree, n=4000):
    rows = spark.range(n).select("id", hash_tree.descend(F.col("id").cast("string"), tree).alias("shard")).collect()
    return {r["id"]: r["shard"] for r in rows}


def test_weights_set_the_shares_and_confine_movement(spark):
    tree = hash_tree.base_tree(8, 2, 2)
    heavier = [hash_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    before, after = descended(spark, tree), descended(spark, heavier)
    assert before == {k: brute(k, tree) for k in before} and after == {k: brute(k, heavier) for k in after}
    region = {s.shard: s.region for s in tree}
    # what was outside the heavier region and moved has moved into it
    assert all(region[after[k]] == 1 for k in before if before[k] != after[k])
    assert abs(Counter(after.values())[5] / 4000 - 0.3) < 0.04


def test_unequal_weights_and_shards_without_weight(spark):
    r = random.Random(3)
    tree = [hash_tree.Shard(i // 6, i // 3 % 2, i, r.choice([0.0, 0.5, 1.0, 4.0])) for i in range(18)]
    got = descended(spark, tree)
    live = [s for s in tree if s.weight]
    assert got == {k: brute(k, live) for k in got}
    total = sum(s.weight for s in live)
    for s in live:
        assert abs(Counter(got.values())[s.shard] / 4000 - s.weight / total) < 0.03
    # a lighter shard gives rows away; none moves between shards of other regions
    lighter = [hash_tree.Shard(s.region, s.rack, s.shard, s.weight / 2 if s is live[0] else s.weight) for s in tree]
    moved = [(got[k], v) for k, v in descended(spark, lighter).items() if v != got[k]]
    region = {s.shard: s.region for s in tree}
    assert moved and all(region[a] == live[0].region for a, _ in moved)


def test_empty_table(spark):
    assert hash_tree.shard_documents(documents(spark, [])).count() == 0
