import random
import re
from collections import Counter

import pytest

from gleanery.llm import chosen_path
from gleanery.llm.components import components

from .fixtures import awkward, documents


def shingles(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else None


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_copies, n_links) of each row by comparing all distinct sets."""
    sets = sorted({s for _, t in rows if (s := shingles(t))}, key=sorted)
    parent, links = list(range(len(sets))), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    place = {s: i for i, s in enumerate(sets)}
    owner, n = {}, Counter(shingles(t) for _, t in rows)
    for doc_id, t in rows:
        if (s := shingles(t)) and doc_id is not None:
            root = find(place[s])
            owner[root] = min(owner.get(root, doc_id), doc_id)
    return Counter((d, owner.get(find(place[s])), n[s], links[place[s]]) if (s := shingles(t)) else (d, d, 1, 0) for d, t in rows)


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(words, edits, seed):
    r = random.Random(seed)
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return out


def near_texts():
    texts = []
    passage = prose(999, 60)
    for k in range(12):
        base = prose(k, 200)
        texts += [" ".join(base)] + [" ".join(edited(base, e, 100 * k + e)) for e in range(1, 6)]
    texts += [" ".join(passage + prose(500 + k, 80)) for k in range(150)]  # one passage in many documents
    texts += [" ".join(edited(prose(77, 300), 3, 7000 + k)) for k in range(150)]  # a large group of near copies
    texts += [texts[0]] * 40 + [texts[-1].upper()]
    return texts


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "class_id", "n_copies", "n_links").collect())


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (4, 16), (2, 3)])
def test_classes_and_link_counts_are_those_of_all_pairs(spark, small, block):
    texts = near_texts()
    rows = list(enumerate(texts))
    assert found(chosen_path.jaccard_join(documents(spark, texts), small=small, block=block)) == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(chosen_path.jaccard_join(docs)) == brute(rows)
    assert chosen_path.jaccard_join(documents(spark, [])).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(chosen_path.jaccard_join(docs)) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    texts = near_texts()
    docs = documents(spark, [*texts, None, "", None, texts[3]], [*range(len(texts)), None, 5, None, 3])
    kept = chosen_path.one_of_each(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {c for (d, c, _, _), _ in brute(rows).items() if any(d == i and t for i, t in rows)}
    ids = Counter(r["doc_id"] for r in kept.collect() if r["text"])
    assert set(ids) == groups and set(ids.values()) == {1}
    assert kept.columns == docs.columns
    assert sum(not r["text"] for r in kept.collect()) == 3


def test_runs_grow_with_recall_and_depth():
    assert chosen_path.runs_for(0.9, 1) < chosen_path.runs_for(0.999, 1) < chosen_path.runs_for(0.999, 3)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts_meet_the_wanted_sets_in_a_shuffle_too(spark, monkeypatch):
    texts = near_texts()[:60] + [None, ""]
    docs = documents(spark, texts)
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, chosen_path.jaccard_join(docs).collect())) == brute(list(enumerate(texts)))


def test_one_of_each_takes_clashing_names_and_empty_tables(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", None, "", "..."], [4, 3, None, 5, 5]).withColumnRenamed("ids", "own_id").withColumnRenamed("key", "kept_id").withColumnRenamed("words", "own_key")
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (3, "one two three four five six"), (5, ""), (5, "...")]
    assert chosen_path.one_of_each(docs.limit(0)).collect() == []


def test_very_long_near_copies_meet_in_blocks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK_BYTES", 1 << 20)
    base = prose(77, 20_000)
    texts = [" ".join(edited(base, 40 * k, k)) for k in range(12)] + [" ".join(prose(500 + k, 20_000)) for k in range(2)] + [" ".join(base)]
    docs = documents(spark, texts)
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in chosen_path.jaccard_join(docs, block=4, small=2).collect())
    assert got == brute(list(enumerate(texts)))
    node = spark.createDataFrame([(i, 7, 12, 12 * 20_000) for i in range(12)], "cid long, node long, n long, tokens_n long")
    assert chosen_path.dealt(node, 1024).agg({"b": "max"}).first()[0] == 1


def test_components_of_awkward_edges(spark):
    schema = "a long, b long, id long, m string"
    rows = [(1, 2, 0, "x"), (2, 1, 0, "x"), (1, 2, 9, "y"), (3, 3, 0, None), (4, None, 0, None), (None, None, 0, None), (7, 5, 1, "z"), (5, 9, 1, "z")]
    assert sorted(map(tuple, components(spark.createDataFrame(rows, schema)).collect())) == [(1, 1), (2, 1), (5, 5), (7, 5), (9, 5)]
    assert components(spark.createDataFrame([], schema)).count() == 0
