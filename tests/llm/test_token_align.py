import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.token_align import Pair, align_corpus, align_documents, aligned_rows, lots, pair_of, stabbed

from .fixtures import LONG, awkward, documents

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return Pair(A, B)


def by_hand(own, text):
    """ids of A, ids of B, groups and links from the libraries' tokens, by comparing byte ranges; None without tokens."""
    if not text:
        return None
    whole = f" {text}".encode()
    a, b = own.library.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
    if b"".join(own.a_bytes[i] for i in a) != whole or b"".join(own.b_bytes[i] for i in b) != whole:
        return None

    def ranges(ids, table):
        ends = np.cumsum([len(table[i]) for i in ids])
        return [(int(e) - len(table[i]), int(e)) for i, e in zip(ids, ends, strict=True)]

    ra, rb = ranges(a, own.a_bytes), ranges(b, own.b_bytes)
    groups, lo = [], 0
    for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(",".join(str(i) for i, (s, _) in zip(a, ra, strict=True) if lo <= s < cut) + "|" + ",".join(str(i) for i, (s, _) in zip(b, rb, strict=True) if lo <= s < cut))
        lo = cut
    links = [(i, j) for i, (s, e) in zip(a, ra, strict=True) for j, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
    return a, b, groups, links


def check(own, text, row):
    want = by_hand(own, text)
    if want is None:
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups"], row["groups_sha256"], row["pairs"]) == (0, 0, 0, 0, "", "", [])
        return
    a, b, groups, links = want
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups"]) == (len(a), len(b), len(groups), len(links), ";".join(groups))
    assert row["groups_sha256"] == hashlib.sha256(row["groups"].encode()).hexdigest()
    assert dict(zip(row["pairs"], row["times"], strict=True)) == Counter(i * own.size_b + j for i, j in links)
    assert row["pairs"] == sorted(row["pairs"])


PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "word", "Word's", "don't", "42", "x", "é", "ﬁ", "世界", "😀", "<|endoftext|>", "<s>", "▁", ".", ",", "...", "\x85", "\xa0", "\x1c", "̈", " ", "Привет"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(PARTS | st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_tokens_groups_and_links(texts):
    own = pair_of(A, B)
    rows = aligned_rows(own, list(range(len(texts))), list(range(len(texts))), texts, True).to_pylist()
    for text, row in zip(texts, rows, strict=True):
        check(own, text, row)




def test_stabbing_lists_all_overlaps():
    a, b = np.array([1, 4, 5, 9, 12]), np.array([2, 3, 5, 10, 11, 12])
    first, last = stabbed(a, b)
    spans = lambda ends: list(zip([0, *ends[:-1]], ends, strict=True))
    for (s, e), lo, hi in zip(spans(a.tolist()), first, last, strict=True):
        assert list(range(lo, hi)) == [j for j, (u, v) in enumerate(spans(b.tolist())) if s < v and u < e]


def test_memo_keeps_within_its_bytes_and_ranks_give_the_librarys_ids(own):
    small = Pair(A, B, limit=20_000)
    assert small.ranks and small.cuts
    for i in range(300):
        text = f"words {'x' * i} and {i} more, it's <|endoftext|> {'é' * (i % 9)}\n\n  {'q ' * i}"
        assert small.tokens(text) == own.tokens(text)
        assert small.ids_of_a(text) == small.library.encode(text, add_special_tokens=False).ids
        assert small.held <= 10_000


def test_endless_runs(own):
    for text in (" " * 400_000 + "x", "a" * 50_000, "\n" * 50_000, "." * 50_000):
        assert own.ids_of_a(text) == own.library.encode(text, add_special_tokens=False).ids


def test_lots_hold_every_text():
    texts = ["x" * n for n in (5, 3 << 20, 0, 1 << 19, 1 << 19, 1)] + [None]
    runs = list(lots(texts))
    assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(len(texts)))
    assert list(lots([])) == []


def scores(own, rows):
    """The contract over all documents, by hand."""
    found = [by_hand(own, r.text) for r in rows]
    docs = Counter(pair for f in found if f for pair in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for r, f in zip(rows, found, strict=True):
        a, b, groups, links = f or ([], [], [], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((r.doc_id, len(a), len(b), len(groups), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), digest))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_corpus_counts(spark, own, sent):
    docs = awkward(spark).filter("length(text) < 2000 OR text IS NULL").union(documents(spark, ["the cat sat", "the cat ran off", "The cat's hat", "▁ no tokens", "the the the"], range(50, 55)))
    got = align_corpus(docs, A, B, sent_pairs=sent).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == scores(own, docs.collect())


def test_groups_of_documents_and_long_texts(spark, own):
    docs = documents(spark, ["The cat's hat", None, "", LONG])
    rows = {r.doc_id: r.asDict() for r in align_documents(docs, A, B).collect()}
    for i, text in enumerate(["The cat's hat", None, ""]):
        check(own, text, rows[i])
    many = own.tokens(LONG)
    assert rows[3]["n_a"] == len(many[0]) // 4 > 3000 * 9 and rows[3]["n_b"] == len(many[1]) // 4
    assert rows[3]["groups"].startswith(";".join(by_hand(own, LONG[:43])[2]))


def test_empty_table(spark):
    assert align_corpus(documents(spark, []), A, B).count() == 0
