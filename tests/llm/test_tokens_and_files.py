import functools
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import arrow_files, hilbert_pack
from gleanery.llm.tokens import BYTE_SIGNS, Encoder, encoder

from .fixtures import awkward, documents

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(max_codepoint=0x251, exclude_categories=["Cs"])) | st.text())
def test_memo_gives_the_librarys_ids(path, text):
    assert encoder(path).ids(text).tolist() == library(path).encode(text, add_special_tokens=False).ids


ADDED = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "endoftext", "|>", " ", "x", "X", "é", "word", "'s"])).map("".join)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=ADDED)
def test_added_tokens_in_a_text_are_what_the_library_makes_of_them(path, text):
    assert encoder(path).ids(text).tolist() == library(path).encode(text, add_special_tokens=False).ids


def test_other_kinds_of_files_are_encoded_whole(tmp_path):
    for part, value in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "Lowercase"})):
        with open(BYTES, encoding="utf-8") as file:
            declared = json.load(file) | {part: value}
        path = str(tmp_path / f"{part}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(declared, file)
        own = Encoder(path)
        assert own.kind is None
        for text in ("Hello there, it's 42", "<|endoftext|>x", ""):
            assert own.ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert [Encoder(p).kind for p in (BYTES, WORDS)] == ["bytes", "words"]


def test_memo_keeps_within_its_bytes():
    own = Encoder(BYTES, limit=10_000)
    for i in range(500):
        text = f"piece{'x' * (i % 50)} number {'y' * (i % 3000)}"
        assert own.ids(text).tolist() == library(BYTES).encode(text, add_special_tokens=False).ids
        assert own.held <= 10_000 and len(own) * Encoder.OVERHEAD <= 10_000


def test_byte_level_files_are_read_as_ranks_without_a_memo():
    own = Encoder(BYTES)
    for text in ("unknown wrods and \n\n more  of thme, don't", "", " ", "\x85 \xa0x", "é ñandú 42½", "\x00\x1c\x1f \x7f"):
        assert own.ids(text).tolist() == library(BYTES).encode(text, add_special_tokens=False).ids
    assert own.held == 0 and not own.ids("read only").flags.writeable
    assert Encoder(WORDS).ranked is None


@pytest.mark.parametrize("text", ["x" + " " * 400_000 + "y", "\n\t " * 100_000 + "z", "x" + " " * 400_000, "ab" * 100_000, "7" * 50_000])
def test_endless_runs_have_the_librarys_ids(text):
    assert encoder(BYTES).ids(text).tolist() == library(BYTES).encode(text, add_special_tokens=False).ids


def small_file(path, merges, order=None):
    """A byte-level file whose ids stand in the order of ``order``, else of its merges."""
    with open(BYTES, encoding="utf-8") as file:
        declared = json.load(file)
    entries = [*map(chr, BYTE_SIGNS.values()), *(order or ["".join(m) for m in merges])]
    declared["model"] |= {"vocab": {x: i for i, x in enumerate(entries)}, "merges": [" ".join(m) for m in merges]}
    declared["added_tokens"] = []
    path.write_text(json.dumps(declared), encoding="utf-8")
    return str(path)


def test_files_whose_merges_are_no_ranks_keep_the_memo(tmp_path):
    merges = [("a", "b"), ("b", "c"), ("ab", "c")]
    cases = {
        "plain": (merges, None, True),
        "order": (merges, ["bc", "ab", "abc"], False),  # ids against the order of merges
        "other": ([("b", "c"), ("a", "b"), ("ab", "c")], None, False),  # "abc" stays a + bc, which ranks would merge
    }
    for name, (given_merges, order, is_ranked) in cases.items():
        path = small_file(tmp_path / f"{name}.json", given_merges, order)
        own = Encoder(path)
        assert own.kind == "bytes" and (own.ranked is not None) == is_ranked
        for text in ("abc", "bc abcabc cab", "aabbcc", "a b c"):
            assert own.ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_memo_of_words_keeps_within_its_bytes():
    own = Encoder(WORDS, limit=10_000)
    for i in range(300):
        text = f"piece{'x' * (i % 50)} number {'y' * (i % 3000)}"
        assert own.ids(text).tolist() == library(WORDS).encode(text, add_special_tokens=False).ids
        assert 0 < own.held <= 10_000 and len(own) * Encoder.OVERHEAD <= 10_000


def expected_ids(path, text, end):
    return np.array([*library(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_every_id_lies_in_one_piece_without_padding(spark):
    docs = awkward(spark)
    rows = hilbert_pack.pack_along_curve(docs, BYTES).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(expected_ids(BYTES, r.text, 0))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[doc_id]))
        for p in pieces:
            assert p.ids_crc32 in {zlib.crc32(w[p.start : p.start + p.length].tobytes()) for w in want[doc_id] if len(w) == p.doc_tokens}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_neighbours_on_the_curve_are_near():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert_pack.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_files_hold_all_documents_in_order(spark):
    docs = awkward(spark)
    rows = arrow_files.token_file_round_trip(spark, docs, WORDS).orderBy("start").collect()
    source = docs.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert len(rows) == len(source)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows)
    assert got == sorted((r.doc_id or -1, len(w), zlib.crc32(w.tobytes())) for r in source for w in [expected_ids(WORDS, r.text, 1)])


def test_sequences_are_views_of_equal_length(spark, tmp_path):
    texts = ["one two three " * k for k in range(1, 40)]
    files = arrow_files.write_token_files(documents(spark, texts), str(tmp_path / "out"), WORDS, 1, length=16, rows=4).collect()
    for f in files:
        reader = arrow_files.SequenceReader(f"{f.path}.ids.arrow")
        n = -(-f.n_ids // 16)
        parts = [reader.sequence(i) for i in range(n)]
        assert all(len(ids) == len(mask) == 16 for ids, mask in parts)
        assert sum(mask.sum() for _, mask in parts) == f.n_ids
        assert not parts[0][0].flags.owndata


def test_empty_tables(spark):
    none = documents(spark, [])
    assert hilbert_pack.pack_along_curve(none, BYTES).count() == 0
    assert arrow_files.token_file_round_trip(spark, none, WORDS).count() == 0
