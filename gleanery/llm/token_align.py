"""Alignment of two tokenizers' tokens over the same bytes.

A text with a space before it is cut by both vocabularies. The tokens of B make a static interval index: their byte places in
order. Every token of A stabs it by bisection and lists the tokens of B that it overlaps; a gap between two tokens of A that no
token of B spans ends a group, so groups are the shortest runs of tokens that both vocabularies cut alike. The texts of a batch
stand one after the other, so one index and one bisection serve all of them.

Defined cases: a null or empty text, and one that a vocabulary doesn't give back byte for byte, has no tokens: zeros and an
empty ``groups``; an empty table gives no rows; every row counts as a document of its own, repeated ones too; a null doc_id is
a document like any other; texts of any length are aligned whole; ties for the highest count are all best; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged
from .tokens import BYTE_SIGNS, DECLARED

ALIGNED_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"
SCORED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPACE = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pairs whose counts are sent to every task (17 bytes each); more are joined.
SENT_PAIRS = 1 << 22
#: Characters of text that are aligned at once, unless one text alone has more.
AT_ONCE = 1 << 20
#: Pieces as byte-level files declare them.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def stabbed(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the run [first, last) of tokens of B that it overlaps. Tokens are given by their ends; each begins
    where the one before ends, and the last ones end together."""
    starts = lambda ends: np.append(np.int64(0), ends[:-1])[: len(ends)]
    return np.searchsorted(b_ends, starts(a_ends), "right"), np.searchsorted(starts(b_ends), a_ends, "left")


def signs(n: int, ends: tuple[str, str]) -> np.ndarray:
    """The decimal ids below n, each before either sign, as bytes of one width."""
    return np.array([f"{i}{e}".encode() for i in range(n) for e in ends])


class Pair(dict):
    """Two vocabularies: a byte-level file of tokenizers (A, for a space and the text) and a model of sentencepiece (B, which adds
    the space).

    Both cut at a single space between two characters that aren't white space (A's pattern begins a piece there; no piece of B holds
    a space after another character), so what stands between such spaces is cut on its own and remembered. When half of ``limit``
    bytes are held, what is held becomes the older half, and the older half of before is forgotten. Vocabularies for which this
    doesn't hold cut whole texts."""

    OVERHEAD = 330

    def __init__(self, a_path: str, b_path: str, limit: int = 256 << 20):
        super().__init__()
        self.limit, self.held, self.older = limit // 2, 0, {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(sign): bytes([b]) for b, sign in BYTE_SIGNS.items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = b"".join(byte_of.get(c, c.encode()) for c in entry)
        self.size_a, self.size_b = len(self.a_bytes), self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.signs = np.concatenate([signs(self.size_a, (",", "|")), signs(self.size_b, (",", ";"))])
        self.sign_length = np.char.str_len(self.signs)
        with open(a_path, encoding="utf-8") as file:
            declared = json.load(file)
        plain = all(declared.get(k) == v for k, v in DECLARED["bytes"].items()) and not any(t.get("normalized") for t in declared.get("added_tokens") or [])
        self.ranks = self.ranked(declared) if plain else None
        self.cuts = plain and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def ranked(self, declared: dict):
        """A's merges as ranks of byte strings, which give the same ids several times faster; None if merges don't stand in the order
        of their ids."""
        import tiktoken

        model, added = declared["model"], {t["id"] for t in declared.get("added_tokens") or []}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or []]
        ids = [model["vocab"].get(m, -1) for m in merged]
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in added}
        if not plain or ids != list(range(256, 256 + len(ids))) or len(ranks) != 256 + len(ids):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_of_a(self, text: str) -> list[int]:
        if self.ranks:
            try:
                return self.ranks.encode_ordinary(text)
            except BaseException as limit:  # the pattern's engine gives up on some endless runs of white space, and says so by a panic
                if isinstance(limit, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.library.encode(text, add_special_tokens=False).ids

    def __missing__(self, stretch: str) -> tuple[bytes, bytes] | None:
        """Ids of a stretch with a space before it, as bytes; None if its bytes don't come back."""
        found = self.older.get(stretch, self)
        if found is self:
            whole, b = f" {stretch}", self.b.encode(stretch, num_threads=1)
            a, raw = self.ids_of_a(whole), whole.encode()
            same = b"".join([self.b_bytes[i] for i in b]) == raw and b"".join([self.a_bytes[i] for i in a]) == raw
            found = (array("I", a).tobytes(), array("I", b).tobytes()) if same else None
        size = self.OVERHEAD + 2 * len(stretch) + (len(found[0]) + len(found[1]) if found else 0)
        if self.held + size > self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if size <= self.limit:
            self[stretch] = found
            self.held += size
        return found

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of A and of B (unsigned 32 bits, as bytes); none if the bytes don't come back."""
        if not text:
            return b"", b""
        found = [self[s] for s in (CUT.split(text) if self.cuts else [text])]
        return (b"".join([f[0] for f in found]), b"".join([f[1] for f in found])) if None not in found else (b"", b"")


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """One for each pair of vocabularies in a Python worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def aligned_rows(own: Pair, rows: list, doc_ids: list, texts: list, with_groups: bool) -> pa.RecordBatch:
    n, cut = len(rows), [own.tokens(t) for t in texts]
    a, b = (np.frombuffer(b"".join([c[i] for c in cut]), np.uint32).astype(np.int64) for i in (0, 1))
    n_a, n_b = (np.array([len(c[i]) // 4 for c in cut], np.int64) for i in (0, 1))
    of_a = np.repeat(np.arange(n), n_a)
    first, last = stabbed(np.cumsum(own.a_length[a]), np.cumsum(own.b_length[b]))
    ends = np.ones(len(a), bool)
    ends[:-1] = last[:-1] == first[1:]  # no token of B spans the gap after this token of A
    n_links = last - first
    # all links: the tokens of B of the first token of A, then those of the second, ...
    behind = np.cumsum(n_links)
    links = np.repeat(a * own.size_b, n_links) + b[np.arange(behind[-1] if len(a) else 0) + np.repeat(first - (behind - n_links), n_links)]
    # the pairs of each document once, with their number: sorted by document, then by pair
    width = own.size_a * own.size_b
    keys, times = np.unique(np.repeat(of_a * width, n_links) + links, return_counts=True)
    held = np.bincount(keys // width, minlength=n)
    # groups as text: the tokens of A of a group, then its tokens of B, each with the sign after it
    a_before, b_until = np.append(0, np.flatnonzero(ends) + 1), last[ends]
    group_a = np.cumsum(ends) - ends
    group_b = np.repeat(np.arange(len(b_until)), np.diff(np.append(0, b_until)))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.append(0, b_until)[group_a]] = 2 * a + ends
    ends_b = np.zeros(len(b), bool)
    ends_b[b_until - 1] = True
    codes[np.arange(len(b)) + a_before[group_b + 1]] = 2 * (own.size_a + b) + ends_b
    raw = own.signs[codes].view(np.uint8)
    raw = raw[raw != 0].tobytes()
    upto = np.append(0, np.cumsum(own.sign_length[codes]))[np.append(0, np.cumsum(n_a + n_b))].tolist()
    groups = [raw[lo : max(lo, hi - 1)] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]
    columns = [
        pa.array(rows, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(np.bincount(of_a[ends], minlength=n)),
        pa.array(np.bincount(of_a, n_links, minlength=n).astype(np.int64)), pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
        pa.array([g.decode() for g in groups] if with_groups else [None] * n, pa.string()), _lists(keys % width, held), _lists(times.astype(np.int32), held),
    ]
    return pa.record_batch(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])


def lots(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``AT_ONCE`` characters."""
    began, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > AT_ONCE:
            yield began, i
            began, size = i, 0
        size += len(t or "")
    if began < len(texts):
        yield began, len(texts)


def align_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """A row for each document: the numbers of tokens, groups and links; ``groups`` (ids of A|ids of B of each group, parted by ;; null if
    not wanted) and its digest; ``pairs`` (id of A * size of B + id of B, each once) and how many ``times`` each is linked."""
    held_to_small_batches(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair_of(a_path, b_path)
        for batch in batches:
            rows, doc_ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in lots(texts):
                yield aligned_rows(own, rows[lo:hi], doc_ids[lo:hi], texts[lo:hi], with_groups)

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(align, ALIGNED_SCHEMA)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, docs (how many documents hold it linked) and best (no other pair of its id of A is in more documents). Pairs are
    counted by batch before they are shuffled; there are no more of them than pairs of ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, docs = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.record_batch([pa.array(pairs.astype(np.int64)), pa.array(docs.astype(np.int64))], ["pair", "docs"])

    counted = staged(aligned.select("pairs").mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    of_a = F.floor(F.col("pair") / size_b).alias("a")
    most = counted.groupBy(of_a).agg(F.max("docs").alias("most"))
    return counted.withColumn("a", of_a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The numbers and digest of ``align_documents`` with n_best (links whose pair is among the commonest of its id of A in the
    corpus) and count_sum (of the pairs' documents, over links). Counts are sent to the tasks if there are at
    most ``sent_pairs``, else they meet the pairs in a join; both give the same rows."""
    held = staged(align_documents(docs, a_path, b_path, with_groups=False).drop("groups"), "aligned")
    counts = staged(pair_counts(held, pair_of(a_path, b_path).size_b), "counts")
    if counts.count() > sent_pairs:
        return _by_join(held, counts)
    known = counts.toArrow().sort_by("pair").combine_chunks()
    sent = held.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False))
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            document = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            sums = []
            for value in (times * best[at], times * docs[at]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, document, value)
                sums.append(pa.array(total))
            columns = [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, batch.column("groups_sha256")]
            yield pa.record_batch(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return held.mapInArrow(score, SCORED_SCHEMA)


def _by_join(held: DataFrame, counts: DataFrame) -> DataFrame:
    """A common pair is a hot key of an inner sort-merge join, which Spark splits; sums are taken before they are shuffled."""
    pairs = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    joined = pairs.hint("merge").join(counts, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    out = held.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
