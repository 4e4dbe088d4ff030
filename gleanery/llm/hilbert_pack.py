"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, the vector is projected to three dimensions, and its place there
becomes a key on the Hilbert curve. Documents are range-sorted by that key, so neighbours on the curve (documents of
like vocabulary) meet in the same sequences. Every range of the curve is cut into full sequences; what remains at a
range's end is cut into sequences whose lengths are powers of two, so nothing is padded.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; repeated rows are packed once
for each repetition; a null doc_id is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged
from .tokens import encoder

BUCKETS, DIMENSIONS, BITS = 256, 3, 16
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


def document_vectors(id_arrays: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of hashed id counts, damped so that the most common ids don't decide alone."""
    out = np.zeros((len(id_arrays), BUCKETS))
    for row, ids in zip(out, id_arrays, strict=True):
        hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        row[:] = np.sqrt(np.bincount(hashed, minlength=BUCKETS))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def curve_keys(id_arrays: list[np.ndarray]) -> np.ndarray:
    spread = (document_vectors(id_arrays) @ _projection() + 4) / 8
    return hilbert_keys((np.clip(spread, 0, 1) * ((1 << BITS) - 1)).astype(np.int64), BITS)


def with_curve_keys(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, as wide as the vocabulary needs), n and key of each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [np.append(enc.ids(t), enc.dtype.type(end_id)) for t in batch.column(1).to_pylist()]
                yield pa.record_batch(
                    [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids))],
                    ["doc_id", "ids", "n", "key"],
                )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return picked.mapInArrow(encode, "doc_id long, ids binary, n long, key long")


class Sequences:
    """Cuts a run of documents into sequences and lists the pieces."""

    def __init__(self, first_id: int, size: int):
        self.size, self.sequence, self.used = size, first_id, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            length = min(len(ids) - start, self.size - self.used)
            self.open.append((doc_id, start, ids[start : start + length], len(ids)))
            self.used += length
            start += length
            if self.used == self.size:
                self.close(self.open)
                self.open, self.used = [], 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The rest goes into sequences of 2**k tokens, largest first."""
        rest, self.open = self.open[::-1], []
        left, self.used = self.used, 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            mine = []
            while room:
                doc_id, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                mine.append((doc_id, start, ids, total))
                room -= len(ids)
            self.close(mine)

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def pack_along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """The pieces of all documents; sequence ids count within a range of the curve, whose number is in the bits above 32."""
    held_to_small_batches(docs.sparkSession)
    width = encoder(tokenizer_path).dtype.str

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sequences(TaskContext.get().partitionId() << 32, size)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add(doc_id, np.frombuffer(ids.as_buffer(), width))
            yield out.batch()
        out.finish()
        yield out.batch()

    keyed = staged(with_curve_keys(docs, tokenizer_path, end_id), "curve")
    # doc_id and length after the key: equal texts share a key, and must not share one task
    order = ["key", "doc_id", "n"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(cut, PIECE_SCHEMA)
