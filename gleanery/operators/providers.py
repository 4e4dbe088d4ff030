"""Providers of vectors and scores, and the cache that stands before them.

A provider is asked for whole batches inside tasks, so it may be a model on the executor or a remote service. The offline ones
depend on the text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.sinks import staged

EMBEDDINGS = "id long, model string, dimension int, input_hash string, embedding binary"


class EmbeddingProvider(Protocol):
    model: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[np.ndarray | None]:
        """A vector for each text, None for one that got none."""


class ScoreProvider(Protocol):
    model: str

    def score(self, texts: Sequence[str]) -> Sequence[float | None]: ...


class OfflineEmbedder:
    """Bytes of the text's SHA-256, again and again, centred, at unit length."""

    model = "offline-sha256"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 32)
        centred = raw[:, np.arange(self.dimension) % 32] / 255.0 - 0.5
        return list((centred / np.maximum(np.sqrt((centred**2).sum(axis=1, keepdims=True)), 1e-6)).astype("<f4"))


class OfflineScorer:
    """The first byte of the text's SHA-256 on a scale of ten."""

    model = "offline-sha256"

    def score(self, texts: Sequence[str]) -> list[float]:
        return [hashlib.sha256(t.encode()).digest()[0] * 10 / 255 for t in texts]


def embedded(inputs: DataFrame, provider: EmbeddingProvider, batch: int = 128) -> DataFrame:
    """Rows for the cache of the inputs (id, input_hash, text) that the provider gave a vector, asked ``batch`` texts at a time."""
    model, dimension = provider.model, provider.dimension

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                got = provider.embed(part.column(2).to_pylist())
                blobs = [None if v is None else np.asarray(v, "<f4").tobytes() for v in got]
                n = part.num_rows
                rows = pa.record_batch([part.column(0), pa.array([model] * n), pa.array([dimension] * n, pa.int32()), part.column(1), pa.array(blobs, pa.binary())], ["id", "model", "dimension", "input_hash", "embedding"])
                yield rows.filter(rows.column(4).is_valid())

    return inputs.select("id", "input_hash", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(ask, EMBEDDINGS)


def scored(inputs: DataFrame, provider: ScoreProvider, batch: int = 128) -> DataFrame:
    """id, model, score of the inputs (id, text)."""
    model = provider.model

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                yield pa.record_batch([part.column(0), pa.array([model] * part.num_rows), pa.array(provider.score(part.column(1).to_pylist()), pa.float64())], ["id", "model", "score"])

    return inputs.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(ask, "id long, model string, score double")


def usable(cache: DataFrame, model: str, dimension: int) -> DataFrame:
    """Cached rows of this model and dimension whose vector can be read: of the right length, every number finite. Others count as
    missing."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [x is not None and len(x) == 4 * dimension and bool(np.isfinite(np.frombuffer(x, "<f4")).all()) for x in b.column("embedding").to_pylist()]
            yield b.filter(pa.array(whole, pa.bool_()))

    mine = cache.filter((F.col("model") == model) & (F.col("dimension") == dimension)).select("id", "model", "dimension", "input_hash", "embedding")
    return mine.mapInArrow(sound, EMBEDDINGS)


def through_cache(inputs: DataFrame, cache: DataFrame, provider: EmbeddingProvider) -> tuple[DataFrame, DataFrame]:
    """(found, cache): the vectors of the inputs (id, text) with their origin, and the cache with what was computed written back, one row
    an id. An input is found by id, model, dimension and hash of its text; the rest is asked of the provider once."""
    hashed = inputs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("input_hash", F.sha2("text", 256))
    stored = usable(cache, provider.model, provider.dimension)
    hits = staged(stored.join(hashed.select("id", "input_hash"), ["id", "input_hash"], "left_semi"), "cache-hits")
    fresh = staged(embedded(hashed.join(hits.select("id", "input_hash"), ["id", "input_hash"], "left_anti"), provider), "cache-fresh")
    names = EMBEDDINGS.split(", ")
    columns = [n.split(" ")[0] for n in names]
    found = hits.select(*columns, F.lit("stored").alias("origin")).unionByName(fresh.select(*columns, F.lit("computed").alias("origin")))
    return found, cache.select(*columns).join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*columns))


def decoded(rows: DataFrame, blob: str = "embedding", out: str = "v") -> DataFrame:
    """Adds the blob's numbers as an array of doubles."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(blob)
            parts = [np.frombuffer(x, "<f4").astype(float) for x in b.column(at).to_pylist()]
            offsets = pa.array(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0)))
            yield pa.record_batch([*b.columns, lists], [*b.schema.names, out])

    return rows.mapInArrow(read, schema)
