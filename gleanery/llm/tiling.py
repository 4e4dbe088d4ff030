"""Benchmark decontamination by greedy string tiling.

Words of a benchmark item and of a document are matched by running Karp-Rabin hashes of five words, the seeds. Documents
that share a seed with an item are tiled: the longest match of unmarked words is marked, again and again, until none of five
words is left, so passages count in whatever order they come. A document is contaminated by an item when its tiles cover
at least ``threshold`` of the item's words.

A benchmark of at most ``broadcast_words`` words, which is checked first, is sent to the tasks; documents stay where they are
read and nothing is shuffled. The seeds of a larger one meet those of the documents in a join: a bit table of a fixed
size leaves out the document seeds that no item has, texts never leave their tasks, and equal texts are tiled once. The
join is a plain sort-merge join, whose hot seeds Spark splits. Both ways only list where matches begin and end, so a phrase that is
repeated thousands of times in both texts costs a match for each diagonal.

Defined cases: a null or empty text matches nothing; an item of fewer than five words only matches a document of exactly
these words; an item without words, or null, matches nothing; an empty benchmark or table gives no rows; repeated rows, of
documents or items, are matched once each; null and repeated doc_ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged, unused, word_hashes

SEED = 5
BASE, SECOND_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BROADCAST_WORDS = 1_000_000
BITS, RANGES = 1 << 28, 64
#: What stands for the word before the first and after the last one; no two texts end alike.
DOCUMENT_ENDS, ITEM_ENDS = -1, -2
COLUMNS = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "item_words"]
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long, item_words long"
Tile = tuple[int, int, int]


def rolling(words: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    words = words.view(np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * base + words[k : len(words) - n + 1 + k]
    return out


def tile(starts: Iterable[tuple[int, int]], ends: Iterable[tuple[int, int]], seed: int, item_words: int) -> list[Tile]:
    """Tiles (document start, item start, words), longest first; ties go to the earlier place in the item, then in the
    document. ``starts`` and ``ends``: the pairs of places, in the document and in the item, at which ``seed`` equal words begin that
    no longer match goes before, or after. So a run of one word, or of one phrase again and again, is one match on each diagonal
    and not one for each pair of places."""
    diagonals: dict[int, tuple[list[int], list[int]]] = {}
    for side, pairs in enumerate((starts, ends)):
        for p, q in pairs:
            diagonals.setdefault(p - q, ([], []))[side].append(p)
    heap: list[Tile] = []
    for d, (first, last) in diagonals.items():
        heap += [(-(z - a + seed), a - d, a) for a, z in zip(sorted(first), sorted(last), strict=True)]
    heapq.heapify(heap)
    if not heap:
        return []
    # only the stretch that matches reach can be marked
    low = min(p for _, _, p in heap)
    taken_document = np.zeros(max(p - n for n, _, p in heap) - low, bool)
    taken_item = np.zeros(item_words, bool)
    tiles = []
    while heap:
        length, q, p = heapq.heappop(heap)
        n = -length
        free = np.flatnonzero(~(taken_document[p - low : p - low + n] | taken_item[q : q + n]))
        if len(free) == n:
            tiles.append((p, q, n))
            taken_document[p - low : p - low + n] = True
            taken_item[q : q + n] = True
            continue
        # what is left of a match goes back as matches of its own
        gaps = np.flatnonzero(np.diff(free) > 1) + 1
        for part in np.split(free, gaps) if len(free) else []:
            if len(part) >= seed:
                heapq.heappush(heap, (-len(part), q + int(part[0]), p + int(part[0])))
    return tiles


def neighbours(words: np.ndarray, n: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the word after each run of ``n`` words; ``none`` where the text ends."""
    runs = max(0, len(words) - n + 1)
    return np.append(none, words)[:runs], np.append(words, none)[n : n + runs]


@dataclass
class Benchmark:
    """Items, and the sorted hashes of their seeds with the items that hold them; short items by their words."""

    ids: list[int]
    items: list[np.ndarray]
    hashes: np.ndarray
    holders: list[list[int]]
    short: dict[bytes, list[int]]

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]]) -> Benchmark:
        found: dict[int, set[int]] = {}
        short: dict[bytes, list[int]] = {}
        for i, (_, words) in enumerate(rows):
            if len(words) < SEED:
                short.setdefault(words.tobytes(), []).append(i)
            for h in rolling(words, SEED).tolist():
                found.setdefault(h, set()).add(i)
        hashes = sorted(found)
        return Benchmark([i for i, _ in rows], [w for _, w in rows], np.array(hashes, np.uint64), [sorted(found[h]) for h in hashes], short)

    def places(self, document: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items that share a seed with the document, and where in the document their seeds start."""
        runs = rolling(document, SEED)
        if not len(runs) or not len(self.hashes):
            return
        near = np.minimum(np.searchsorted(self.hashes, runs), len(self.hashes) - 1)
        found: dict[int, list[int]] = {}
        for p in np.flatnonzero(self.hashes[near] == runs).tolist():
            for i in self.holders[near[p]]:
                found.setdefault(i, []).append(p)
        yield from found.items()

    def tiles(self, document: np.ndarray, i: int, places: list[int]) -> list[Tile]:
        """``places``: where seeds that the item may hold start in the document."""
        item = self.items[i]
        # equal words, not only an equal hash; the item's places of each seed by the word before, and by the word after
        held: dict[bytes, tuple[dict[int, list[int]], dict[int, list[int]]]] = {}
        for q, (x, y) in enumerate(zip(*(z.tolist() for z in neighbours(item, SEED, ITEM_ENDS)), strict=True)):
            before, after = held.setdefault(item[q : q + SEED].tobytes(), ({}, {}))
            before.setdefault(x, []).append(q)
            after.setdefault(y, []).append(q)
        around = neighbours(document, SEED, DOCUMENT_ENDS)
        pairs: tuple[list, list] = ([], [])
        for p in places:
            for side, groups in enumerate(held.get(document[p : p + SEED].tobytes(), ())):
                mine = int(around[side][p])
                pairs[side].extend((p, q) for other, qs in groups.items() if other != mine for q in qs)
        return tile(*pairs, SEED, len(item))

    def contaminants(self, document: np.ndarray, threshold: float) -> Iterator[tuple[int, list[Tile], int]]:
        """Items that the document covers to ``threshold`` at least, with their tiles and the words covered."""
        if len(document) < SEED:
            for i in self.short.get(document.tobytes(), ()):
                yield i, [(0, 0, len(document))], len(document)
            return
        for i, places in self.places(document):
            tiles = self.tiles(document, i, places)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(self.items[i]):
                yield i, tiles, covered


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id and words (hashes) of the items that have any."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("w")).filter(F.size("w") > 0)


def small_benchmark(items: DataFrame, broadcast_words: int) -> Benchmark | None:
    """The whole benchmark if it has at most ``broadcast_words`` words."""
    if (items.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0) > broadcast_words:
        return None
    return Benchmark.of([(r["item_id"], np.array(r["w"], np.int64)) for r in items.collect()])


def text_keys() -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")]


def seed_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each seed; a text of fewer words is one seed of its own length."""
    n = min(SEED, max(1, len(words)))
    return tuple(rolling(words, n, base).view(np.int64) + n for base in (BASE, SECOND_BASE))


def bit_table(seeds: DataFrame) -> np.ndarray:
    """BITS bits, one set for each seed's hash; they come to the driver in RANGES parts, whatever the benchmark's size."""
    part = BITS // RANGES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)
            for r in np.unique(h // np.uint64(part)).tolist():
                bits = held.setdefault(r, np.zeros(part, bool))
                bits[(h[h // np.uint64(part) == r] % np.uint64(part)).astype(np.int64)] = True
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())], ["r", "bits"])

    out = np.zeros(BITS // 8, np.uint8)
    by_range = seeds.select("h").repartition(RANGES, F.shiftright(F.pmod("h", F.lit(BITS)), 22))
    for row in by_range.mapInArrow(mark, "r long, bits binary").toLocalIterator():
        at = row["r"] * part // 8
        out[at : at + part // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def joined_by_seeds(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """k1, k2 (of the text) and the columns of an answer but doc_id, for a benchmark of any size."""
    spark = docs.sparkSession
    items = staged(items.withColumn("i", F.monotonically_increasing_id()), "tiling-items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.values.to_numpy()
                h, g = seed_hashes(words)
                x, y = neighbours(words, min(SEED, len(words)), ITEM_ENDS)
                yield pa.record_batch([pa.array(np.full(len(h), i)), pa.array(np.arange(len(h))), *map(pa.array, (h, g, x, y))], ["i", "q", "h", "g", "item_before", "item_after"])

    seeds = staged(items.select("i", "w").mapInArrow(item_seeds, "i long, q long, h long, g long, item_before long, item_after long"), "tiling-seeds")
    shipped = spark.sparkContext.broadcast(bit_table(seeds))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            for k1, k2, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words.values.to_numpy()
                if not len(words):
                    continue
                h, g = seed_hashes(words)
                x, y = neighbours(words, min(SEED, len(words)), DOCUMENT_ENDS)
                bit = h.view(np.uint64) % np.uint64(BITS)
                p = np.flatnonzero(bits[(bit >> np.uint64(3)).astype(np.int64)] & (128 >> (bit & np.uint64(7)).astype(np.int64)))
                if len(p):
                    yield pa.record_batch([pa.array(np.full(len(p), k1)), pa.array(np.full(len(p), k2)), pa.array(p), *(pa.array(c[p]) for c in (h, g, x, y))], ["k1", "k2", "p", "h", "g", "before", "after"])

    hits = docs.select(*text_keys(), word_hashes(F.col("text")).alias("w")).mapInArrow(doc_seeds, "k1 long, k2 long, p long, h long, g long, before long, after long")
    # a pair of places inside a longer match says nothing; the join leaves it out. Equal texts bring equal places, of which a set keeps one
    begins, ends = F.col("before") != F.col("item_before"), F.col("after") != F.col("item_after")
    met = hits.join(seeds, (hits["h"] == seeds["h"]) & (hits["g"] == seeds["g"]) & (begins | ends))
    pair = F.struct("p", "q")
    places = met.groupBy("k1", "k2", "i").agg(F.collect_set(F.when(begins, pair)).alias("starts"), F.collect_set(F.when(ends, pair)).alias("ends"))
    rows = places.join(items.select("i", "item_id", F.size("w").cast("long").alias("n")), "i").select("k1", "k2", "item_id", "n", "starts.p", "starts.q", F.col("ends.p").alias("end_p"), F.col("ends.q").alias("end_q"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k1, k2, item_id, n, p, q, end_p, end_q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tiles = tile(zip(p, q, strict=True), zip(end_p, end_q, strict=True), min(SEED, n), n)
                covered = sum(t[2] for t in tiles)
                if covered >= threshold * n:
                    found.append((k1, k2, item_id, covered / n, len(tiles), tiles[0][2], n))
            if found:
                yield pa.record_batch(list(map(pa.array, zip(*found, strict=True))), ["k1", "k2", *COLUMNS[1:]])

    return staged(rows.mapInArrow(judge, "k1 long, k2 long, " + SCHEMA.removeprefix("doc_id long, ")), "tiling-found")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each document and item whose tiles cover at least ``threshold`` of the item."""
    held_to_small_batches(docs.sparkSession)
    items = item_table(benchmark)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    small = small_benchmark(items, broadcast_words)
    if small is None:
        return docs.select(doc_id, *text_keys()).join(joined_by_seeds(docs, items, threshold), ["k1", "k2"]).select(*COLUMNS)
    shipped = docs.sparkSession.sparkContext.broadcast(small)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            rows = []
            for doc_id, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, tiles, covered in own.contaminants(words.values.to_numpy(), threshold):
                    rows.append((doc_id, own.ids[i], covered / len(own.items[i]), len(tiles), tiles[0][2], len(own.items[i])))
            if rows:
                types = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 3]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)

    return docs.select(doc_id, word_hashes(F.col("text")).alias("w")).mapInArrow(match, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs``, as they are, that no benchmark item contaminates; each row is judged by its own text."""
    held_to_small_batches(docs.sparkSession)
    items = item_table(benchmark)
    small = small_benchmark(items, broadcast_words)
    if small is None:
        k1, k2 = unused(docs, "k1"), unused(docs, "k2")
        dirty = joined_by_seeds(docs, items, threshold).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
        keyed = docs.withColumns(dict(zip((k1, k2), text_keys(), strict=True)))
        return keyed.join(dirty, [k1, k2], "left_anti").select(*docs.columns)
    shipped = docs.sparkSession.sparkContext.broadcast(small)
    kept, n = docs.withColumn(unused(docs, "hashes"), word_hashes(F.col("text"))), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dirty = [next(shipped.value.contaminants(words.values.to_numpy(), threshold), None) is not None for words in batch.column(n)]
            yield pa.record_batch(batch.columns[:n], batch.schema.names[:n]).filter(pa.array([not d for d in dirty], pa.bool_()))

    return kept.mapInArrow(clean, docs.schema)
