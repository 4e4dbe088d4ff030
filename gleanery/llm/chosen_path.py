"""Near copies by a chosen-path similarity join on word shingles.

A document is the set of its five-word shingles (a shorter text is one shingle of all its words). Documents with the same
set form a class, and the join runs between classes, so copies are never paired with each other.

Every run of the join is a tree. In each node a set samples some of its tokens, each with probability
1 / (threshold * size) by a hash of node and token that all sets share, and goes on to one child for each. Sets that
share many tokens choose the same path; others part. A node of at most ``small`` sets is compared by brute force
and not split further; after ``depth`` levels the others are, too, in pairs of blocks of about ``block`` sets or ``BLOCK_BYTES``
of tokens, whichever are fewer sets, so that a node of any size is spread over tasks and long texts fill no task's memory. Pairs at the threshold share one child on average, so a run finds such a pair with
a known chance, and as many runs are made as the target recall asks for. Links are verified by their exact Jaccard
similarity.

Before texts are read again for verification, sets meet in their nodes as sketches of 64 minima; pairs whose sketches agree
in five standard errors fewer places than a pair at the threshold would are not similar, and a set without any other pair
takes no further part. A pair at exactly the threshold is lost by that with a chance below one in a million, one above
it with less; that is beside the 0.001 that the runs allow.

Each set carries the list of the nodes in which it is compared. A pair is counted only in the smallest node that both
sets have, so the numbers of links are exact counts of the distinct links found although pairs are never written:
a node yields a count for each set, and the components of its links as one edge for each set.

Defined cases: a text that is null, empty or without letters and digits has no set: it is a class of its own row and has no
links; a null doc_id takes part, and names its class only if all of the class are null; repeated rows are copies;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_to_small_batches, staged, unused, word_hashes
from .components import components
from .tiling import rolling

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
SMALL = 64
BLOCK = 1024
BLOCK_BYTES = 8 << 20
BINS = 64
BROADCAST_ROWS = 100_000
WIDE = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words."""
    return np.unique(mix(rolling(words, min(n, len(words))))) if len(words) else np.zeros(0, np.uint64)


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold with at least this chance, if it stays together down to ``depth``."""
    survives = 1.0
    for _ in range(depth):
        survives = 1 - math.exp(-survives)
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def roots(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def children(nodes: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The children that a set chooses in each of its nodes: (places of their parents, children)."""
    limit = np.uint64(min((1 << 64) - 1, int(min(1.0, 1 / (threshold * len(tokens))) * (1 << 64))))
    parents, below = [np.zeros(0, np.int64)], [nodes[:0]]
    for lo in range(0, len(tokens), 1 << 14):
        drawn = mix(tokens[None, lo : lo + (1 << 14)] ^ nodes[:, None])
        chosen = np.nonzero(drawn <= limit)
        parents.append(chosen[0])
        below.append(mix(drawn[chosen] + np.uint64(0x632BE59BD9B4E019)))
    return np.concatenate(parents), np.concatenate(below)


def tree(tokens: np.ndarray, runs: int, depth: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level down to ``depth``: the nodes that a set chooses, and the place of each one's parent among those of the
    level before."""
    levels, above = [], roots(runs)
    for _ in range(depth):
        at, below = children(above, tokens, threshold)
        levels.append((below, at))
        above = below
    return levels


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The smallest token in each of ``BINS`` equal ranges of hashes, 16 bits of it; 0 for an empty range."""
    shift = np.uint64(64 - int(BINS).bit_length() + 1)
    at = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << shift)
    found = tokens[np.minimum(at, len(tokens) - 1)]
    there = (at < len(tokens)) & (found >> shift == np.arange(BINS, dtype=np.uint64))
    return np.where(there, (found & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)).astype(np.uint16)


def with_sets(docs: DataFrame, runs: int, depth: int, threshold: float) -> DataFrame:
    """doc_id, key (of the text), cls (16 bytes that name the set; null without one), its size and sketch, and by level its
    nodes and the places of their parents."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                names, sizes, sketches, nodes, parents = [], [], [], [], []
                for words in batch.column(2):
                    tokens = shingle_set(words.values.to_numpy())
                    some = len(tokens) > 0
                    levels = tree(tokens, runs, depth, threshold) if some else []
                    names.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if some else None)
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens).tobytes() if some else None)
                    nodes.append([x.view(np.int64) for x, _ in levels])
                    parents.append([x for _, x in levels])
                columns = [pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.list_(pa.int64()))), pa.array(parents, pa.list_(pa.list_(pa.int32())))]
                yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "key", "cls", "size", "sketch", "nodes", "parents"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), word_hashes(F.col("text")).alias("w"))
    return picked.mapInArrow(split, "doc_id long, key long, cls binary, size int, sketch binary, nodes array<array<long>>, parents array<array<int>>")


def token_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and its tokens, for the classes of ``wanted`` (a staged table: doc_id and key of one text of each). Texts are read again rather
    than kept as tokens, which would take more room than the texts. A short list of wanted texts is broadcast; a longer
    one meets the texts in a shuffle."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w.values.to_numpy()).tobytes() for w in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["cid", "tokens"])

    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["key"] == wanted["key"])
    found = texts.join(wanted, same).select("cid", word_hashes(F.col("text")).alias("w"))
    # a repeated row may bring its class twice; comparisons drop the second
    return found.mapInArrow(tokens, "cid long, tokens binary")


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """cid, node, n, tokens_n: the nodes of at least two sets with their size and the tokens of their sets (where rows have a size); of nodes
    with the same sets one stays."""
    weight = F.sum(F.col("size") if "size" in rows.columns else F.lit(0)).cast("long").alias("tokens_n")
    rows, members = rows.select("cid", "node"), rows.groupBy("node").agg(F.count("*").alias("n"), weight, F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
    one = members.filter("n > 1").groupBy("n", "x", "y").agg(F.min("node").alias("node"), F.min("tokens_n").alias("tokens_n")).select("node", "n", "tokens_n")
    return rows.join(one, "node")


def split_nodes(classes: DataFrame, depth: int, small: int) -> tuple[DataFrame, list[DataFrame]]:
    """cid, node, n of the nodes in which sets are compared: those of at most ``small`` sets, and all that are left at the
    last level; and the staged tables behind it."""
    active, leaves, levels = classes.select("cid", F.explode(F.get("nodes", F.lit(0))).alias("node")), [], []
    for level in range(1, depth + 1):
        sizes = active.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        held = staged(active.join(sizes, "node"), "path-nodes")
        levels.append(held)
        if level == depth or held.filter(F.col("n") > small).isEmpty():
            leaves.append(held.select("cid", "node"))
            break
        leaves.append(held.filter(F.col("n") <= small).select("cid", "node"))
        crowded = held.filter(F.col("n") > small).groupBy("cid").agg(F.collect_set("node").alias("crowded"))  # runs / threshold**level of them on average
        parent = lambda i: F.get(F.get("nodes", F.lit(level - 1)), F.get(F.get("parents", F.lit(level)), i))  # noqa: B023, E731
        below = F.filter(F.get("nodes", F.lit(level)), lambda x, i: F.array_contains("crowded", parent(i)))  # noqa: B023
        active = classes.select("cid", "nodes", "parents").join(crowded, "cid").select("cid", F.explode(below).alias("node"))
    return distinct_nodes(functools.reduce(DataFrame.union, leaves)), levels


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Adds mine, a and b to rows with cid, node, n and tokens_n: every two blocks of a node meet in one (node, a, b)."""
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("tokens_n") * 8 / BLOCK_BYTES)).cast("int")
    out = rows.withColumn("mine", F.pmod(F.xxhash64("cid", F.lit(2)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")}).drop("other", "n", "tokens_n")


def alike(sketches: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches could be of sets that reach the threshold."""
    agree, used = np.zeros((len(sizes), len(sizes)), np.int16), np.zeros((len(sizes), len(sizes)), np.int16)
    for column in sketches.T:
        agree += (column[:, None] == column) & (column > 0)
        used += (column[:, None] > 0) | (column > 0)
    least = threshold * used - 5 * np.sqrt(threshold * (1 - threshold) * used)
    return (agree >= least) & (np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes))


def suspects(leaves: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """cid, node, size of the sets that could have a link in the node."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        near = alike(np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, BINS), table["size"].to_numpy().astype(np.int64), threshold)
        np.fill_diagonal(near, False)
        if key[1].as_py() != key[2].as_py():
            mine = table["mine"].to_numpy()
            near &= mine[:, None] != mine
        return table.select(["cid", "node", "size"]).filter(pa.array(near.any(axis=1)))

    rows = leaves.join(classes.select("cid", "size", "sketch"), "cid")
    found = dealt(rows, block).groupBy("node", "a", "b").applyInArrow(compare, "cid long, node long, size int")
    return found.distinct()


def links_in_node(node: int, names: list[int], sets: list[np.ndarray], places: list[list[int]], side: np.ndarray | None, threshold: float) -> list[tuple[int, int, int]]:
    """(set, number of its links, first set of its component) of the links of a node that no smaller node has.
    ``side``: the block of each set if only pairs between two blocks are asked for."""
    order = sorted({name: i for i, name in enumerate(names)}.items())
    at = [i for _, i in order]
    if len(at) < 2:
        return []
    names, sets, places = [names[i] for i in at], [sets[i] for i in at], [places[i] for i in at]
    size = np.array([len(s) for s in sets], np.int64)
    open_ = np.triu(np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size), 1)
    if side is not None:
        open_ &= side[at][:, None] != side[at]
    before = [[p for p in own if p < node] for own in places]
    values, column, holders = np.unique(np.array([p for b in before for p in b], np.int64), return_inverse=True, return_counts=True)
    # a node of one set alone is no pair's; the others go in stripes
    owner, several = np.repeat(np.arange(len(at)), [len(b) for b in before]), holders[column] > 1
    owner, column = owner[several], (np.cumsum(holders > 1) - 1)[column[several]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    for lo in range(0, int((holders > 1).sum()), WIDE):
        x, y = np.searchsorted(column, (lo, lo + WIDE))
        seen = np.zeros((len(at), WIDE), np.float32)
        seen[owner[x:y], column[x:y] - lo] = 1
        open_ &= (seen @ seen.T) == 0
    linked = np.zeros_like(open_)
    pairs = np.argwhere(open_)
    if not len(pairs):
        return []
    if len(pairs) <= 4 * len(at):
        for i, j in pairs:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked[i, j] = both / (size[i] + size[j] - both) >= threshold
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(at)), size)
        common = np.bincount(column, minlength=len(values)) > 1
        place = np.cumsum(common) - 1
        owner, column = owner[common[column]], place[column[common[column]]]
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        both = np.zeros(open_.shape, np.float32)
        for lo in range(0, int(common.sum()), WIDE):
            a, b = np.searchsorted(column, (lo, lo + WIDE))
            part = np.zeros((len(at), WIDE), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            both += part @ part.T
        for lo in range(0, len(at), 256):  # in stripes, so that doubles of all pairs never stand in memory
            some = slice(lo, lo + 256)
            linked[some] = open_[some] & (both[some] / np.maximum(size[some, None] + size - both[some].astype(np.float64), 1) >= threshold)
    linked |= linked.T
    degree = linked.sum(axis=1)
    first, left = np.arange(len(at)), degree > 0
    while left.any():
        start = int(left.argmax())
        frontier = np.zeros(len(at), bool)
        frontier[start] = True
        while frontier.any():
            first[frontier], left[frontier] = start, False
            frontier = linked[frontier].any(axis=0) & left
    return [(names[i], int(degree[i]), names[first[i]]) for i in np.flatnonzero(degree)]


def compared(leaves: DataFrame, tokens: DataFrame, threshold: float, block: int) -> DataFrame:
    """cid, links, root: for each set and node (``leaves`` has cid, node and the set's size) the links counted there, and a set of the same
    component."""
    own = distinct_nodes(leaves).groupBy("cid").agg(F.collect_list(F.struct("node", "n", "tokens_n")).alias("places"))
    rows = own.join(tokens, "cid").select("cid", "tokens", F.col("places.node").alias("nodes"), F.explode("places").alias("place"))
    rows = dealt(rows.select("cid", "tokens", "nodes", "place.node", "place.n", "place.tokens_n"), block)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, a, b = (k.as_py() for k in key)
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table["tokens"]]
        side = table["mine"].to_numpy() if a != b else None
        found = links_in_node(node, table["cid"].to_pylist(), sets, table["nodes"].to_pylist(), side, threshold)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3, strict=True)], ["cid", "links", "root"])

    return rows.groupBy("node", "a", "b").applyInArrow(compare, "cid long, links long, root long")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, cls), and classes with a set: cls, class_id (smallest doc_id of all classes joined by links), keeper
    (doc_id and key of that document), copies (rows of the class) and links (other classes it is linked with)."""
    held_to_small_batches(docs.sparkSession)
    runs = runs_for(recall, depth)
    rows = staged(with_sets(docs, runs, depth, threshold), "path-sets")
    some = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    whole = F.first(F.struct("size", "sketch", "nodes", "parents")).alias("whole")  # the same in all rows of a class
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(some).alias("keeper"), F.count("*").alias("copies"), whole)
    # a class goes by a number from here on
    classes = staged(classes.select("cls", "keeper", "copies", "whole.*", F.monotonically_increasing_id().alias("cid")), "path-classes")
    nodes, levels = split_nodes(classes, depth, small)
    leaves = staged(suspects(nodes, classes, threshold, block), "path-suspects")
    discard(*levels)
    wanted = classes.join(leaves.select("cid").distinct(), "cid").select("cid", "keeper.doc_id", "keeper.key")
    wanted = staged(wanted, "path-wanted")
    found = staged(compared(leaves, token_table(docs, wanted), threshold, block), "path-links")
    discard(leaves, wanted)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.filter(F.col("cid") != F.col("root")).select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "cls", "keeper", "copies").join(links, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left")
    named = named.select("cls", "keeper", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    firsts = named.groupBy("component").agg(F.min("keeper").alias("first"))
    return rows, named.join(firsts, "component").select("cls", F.col("first.doc_id").alias("class_id"), F.col("first").alias("keeper"), "copies", "links")


def jaccard_join(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, class_id, n_copies (rows with the same set), n_links (other sets it is linked with) of each row. Classes joined
    by links share a class_id, the smallest doc_id among them."""
    rows, classes = near_copies(docs, **how)
    out = rows.select("doc_id", "cls").join(classes, "cls", "left")
    own = F.col("cls").isNull()
    return out.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **how: float) -> DataFrame:
    """The rows of ``docs``, as they are, without the near copies: of each class joined by links the row with the smallest
    doc_id stays (of repeated rows, one). Rows without a set all stay."""
    rows, classes = near_copies(docs, **how)
    own_id, own_key = unused(docs, "own_id"), unused(docs, "own_key")
    kept = classes.select("keeper.doc_id", "keeper.key").distinct().select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    some = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    marked = docs.filter(some).withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.xxhash64("text")}).alias("d")
    copies = marked.join(kept.alias("k"), F.col(f"d.{own_id}").eqNullSafe(F.col("k.kept_id")) & (F.col(f"d.{own_key}") == F.col("k.kept_key")), "left_semi")
    return copies.dropDuplicates([own_id, own_key]).select(*docs.columns).union(docs.filter(~some))
