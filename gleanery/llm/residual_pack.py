"""Best-fit packing in a tree: partitions pack locally, what is left underfull is packed again further up.

Each document becomes one piece of at most ``size`` tokens, or, if it is longer, pieces of ``size`` tokens and a rest. Pieces are
dealt evenly over partitions (by a hash, so every partition sees the lengths of the whole table). Every partition packs its
pieces by best fit, longest first, and emits the sequences that are nearly full. The underfull ones go up a tree as items: at
each level ``fan_in`` nodes meet, their underfull sequences are packed by best fit as if each were one piece, and again the
nearly full ones are emitted.

What goes up stays small whatever the lengths are. Best fit leaves a node at most one sequence that is at most half full, and of
two sequences over half full neither fits into the other; so where ``fan_in`` nodes meet, at most ``fan_in`` sequences look for
a host, and the ``fan_in`` emptiest of each node are hosts enough. A node therefore sends up its one small sequence and its
``fan_in`` emptiest others, and emits the rest as they are.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; repeated rows are packed once for each
repetition; a null doc_id is packed like any other; pieces of equal length are packed in the order of their row, so a repeated
task packs alike; a text of any length is cut into as many pieces as it needs; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged
from .tokens import encoder

ITEM_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = f"{ITEM_SCHEMA}, bin long, offset long, filled long, goes_up boolean"
MOVED_SCHEMA = "node long, bin long, host long, shift long, filled long, goes_up boolean"
#: Pieces that a task packs at once; what it leaves underfull is packed with the next lot.
LOT = 1 << 18


class BestFit:
    """Sequences of at most ``size`` tokens. An item goes where the least room is left after it, or opens a sequence."""

    def __init__(self, size: int):
        self.size = size
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.rooms = 0  # bit r is set if a sequence has room r
        self.filled: dict[int, int] = {}

    def _open_at(self, room: int, name: int) -> None:
        self.by_room[room].append(name)
        self.rooms |= 1 << room

    def add(self, length: int, name: int) -> tuple[int, int]:
        """The sequence taken and the place in it; ``name`` becomes the sequence's if none has room."""
        fitting = self.rooms >> length
        if not fitting:
            self.filled[name] = length
            self._open_at(self.size - length, name)
            return name, 0
        room = length + (fitting & -fitting).bit_length() - 1
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        at = self.filled[found]
        self.filled[found] = at + length
        self._open_at(room - length, found)
        return found, at

    def going_up(self, nearly: int, fan_in: int) -> set[int]:
        """Of the sequences with more room than ``nearly``: those at most half full, and the ``fan_in`` emptiest others."""
        under = sorted((n for n in self.filled if self.size - self.filled[n] > nearly), key=lambda n: (self.filled[n], n))
        small = sum(2 * self.filled[n] <= self.size for n in under)
        return set(under[: small + fan_in])


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: row (a number for the table's row), doc_id, piece, start, length, ids_crc32,
    and the ids themselves (little-endian, unsigned 32 bits) if wanted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: list[list] = [[] for _ in range(7)]
                part = whole.slice(at, 512)
                for row, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    ids = np.append(enc.ids(text.as_py()), enc.dtype.type(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), size)):
                        raw = ids[start : start + size].tobytes()
                        for column, value in zip(out, (row, doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), raw), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 7 if with_ids else 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True)], names[:n])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.mapInArrow(cut, ITEM_SCHEMA + (", ids binary" if with_ids else ""))


def packed_locally(items: DataFrame, size: int, nearly: int, fan_in: int, lot: int = LOT) -> DataFrame:
    """Every item with its sequence, its place there, what the sequence holds and whether it goes up the tree."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, opened = TaskContext.get().partitionId() << 32, 0
        waiting: list[pa.RecordBatch] = []  # items of sequences that the next lot may still fill

        def placed(held: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, list]:
            nonlocal opened
            table = pa.Table.from_batches(held)
            # longest first, whole sequences of the lot before in one place: their items keep their offsets
            table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
            fit, bins, offsets = BestFit(size), [], []
            for length in table.column("length").to_pylist():
                name, at = fit.add(length, node + opened)
                opened += name == node + opened
                bins.append(name)
                offsets.append(at)
            up = fit.going_up(nearly, fan_in)
            table = table.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            table = table.append_column("filled", pa.array([fit.filled[b] for b in bins], pa.int64()))
            rises = pa.array([b in up for b in bins], pa.bool_())
            if last:
                return table.append_column("goes_up", rises), []
            stays = table.filter(pc.invert(rises))
            return stays.append_column("goes_up", pa.array(np.zeros(len(stays), bool))), table.filter(rises).select(table.column_names[:6]).to_batches()

        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= lot:
                done, waiting = placed(waiting, last=False)
                n = sum(b.num_rows for b in waiting)
                yield from done.to_batches()
        if waiting:
            yield from placed(waiting, last=True)[0].to_batches()

    return items.mapInArrow(pack, PLACED_SCHEMA)


def merged(level: DataFrame, size: int, nearly: int, fan_in: int) -> DataFrame:
    """One level of the tree: sequences (node, bin, filled) of each node, packed as items. At most 2 * fan_in * fan_in rows a node."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("filled", "descending"), ("bin", "ascending")])
        fit, hosts = BestFit(size), []
        for name, filled in zip(table.column("bin").to_pylist(), table.column("filled").to_pylist(), strict=True):
            hosts.append(fit.add(filled, name))
        up = fit.going_up(nearly, fan_in)
        columns = [
            table.column("node"), table.column("bin"), pa.array([h for h, _ in hosts], pa.int64()), pa.array([s for _, s in hosts], pa.int64()),
            pa.array([fit.filled[h] for h, _ in hosts], pa.int64()), pa.array([h in up for h, _ in hosts], pa.bool_()),
        ]
        return pa.table(columns, ["node", "bin", "host", "shift", "filled", "goes_up"])

    return level.groupBy("node").applyInArrow(pack, MOVED_SCHEMA)


def pack_best_fit(pieces: DataFrame, size: int = 4096, nearly: int | None = None, fan_in: int = 16, lot: int = LOT) -> DataFrame:
    """The given pieces (row, doc_id, piece, start, length, ids_crc32) with sequence_id and offset. A sequence is nearly full if it
    has at most ``nearly`` tokens of room (a 64th of ``size``)."""
    nearly = size // 64 if nearly is None else nearly
    columns = [*pieces.columns]
    placed = staged(packed_locally(pieces.repartition(F.xxhash64("row", "piece")), size, nearly, fan_in, lot), "packed")
    rising = placed.filter("goes_up AND offset = 0").select((F.shiftright("bin", 32)).alias("node"), "bin", "filled")
    moves = None  # bin: where its items stand after all levels so far
    while True:
        nodes = rising.agg(F.max("node").alias("top")).first()
        if not nodes.top:  # none, or all of one node
            break
        step = staged(merged(rising.select(F.floor(F.col("node") / fan_in).cast("long").alias("node"), "bin", "filled"), size, nearly, fan_in), "level")
        onward = step.select(F.col("bin").alias("at"), F.col("host").alias("to"), F.col("shift").alias("by"))
        if moves is None:
            moves = onward.select(F.col("at").alias("bin"), F.col("to").alias("host"), F.col("by").alias("shift"))
        else:
            # hosts that went no further up keep their place
            moves = moves.join(onward, F.col("host") == F.col("at"), "left").select("bin", F.coalesce("to", "host").alias("host"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
            moves = staged(moves, "moves")
        rising = step.filter("goes_up AND bin = host").select("node", "bin", "filled")
    stay = placed if moves is None else placed.filter("NOT goes_up")
    out = stay.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    if moves is None:
        return out
    moved = placed.filter("goes_up").join(moves, "bin")
    return out.unionByName(moved.select(*columns, F.col("host").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    held_to_small_batches(docs.sparkSession)
    return pack_best_fit(pieces_of(docs, tokenizer_path, end_id, size), size, **how).drop("row")


def packed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, **how) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary, little-endian unsigned 32 bits), n_tokens, and the pieces in order
    (doc_id, piece, length). A group is one sequence, so it is never larger than ``size`` tokens."""
    held_to_small_batches(docs.sparkSession)
    pieces = staged(pieces_of(docs, tokenizer_path, end_id, size, with_ids=True), "pieces")
    placed = pack_best_fit(pieces.drop("ids"), size, **how).select("row", "piece", "sequence_id", "offset")
    rows = pieces.join(placed, ["row", "piece"])
    listed = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("x"), F.sum("length").alias("n_tokens"))
    return listed.select(
        "sequence_id",
        F.aggregate("x", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        "n_tokens",
        F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length"))).alias("pieces"),
    )


def lower_bound(lengths: Iterable[int], size: int) -> int:
    """Fewest sequences that any packing needs: the sum's share, or one for each piece over half of ``size``."""
    lengths = list(lengths)
    return max(-(-sum(lengths) // size), sum(2 * x > size for x in lengths))
