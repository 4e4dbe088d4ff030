"""Repair of the structure of conversations at the least cost of edits.

A conversation is a row of turns; its roles should read as an optional system turn and then pairs of user and assistant. Each turn
is kept (no cost), given another role (1) or deleted (2), and turns without text may be inserted anywhere (5). Blank and repeated
turns must be deleted; a truncated turn that stays costs 5 more. The edits are a path through nodes (turns done, role before), found
as shortest distances to the end by Dial's queue of buckets, since all costs are small whole numbers; the audit is then walked from
the start along arcs that keep to these distances, taking the least letter (D, I, K, R) wherever several do.

Conversations are range-sorted by turn, so the turns of one may span many tasks. A stretch of turns is a step of at most ``stretch``
turns or 8 MB of text. Stretches that hold a whole conversation are settled where they are read. Of a longer conversation each
stretch gives its 4 x 4 distances between the roles before and after it; these small tables are folded from the last to the first,
which gives every stretch the distances to the end at its own end; all stretches are then walked at once, from each of the four roles
before, and read once more in order to pick the walk that applies and to add to the digest. No task holds a conversation whole.

Defined cases: null roles and texts count as one space; a null conv_id is a conversation like any other; null turns come first; turns
of equal number stand in the order of a digest of their role and text, and copies side by side; a role that is neither s.., u.. nor
a.. has to be changed or deleted; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged

#: Costs of the edits, and the roles by the state that they lead to (0 is the start).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What may follow each state, by the first letter of a role; user or assistant that a changed or inserted turn becomes there.
ALLOWED = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
TURN_THERE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LETTERS = "sua?"
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Adjacent roles that are as they should be.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Distances to the end behind the last turn, by inserts alone.
AFTER_ALL = (0, 2 * INSERT, INSERT, 0)
STRETCH, STRETCH_BYTES = 4096, 8 << 20
UNREACHED = 1 << 40

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART_SCHEMA = f"conv_id long, part long, edits string, roles array<string>, texts array<string>, {REPORT}, codes binary, table array<long>, turns array<long>"
FINAL_SCHEMA = f"conv_id long, part long, edits string, roles array<string>, texts array<string>, {REPORT}"
WHITE = " \t\n\x0b\x0c\r"


def code(letter: str, fault: int) -> int:
    """A turn as the search sees it: the first letter of its role and its fault."""
    return 4 * LETTERS.find(letter if letter in LETTERS[:3] and letter else "?") + fault


@functools.cache
def arcs(turn: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """For each state the arcs (letter, turns done, next state, cost) at a turn of this code, by letter."""
    letter, fault = LETTERS[turn // 4], turn % 4
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state in range(4):
        found = [("D", 1, state, DELETE), ("I", 0, TURN_THERE[state], INSERT)]
        if fault not in (BLANK, DUPLICATE):
            if (letter, state) in ALLOWED:
                found.append(("K", 1, ALLOWED[letter, state], KEEP + extra))
            found.append(("R", 1, TURN_THERE[state], REROLE + extra))
        out.append(tuple(found))
    return tuple(out)


@functools.cache
def arcs_into(turn: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state the arcs (turns done, state before, cost) that lead into it."""
    back: list[list] = [[], [], [], []]
    for state, found in enumerate(arcs(turn)):
        for _, done, onward, cost in found:
            back[onward].append((done, state, cost))
    return tuple(map(tuple, back))


def distances(codes: bytes, after: tuple[int, ...]) -> list[int]:
    """The least cost from each node (4 * turns done + state) to the end, where ``after`` is to be paid behind the last turn. Nodes
    are settled from bucket to bucket; no bucket is sorted."""
    n, floor = len(codes), min(after)
    least = [UNREACHED] * (4 * n + 4)
    buckets: list[list[int]] = []

    def put(node: int, cost: int) -> None:
        if cost < least[node]:
            least[node] = cost
            while len(buckets) <= cost:
                buckets.append([])
            buckets[cost].append(node)

    for state, cost in enumerate(after):
        if cost < UNREACHED:
            put(4 * n + state, cost - floor)
    now = 0
    while now < len(buckets):
        for node in buckets[now]:  # arcs without cost add to the bucket that is being read
            if least[node] != now:
                continue
            turn, state = divmod(node, 4)
            if turn < n:
                for done, before, cost in arcs_into(codes[turn])[state]:
                    if not done:
                        put(4 * turn + before, now + cost)
            if turn:
                for done, before, cost in arcs_into(codes[turn - 1])[state]:
                    if done:
                        put(4 * turn - 4 + before, now + cost)
        buckets[now] = []
        now += 1
    return [x + floor if x < UNREACHED else x for x in least]


def walk(codes: bytes, least: list[int], state: int) -> tuple[str, int]:
    """The least letters along arcs that keep to the distances, and the state behind the last turn."""
    out, turn = [], 0
    while turn < len(codes):
        here = least[4 * turn + state]
        for letter, done, onward, cost in arcs(codes[turn])[state]:
            if cost + least[4 * (turn + done) + onward] == here:
                out.append(letter)
                turn, state = turn + done, onward
                break
    return "".join(out), state


def inserts_after(state: int) -> str:
    return "I" * (AFTER_ALL[state] // INSERT)


@functools.lru_cache(1 << 16)
def settled(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation; short ones are much alike and are remembered."""
    least = distances(codes, AFTER_ALL)
    letters, state = walk(codes, least, START)
    return least[START], letters + inserts_after(state)


def settle(codes: bytes) -> tuple[int, str]:
    return settled(codes) if len(codes) <= 64 else settled.__wrapped__(codes)


def table_of(codes: bytes) -> list[int]:
    """The distances of a stretch from each state before it (rows) to each behind it."""
    columns = [distances(codes, tuple(0 if s == goal else UNREACHED for s in range(4)))[:4] for goal in range(4)]
    return [columns[goal][state] for state in range(4) for goal in range(4)]


def applied(letters: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """The turns that stand after the edits."""
    new_roles, new_texts, at = [], [], 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            new_roles.append(roles[at])
            state = ALLOWED[roles[at][:1], state]
        else:
            state = TURN_THERE[state]
            new_roles.append(NAMES[state])
        if letter == "I":
            new_texts.append("")
        else:
            new_texts.append(texts[at])
            at += 1
    return new_roles, new_texts


def lines(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join([f"{r}:{t}" for r, t in zip(roles, texts, strict=True)]).encode()


class Stretch:
    """Turns of one conversation in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.codes, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.first = self.last = self.distinct = 0  # of the numbers of its turns
        self.faults, self.illegal = [0, 0, 0, 0], 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        letter = role[:1]
        if self.roles and (self.roles[-1][:1], letter) not in LEGAL:
            self.illegal += 1
        self.codes.append(code(letter, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        self.faults[fault] += 1
        if turn is not None:
            if not self.distinct:
                self.first = self.last = turn
                self.distinct = 1
            elif turn != self.last:
                self.last = turn
                self.distinct += 1

    def row(self, part: int, whole: bool, with_turns: bool) -> tuple:
        codes, faults = bytes(self.codes), self.faults
        if not whole:
            ends = [self.roles[0][:1], self.roles[-1][:1]] if self.roles else ["", ""]
            turns = [self.distinct, self.first, self.last, faults[BLANK], faults[DUPLICATE], faults[CUT_OFF], self.illegal, *(ord(e) if e else -1 for e in ends)]
            return self.conv_id, part, None, self.roles, self.texts, *[None] * 8, codes, table_of(codes), turns
        cost, audit = settle(codes)
        roles, texts = applied(audit, self.roles, self.texts, START)
        digest = hashlib.sha256(lines(roles, texts)).hexdigest()
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        kept = (roles, texts) if with_turns else ([], [])
        return self.conv_id, part, audit, *kept, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT_OFF], self.illegal, cost, audit, digest, None, None, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def sound_turns(conversations: DataFrame, times: Column) -> DataFrame:
    """The columns that the repair reads: conv_id, turn, role, text, times (how often the row stands there; 0 only witnesses the
    conversation)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), times.cast("int").alias("times"))


def _fault() -> Column:
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    return F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)


def in_order(conversations: DataFrame, times: Column) -> DataFrame:
    """Turns sorted over all tasks, each with its fault: conv_id, turn, role, text, times, fault, mark. A row with a mark says that the
    next row was seen before; so texts cross the network once, and only the keys of repeated turns a second time."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    turns = staged(sound_turns(conversations, times).withColumns({"fault": _fault(), "digest": digest, "at": F.monotonically_increasing_id()}), "turns")
    keys = turns.filter("times > 0").select("conv_id", "digest", "turn", "at")
    first = keys.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("said")).agg(F.min(F.struct("turn", "at")).alias("first"), F.count("*").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("said"))
    repeated = keys.join(first.filter("n > 1"), same).filter(F.struct("turn", "at") > F.col("first"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    marks = repeated.select("conv_id", "turn", none("role", "string"), none("text", "string"), none("times", "int"), none("fault", "int"), "digest", "at", F.lit(1).alias("mark"))
    order = ["conv_id", "turn", "digest", "at"]
    rows = turns.withColumn("mark", F.lit(0)).unionByName(marks)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc()).select("conv_id", "turn", "role", "text", "times", "fault", "mark")


def _stretches(ordered: DataFrame, stretch: int, with_turns: bool) -> DataFrame:
    """A row for each stretch; ``gaps`` is null where the conversation may go on in another one."""
    schema = _arrow(PART_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, marked, open_, parted = TaskContext.get().partitionId() << 32, [], False, None, True
        # parted: what is open may have begun before, in another task or in the stretch before

        def close(whole: bool) -> None:
            nonlocal part
            held.append(open_.row(part, whole, with_turns))
            part += 1

        for batch in batches:
            for conv_id, turn, role, text, times, fault, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None:
                    open_ = Stretch(conv_id)
                elif open_.conv_id != conv_id:
                    close(whole=not parted)
                    open_, parted = Stretch(conv_id), False
                if mark:
                    marked = True
                    continue
                for copy in range(times):
                    if len(open_.codes) >= stretch or open_.size > STRETCH_BYTES:
                        close(whole=False)
                        open_, parted = Stretch(conv_id), True
                    open_.add(turn, role, text, DUPLICATE if (marked or copy) and fault != BLANK else fault)
                marked = False
            if held:
                yield _batch(held, schema)
                held.clear()
        if open_ is not None:
            close(whole=False)
            yield _batch(held, schema)

    return ordered.mapInArrow(read, PART_SCHEMA)


def _folded(table: pa.Table) -> pa.Table:
    """part and the distances to the end behind it, of the stretches of one conversation; 16 numbers a stretch are read."""
    table = table.sort_by([("part", "descending")])
    after, out = list(AFTER_ALL), []
    for row in table.column("table").to_pylist():
        out.append(after)
        after = [min(row[4 * state + goal] + after[goal] for goal in range(4)) for state in range(4)]
    return pa.table([table.column("part"), pa.array(out, pa.list_(pa.int64()))], ["part", "after"])


def _walked(parts: DataFrame) -> DataFrame:
    """Each stretch with the letters and the state behind it for every state before it, and with the distance from there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True):
                least = distances(codes, tuple(after))
                out.append([walk(codes, least, state) for state in range(4)] + [least[START]])
            new = [pa.array([[w[0] for w in o[:4]] for o in out], pa.list_(pa.string())), pa.array([[w[1] for w in o[:4]] for o in out], pa.list_(pa.int64())), pa.array([o[4] for o in out], pa.int64())]
            columns = [batch.column(c) for c in ("conv_id", "part", "roles", "texts", "turns")]
            yield pa.record_batch([*columns, *new], ["conv_id", "part", "roles", "texts", "turns", "letters", "states", "cost"])

    return parts.mapInArrow(read, "conv_id long, part long, roles array<string>, texts array<string>, turns array<long>, letters array<string>, states array<long>, cost long")


def _joined(walked: DataFrame, with_turns: bool) -> DataFrame:
    """The stretches of the long conversations in order: the walk that applies, and behind the last stretch the report."""
    schema = _arrow(FINAL_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, began = None, None, False

        def finish() -> tuple:
            """The row of the last stretch, with the report."""
            tail = inserts_after(now["state"])
            roles, texts = applied(tail, [], [], now["state"])
            now["audit"].append(tail)
            add(roles, texts)
            conv_id, part, edits, old_roles, old_texts = last
            kept = ([*old_roles, *roles], [*old_texts, *texts]) if with_turns else ([], [])
            n = now["turns"]
            gaps = n[2] - n[1] + 1 - n[0] if n[0] else 0
            return conv_id, part, edits + tail, *kept, gaps, *n[3:7], now["cost"], "".join(now["audit"]), now["digest"].hexdigest()

        def add(roles: list[str], texts: list[str]) -> None:
            if roles:
                now["digest"].update(b"\n" * now["any"] + lines(roles, texts))
                now["any"] = True

        for batch in batches:
            out = []
            for conv_id, part, roles, texts, turns, letters, states, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or conv_id != last[0]:
                    if began:
                        out.append(finish())
                    now = {"state": START, "audit": [], "digest": hashlib.sha256(), "any": False, "cost": cost, "turns": list(turns)}
                else:
                    out.append((*last[:3], *(last[3:] if with_turns else ([], [])), *[None] * 8))
                    n = now["turns"]
                    if turns[0]:
                        n[0], n[1], n[2] = n[0] + turns[0] - bool(n[0] and n[2] == turns[1]), n[1] if n[0] else turns[1], turns[2]
                    n[3:7] = [x + y for x, y in zip(n[3:7], turns[3:7], strict=True)]
                    if roles and now["row"]:
                        n[6] += (chr(n[8]) if n[8] >= 0 else "", chr(turns[7]) if turns[7] >= 0 else "") not in LEGAL
                    if roles:
                        n[8] = turns[8]
                now["row"] = now.get("row", False) or bool(roles)
                edits = letters[now["state"]]
                new_roles, new_texts = applied(edits, roles, texts, now["state"])
                add(new_roles, new_texts)
                now["audit"].append(edits)
                now["state"] = states[now["state"]]
                last, began = (conv_id, part, edits, new_roles, new_texts), True
            yield _batch(out, schema)
        if began:
            yield _batch([finish()], schema)

    sorted_ = walked.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part")
    return sorted_.mapInArrow(read, FINAL_SCHEMA)


def repaired_parts(conversations: DataFrame, times: Column | None = None, stretch: int = STRETCH, with_turns: bool = True) -> DataFrame:
    """Repaired conversations as one row for each stretch: conv_id, part (their order), edits, the roles and texts that stand now (if
    wanted), and with the last stretch of a conversation its report: gaps, blank, duplicate, truncated, illegal, cost, audit and the
    digest of its lines. ``conversations`` has conv_id, turn, role and text; each row counts ``times`` times (once)."""
    held_to_small_batches(conversations.sparkSession)
    parts = staged(_stretches(in_order(conversations, F.lit(1) if times is None else times), stretch, with_turns), "stretches")
    names = FINAL_SCHEMA.split(", ")
    done = parts.filter("gaps IS NOT NULL").select(*(n.split(" ")[0] for n in names))
    long_ = parts.filter("gaps IS NULL")
    after = long_.select("conv_id", "part", "table").groupBy("conv_id").applyInArrow(_folded, "part long, after array<long>")
    walked = _walked(long_.join(after, "part").select("conv_id", "part", "roles", "texts", "turns", "codes", "after"))
    return done.unionByName(_joined(walked, with_turns))


def repair_report(conversations: DataFrame, times: Column | None = None, stretch: int = STRETCH) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    return repaired_parts(conversations, times, stretch, with_turns=False).filter("gaps IS NOT NULL").drop("part", "edits", "roles", "texts")


def repaired_turns(conversations: DataFrame, times: Column | None = None, stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations: conv_id, part and place (their order), role, text."""
    listed = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")
    return repaired_parts(conversations, times, stretch).select("conv_id", "part", listed).select("conv_id", "part", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of their key: dropped (times 0), emptied, without signs at the ends of sentences,
    repeated (times 2), or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
