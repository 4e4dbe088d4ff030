import hashlib
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import turn_repair
from gleanery.llm.turn_repair import AFTER_ALL, BLANK, CUT_OFF, DUPLICATE, SOUND, START, UNREACHED, code, damaged, distances, inserts_after, repair_report, repaired_turns, settle, table_of, walk

GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, times string, mark string, part long"


def all_audits(turns, most):
    """Every audit of cost up to ``most`` that ends well, with its cost, by plain enumeration."""
    out = []

    def go(at, letters, roles, cost):
        if cost > most or len(letters) > len(turns) + 2:
            return
        if at == len(turns) and GOOD.fullmatch(roles):
            out.append((cost, letters))
        for who in "ua":
            go(at, letters + "I", roles + who, cost + 5)
        if at < len(turns):
            initial, fault = turns[at]
            go(at + 1, letters + "D", roles, cost + 2)
            if fault not in (BLANK, DUPLICATE):
                extra = 5 if fault == CUT_OFF else 0
                go(at + 1, letters + "K", roles + initial, cost + extra)
                for who in "ua":
                    go(at + 1, letters + "R", roles + who, cost + 1 + extra)

    go(0, "", "", 0)
    return out


def test_audits_are_the_cheapest_and_least():
    cases = [list(zip(r, f, strict=True)) for n in range(4) for r in product("suat", repeat=n) for f in product((SOUND, DUPLICATE, CUT_OFF), repeat=n)][::7]
    cases += [list(zip("sauaauus", [SOUND] * 8, strict=True))[:k] for k in range(7)]
    for turns in cases:
        codes = bytes(code(r, f) for r, f in turns)
        assert settle(codes) == min(all_audits(turns, 2 * len(turns))), turns


CODES = st.lists(st.builds(code, st.sampled_from("suat"), st.sampled_from([SOUND, SOUND, BLANK, DUPLICATE, CUT_OFF])), max_size=40).map(bytes)


@settings(max_examples=200, deadline=None)
@given(codes=CODES, cuts=st.lists(st.integers(0, 40), max_size=4))
def test_stretches_give_what_the_whole_gives(codes, cuts):
    cuts = sorted({0, len(codes), *(c for c in cuts if c < len(codes))})
    parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [b""]
    after = [AFTER_ALL]
    for p in reversed(parts[1:] if len(parts) > 1 else []):
        t = table_of(p)
        after.append(tuple(min(t[4 * s + g] + after[-1][g] for g in range(4)) for s in range(4)))
    state, audit, cost = START, "", None
    for p, a in zip(parts, reversed(after), strict=True):
        least = distances(p, a)
        cost = least[START] if cost is None else cost
        letters, state = walk(p, least, state)
        audit += letters
    assert (cost, audit + inserts_after(state)) == settle(codes)


def test_distances_equal_relaxation():
    codes = bytes(code(r, f) for r, f in zip("suaauusata" * 3, [SOUND, CUT_OFF, SOUND, DUPLICATE, SOUND] * 6, strict=True))
    least = distances(codes, AFTER_ALL)
    want = [UNREACHED] * (4 * len(codes)) + list(AFTER_ALL)
    for _ in range(4 * len(codes)):
        for turn in range(len(codes)):
            for state, found in enumerate(turn_repair.arcs(codes[turn])):
                for _, done, onward, cost in found:
                    want[4 * turn + state] = min(want[4 * turn + state], cost + want[4 * (turn + done) + onward])
    assert least == want


def expected(rows, damage=True):
    """The contract, row by row."""
    by_conv = {}
    sp = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        mine = by_conv.setdefault(conv_id, [])
        role, text, times = sp(role), sp(text), 1
        kind = zlib.crc32(f"{sp(conv_id)}:{sp(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            times = 0
        elif kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 3:
            times = 2
        elif kind == 4:
            role = "user"
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        mine += [((turn is not None, turn or 0, key), turn, role, text)] * times
    out = {}
    for conv_id, mine in by_conv.items():
        mine.sort(key=lambda r: r[0])
        seen, codes, faults, illegal = set(), [], [0] * 4, 0
        for i, (_, _, role, text) in enumerate(mine):
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = BLANK if not last else DUPLICATE if (role, text) in seen else CUT_OFF if last[0] not in ".!?" else SOUND
            seen.add((role, text))
            faults[fault] += 1
            codes.append(code(role[:1], fault))
            illegal += bool(i) and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = settle(bytes(codes))
        roles, texts = turn_repair.applied(audit, [m[2] for m in mine], [m[3] for m in mine], START)
        numbers = {m[1] for m in mine if m[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode()).hexdigest()
        out[conv_id] = (gaps, *faults[1:], illegal, cost, audit, digest)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA)


def awkward():
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    texts = ["Hello there.", "Fine!", None, "", " \t\x0b", "no end", "same.", "same.", "word. " * 20000, "Ж世界?", "a:b\nuser:c."]
    rows = [(c, t if (c + t) % 9 else None, roles[(c * 3 + t) % 8], texts[(c * 7 + t * t) % 11]) for c in range(40) for t in range(c % 9)]
    rows += [(None, t, "user" if t % 2 else "assistant", f"to {t % 5}.") for t in (5, 3, 9, 3, 2**40)]
    rows += [(900, 4, "user", "copy.")] * 5 + [(901, None, "system", "x")] * 3 + [(902, 1, "user", "b."), (902, 1, "assistant", "a.")]
    # one conversation of most of all turns, with copies far apart
    rows += [(950, t, ("system", "user", "assistant", "user")[(t * t) % 4], f"text {t % 170}{'.' if t % 7 else ''}") for t in range(900)]
    return rows


def as_map(df):
    found = [(r.conv_id, (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


@pytest.mark.parametrize("stretch", [3, 64, 4096])
def test_report_equals_the_contract(spark, stretch):
    rows = awkward()
    df = damaged(table(spark, rows)).repartition(5)
    from pyspark.sql import functions as F

    assert as_map(repair_report(df, F.col("times"), stretch)) == expected(rows)


def test_repaired_turns_read_well(spark):
    rows = awkward()
    got = {}
    for r in sorted(repaired_turns(table(spark, rows), stretch=50).collect(), key=lambda r: (str(r.conv_id), r.part, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = expected(rows, damage=False)
    for conv_id, (*_, digest) in want.items():
        turns = got.get(conv_id, [])
        assert GOOD.fullmatch("".join(r[:1] for r, _ in turns))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == digest


def test_conversation_without_turns_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    from pyspark.sql import functions as F

    empty = hashlib.sha256(b"").hexdigest()
    assert as_map(repair_report(damaged(table(spark, [(gone, 0, "user", "x.")])), F.col("times"))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repair_report(damaged(table(spark, [])), F.col("times")).count() == 0
