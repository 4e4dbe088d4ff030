"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a span
classifier trained on the outcome decides.

Candidates are found by patterns over the whole text: the fixed base patterns, and wider ones (spelled-out addresses,
phone numbers without a country code, numbers in the form of identity numbers, and whatever the base rules turned down).
Five labelers vote for, against or not at all on each candidate: the base rule, the form of the match, a gazetteer, the
words before it, and what it touches. Spark counts the vote patterns of all candidates; the table of patterns is bounded by
kinds times 3**5 and is all that expectation-maximisation needs to estimate how reliable each labeler is. A logistic
classifier on the span's shape and context is then fitted to the posteriors of a bounded sample (``max_spans``, by a
hash). Base spans always count, so candidates that overlap one are left out at once. All others are voted on and classified,
whether they overlap each other or not; those count that the classifier gives ``least`` or more, and only of such ones that
overlap, the likeliest stays.

Defined cases: a null or empty text has no spans; without candidates nothing is fitted and only base spans count; texts of any length are scanned
whole, and runs of thousands of digits, signs or dots in time that grows with them alone; repeated rows are scanned once each; a null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_to_small_batches, staged, unused

KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]
LABELERS = 5
WIDTH = 1 << 12

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk us eu ch at it nl ca au jp cn br in ru pl se no dk fi be ie pt gr cz mx".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "62", "64", "65", "35", "30", "36", "38")
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "login", "from", "client"),
    "card": ("card", "visa", "pay", "credit", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "dial"),
    "id": ("ssn", "social", "passport", "identity", "insurance", "tax"),
}
AGAINST = ("version", "ver", "isbn", "order", "invoice", "model", "section", "release", "item", "part", "figure")

IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...] = ()
    features: list[int] = field(default_factory=list)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, walking from one @ to the next so that a long run without
    one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def candidates(text: str) -> list[Span]:
    """All candidates, base ones first, without votes; those that overlap a base span are left out, others may overlap."""
    base, more = [Span("email", s, e, True) for s, e in emails(text)], []
    for m in IP.finditer(text):
        fits = all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split(".")))
        (base if fits else more).append(Span("ip", m.start(), m.end(), fits))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        fits = 16 <= len(digits) <= 19 and luhn(digits)
        if fits or 13 <= len(digits) <= 19:
            (base if fits else more).append(Span("card", m.start(), m.end(), fits))
    for m in PHONE.finditer(text):
        fits = 8 <= len(digits_of(m[0])) <= 15
        (base if fits else more).append(Span("phone", m.start(), m.end(), fits))
    for kind, pattern in (("email", SPELLED), ("phone", LOCAL_PHONE), ("id", IDENTITY)):
        more += [Span(kind, m.start(), m.end(), False) for m in pattern.finditer(text)]
    base.sort(key=lambda s: (KINDS.index(s.kind), s.start))
    if not more:
        return base
    return base + sorted(clear(more, base), key=by_place)


def by_place(s: Span) -> tuple:
    """Leftmost first, then longest, then by kind."""
    return s.start, -s.end, KINDS.index(s.kind)


def clear(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap none of ``taken``."""
    fixed = sorted((s.start, s.end) for s in taken)
    if not fixed:
        return spans
    starts, reach = [f[0] for f in fixed], np.maximum.accumulate([e for _, e in fixed])
    # of all taken spans that begin before a span ends, the farthest reach decides
    before = np.searchsorted(starts, [s.end for s in spans]).tolist()
    return [s for s, n in zip(spans, before, strict=True) if not n or reach[n - 1] <= s.start]


def without_overlaps(spans: list[Span], taken: list[Span], order: Callable[[Span], tuple] = by_place) -> list[Span]:
    """Spans that overlap neither ``taken`` nor one that comes before them in the order."""
    kept, held = [], []  # held: the kept places, sorted
    for s in sorted(clear(spans, taken), key=order):
        i = bisect.bisect(held, (s.start, s.end))
        if (not i or held[i - 1][1] <= s.start) and (i == len(held) or held[i][0] >= s.end):
            held.insert(i, (s.start, s.end))
            kept.append(s)
    return kept


def vote(text: str, s: Span) -> tuple[int, ...]:
    """Base rule, form, gazetteer, words before, what it touches: 1 for, -1 against, 0 none."""
    own = text[s.start : s.end]
    digits = digits_of(own)
    turned_down = not s.base and (s.kind in ("ip", "card") or s.kind == "phone" and own[0] == "+")
    rule = 1 if s.base else -1 if turned_down else 0
    if s.kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", own)[-1].lower()
        form, listed = (1 if last.isalpha() and len(last) > 1 else -1), (1 if last in TOP_DOMAINS else -1)
    elif s.kind == "ip":
        parts = own.split(".")
        form = 1 if all(len(p) <= 3 and not (len(p) > 1 and p[0] == "0") for p in parts) else -1
        listed = -1 if parts[0] in ("0", "127", "255") or not s.base else 0
    elif s.kind == "card":
        form, listed = (1 if len(digits) <= 19 and luhn(digits) else -1), (1 if digits.startswith(CARD_ISSUERS) else -1)
    elif s.kind == "phone":
        form = 1 if 10 <= len(digits) <= 13 else -1
        listed = (1 if digits.startswith(COUNTRY_CODES) else -1) if own[0] == "+" else (1 if digits[0] not in "01" else -1)
    else:
        form = 1 if digits[3:5] != "00" and digits[5:] != "0000" else -1
        listed = -1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1
    words = re.findall(r"[a-z]+", text[max(0, s.start - 40) : s.start].lower())[-4:]
    context = 1 if any(w.startswith(CUES[s.kind]) for w in words) else -1 if any(w in AGAINST for w in words) else 0
    beside = text[max(0, s.start - 1) : s.start] + text[s.end : s.end + 1]
    touches = -1 if any(c.isalnum() or c in "_/=" for c in beside) else 1
    return rule, form, listed, context, touches


def features(text: str, s: Span) -> list[int]:
    """Places among the weights: the kind, its shape by three characters, its length, and the words around it."""
    own = text[s.start : s.end][:80]
    shape = "^" + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", own))) + "$"
    names = {f"{s.kind}", f"{s.kind}/n{len(own) // 2}", f"{s.kind}/d{len(digits_of(own))}"} | {f"{s.kind}/{shape[i : i + 3]}" for i in range(len(shape) - 2)}
    names |= {f"{s.kind}/b{w}" for w in re.findall(r"\w+", text[max(0, s.start - 30) : s.start].lower())[-2:]}
    names |= {f"{s.kind}/a{w}" for w in re.findall(r"\w+", text[s.end : s.end + 30].lower())[:1]}
    names |= {f"{s.kind}/l{text[s.start - 1 : s.start]!r}", f"{s.kind}/r{text[s.end : s.end + 1]!r}"}
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % WIDTH for n in names})


def scanned(text: str | None) -> list[Span]:
    found = candidates(text) if text else []
    for s in found:
        s.votes, s.features = vote(text, s), features(text, s)
    return found


@dataclass
class Model:
    reliability: dict[str, list]  # for each labeler the chance of each vote, of false and of true candidates
    weights: np.ndarray | None

    def chances(self, spans: list[Span]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(spans)
        return [float(1 / (1 + np.exp(-(self.weights[s.features].sum() + self.weights[-1])))) for s in spans]


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> tuple[dict[tuple, float], np.ndarray]:
    """Posterior of each (kind, votes), and P(vote | truth) by labeler, truth and vote, by expectation-maximisation from
    the majority of votes; labelers are independent given the truth, each kind has its own share of true candidates."""
    kinds = np.array([KINDS.index(k) for k, _, _ in patterns])
    votes = np.array([v for _, v, _ in patterns]) + 1
    n = np.array([c for _, _, c in patterns], float)
    truth = np.clip(0.5 + (votes - 1).sum(axis=1) / (2 * votes.shape[1]), 0.05, 0.95)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for j in range(votes.shape[1]):
            for y, weight in enumerate((1 - truth, truth)):
                counts = np.bincount(votes[:, j], n * weight, minlength=3) + 1
                table[j, y] = counts / counts.sum()
        prior = np.array([((n * truth)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        log = [np.log(p)[kinds] + sum(np.log(table[j, y, votes[:, j]]) for j in range(votes.shape[1])) for y, p in enumerate((1 - prior, prior))]
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return {(k, v): float(t) for (k, v, _), t in zip(patterns, truth, strict=True)}, table


def train(rows: list[list[int]], targets: np.ndarray, steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft targets by full-batch Adam; the last weight is the intercept."""
    index = np.array([i for r in rows for i in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[index], minlength=len(rows)) + w[-1], -30, 30)))
        error = (p - targets) / len(rows)
        gradient = np.append(np.bincount(index, error[owner], minlength=WIDTH), error.sum()) + l2 * w / len(rows)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def candidate_table(docs: DataFrame, spans: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and the candidates of each row's text as ``spans``; staged, so that texts are scanned
    once."""
    held_to_small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([[vars(s) for s in scanned(t.as_py())] for t in batch.column(0)], SPANS_TYPE)
            yield pa.record_batch([*batch.columns[1:], found], [*batch.schema.names[1:], spans])

    picked = docs.select(F.col("text").alias(unused(docs, "scanned")), *keep)
    schema = T.StructType([*picked.schema.fields[1:], *T.StructType.fromDDL(f"{spans} {SPAN}").fields])
    return staged(picked.mapInArrow(scan, schema), "pii-spans")


def fit(table: DataFrame, spans: str, max_spans: int = 20_000) -> Model:
    each = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(spans).alias("s"))
    counted = each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()  # at most kinds * 3**5 rows
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted)
    if not patterns:
        return Model({}, None)
    posterior, reliability = reliabilities(patterns)
    share = min(1.0, max_spans / sum(n for _, _, n in patterns))
    point = F.pmod(F.xxhash64("doc_id", "s.start", "s.kind"), F.lit(1 << 20)) / float(1 << 20)
    sample = each.filter(point < share).select("s.kind", "s.votes", "s.features").toArrow().to_pylist()  # about max_spans rows
    if not sample:
        return Model({"votes": reliability.tolist()}, None)
    sample.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    targets = np.array([posterior[r["kind"], tuple(r["votes"])] for r in sample])
    return Model({"votes": reliability.tolist()}, train([r["features"] for r in sample], targets))


def decided(spans: list[Span], model: Model, least: float) -> list[Span]:
    """The spans that count, by kind and then by start: base ones, and of accepted ones that overlap the likeliest, then the
    longest."""
    base, more = [s for s in spans if s.base], [s for s in spans if not s.base]
    chance = {id(s): p for s, p in zip(more, model.chances(more), strict=True) if p >= least}
    more = without_overlaps([s for s in more if id(s) in chance], base, lambda s: (-chance[id(s)], s.start - s.end, *by_place(s)))
    return sorted([*base, *more], key=lambda s: (KINDS.index(s.kind), s.start))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, least: float = 0.5, max_spans: int = 20_000) -> DataFrame:
    """doc_id, the number of base spans by kind, the digest of the base spans, all spans, and how many the method added."""
    table = candidate_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "spans", ["doc_id"])
    shipped = docs.sparkSession.sparkContext.broadcast(fit(table, "spans", max_spans))  # WIDTH weights

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                spans = [Span(**s) for s in found]
                base = [s for s in spans if s.base]
                kept = decided(spans, shipped.value, least)
                rows.append((*(sum(s.kind == k for s in base) for k in BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(kept), len(kept) - len(base)))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return table.mapInArrow(decide, DIGEST)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest names the
    whole stretch."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, least: float = 0.5, max_spans: int = 20_000) -> DataFrame:
    """The rows of ``docs`` with every span of their texts masked; n_chars, where there is such a column, follows."""
    spans = unused(docs, "spans")
    table = candidate_table(docs, spans, docs.columns)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(table, spans, max_spans))
    at, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(len(docs_columns)).to_pylist()):
                if found and (spans := decided([Span(**s) for s in found], shipped.value, least)):
                    texts[i] = masked(texts[i], spans)
            columns = batch.columns[: len(docs_columns)]
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts]).cast(columns[length].type)
            yield pa.record_batch(columns, docs_columns)

    docs_columns = docs.columns
    return table.mapInArrow(mask, docs.schema)
