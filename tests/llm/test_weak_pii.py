import hashlib
import math
import random
import re

from gleanery.llm import weak_pii

from .fixtures import awkward, documents

# the patterns of the contract, as they are
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if fits(k, m[0])]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def agrees(docs):
    texts = sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)
    rows = weak_pii.find_personal_data(docs).collect()
    want = sorted((d, hashlib.sha256(listed(base(t)).encode()).hexdigest(), *(sum(k == kind for k, _, _ in base(t)) for kind in PATTERNS)) for _, d, t in texts if d is not None)
    assert sorted((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows if r["doc_id"] is not None) == want
    assert len(rows) == len(texts)
    for r in rows:
        mine = [x for x in r["spans"].split(",") if x]
        assert len(mine) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
    return rows


def test_base_spans_of_random_texts(spark):
    r = random.Random(5)
    pieces = ["a.b", "@", "x", "mail1", ".", ".example", ".com", "1", "25", "256", "300", "+", " ", "(", ")", "-", "4111 1111 1111 1111", "5500-0000-0000-0004", "é", "\n", "12", "+1 (743) 555-3824", "..", "%", "john@x.org"]
    agrees(documents(spark, ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(600)]))


def test_awkward_and_given_documents(spark):
    agrees(awkward(spark))
    agrees(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert weak_pii.find_personal_data(documents(spark, [])).collect() == []


def test_long_runs_take_no_quadratic_time(spark):
    agrees(documents(spark, ["a" * 20_000, "1." * 20_000, "a@" * 20_000, "@" * 20_000, "+1" * 20_000]))
    assert weak_pii.candidates("9" * 400_000 + "a" * 400_000 + "1" * 400_000) == []


RUNS = ["ip 1.2.3." + "0" * 5000 + "1 end", "ip " + "9" * 6000 + ".1.1.1", "card " + "4" * 9000, "+" + "1" * 9000, "+1" + "(" * 9000 + "2", "1." * 9000, "1 2-" * 5000, "0.0.0.0" * 3000, "@" * 9000 + "a.b", "a@" + "b-" * 5000 + ".c" * 3000]


def test_runs_of_thousands_of_digits_and_signs(spark):
    for text in RUNS:
        weak_pii.scanned(text)
    assert [(s.kind, s.base) for s in weak_pii.candidates(RUNS[0])][0] == ("ip", True)
    r = random.Random(3)
    texts = RUNS + ["".join(r.choice("0123456789.-+() @ab") * r.choice([1, 1, 2, 3000]) for _ in range(12)) for _ in range(40)]
    docs = documents(spark, texts)
    assert weak_pii.find_personal_data(docs).count() == len(texts)
    kept = {x["doc_id"]: x["text"] for x in weak_pii.without_personal_data(docs).collect()}
    assert kept[0] == "ip <ip> end" and len(kept) == len(texts)


def test_overlaps_with_earlier_and_with_base_spans():
    span = lambda s, e, b=False: weak_pii.Span("phone", s, e, b)
    kept = weak_pii.without_overlaps([span(0, 5), span(4, 9), span(9, 12), span(30, 40), span(50, 55)], [span(11, 13, True), span(20, 100, True), span(25, 26, True)])
    assert [(s.start, s.end) for s in kept] == [(0, 5)]


def test_labelers_learn_to_add_and_to_leave(spark):
    r = random.Random(1)
    number = lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    texts = [f"please call me at {number()} today" for _ in range(200)] + [f"my phone is +1 {number()} now" for _ in range(200)]
    texts += [f"version {r.randrange(300, 999)}.{r.randrange(300, 999)}.{r.randrange(300, 999)}.{r.randrange(300, 999)} of order x{r.randrange(10**13, 10**14)}y" for _ in range(200)]
    rows = {x["doc_id"]: x for x in weak_pii.find_personal_data(documents(spark, texts)).collect()}
    assert sum(rows[i]["n_added"] for i in range(200)) >= 190
    assert sum(rows[i]["n_phone"] for i in range(200, 400)) == 200
    assert sum(rows[i]["n_added"] for i in range(400, 600)) == 0


def test_numbers_within_a_longer_candidate_are_found(spark):
    r = random.Random(6)
    digits = lambda n: "".join(str(r.randrange(2, 9)) for _ in range(n))
    phones, ids = [f"{digits(3)}-{digits(3)}-{digits(4)}" for _ in range(200)], [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(200)]
    texts = [f"Call {n}" + (" 2021" if i % 2 else " today") for i, n in enumerate(phones)] + [f"ssn {n}" + (" 1985" if i % 2 else " given") for i, n in enumerate(ids)]
    texts += [f"order {digits(14)} shipped" for _ in range(200)]
    docs = documents(spark, texts)
    spans = {x["doc_id"]: x["spans"] for x in weak_pii.find_personal_data(docs).collect()}
    assert sum(spans[i] == "phone:5:17" for i in range(200)) >= 195
    assert sum(spans[i] == "id:4:15" for i in range(200, 400)) >= 195
    assert not any(spans[i] for i in range(400, 600))
    masked = {x["doc_id"]: x["text"] for x in weak_pii.without_personal_data(docs).collect()}
    assert sum(n in masked[i] for i, n in enumerate(phones + ids)) <= 10


def test_of_accepted_overlaps_the_likeliest_stays():
    class Fixed(weak_pii.Model):
        def chances(self, spans):
            return [{"card": 0.6, "phone": 0.9, "id": 0.4}[s.kind] for s in spans]

    text = "Call 555-123-4567 2021, +1 (743) 555-3824"
    spans = weak_pii.candidates(text)
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("phone", "+1 (743) 555-3824"), ("card", "555-123-4567 2021"), ("phone", "555-123-4567")]
    kept = lambda least: [text[s.start : s.end] for s in weak_pii.decided(spans, Fixed({}, None), least)]
    assert kept(0.5) == kept(0.7) == ["555-123-4567", "+1 (743) 555-3824"] and kept(0.95) == ["+1 (743) 555-3824"]


def test_em_finds_the_labeler_that_errs():
    r = random.Random(3)
    counts = {}
    for _ in range(5000):
        truth = r.random() < 0.5
        votes = tuple((1 if truth ^ (r.random() > good) else -1) for good in (0.95, 0.9, 0.9, 0.5, 0.85))
        counts["email", votes] = counts.get(("email", votes), 0) + 1
    _, table = weak_pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert table[0, 1, 2] > 0.9 and abs(table[3, 1, 2] - 0.5) < 0.06


def test_masking(spark):
    docs = documents(spark, ["write to a.b@mail.example.com or +1 (743) 555-3824.", "nothing", None, ""])
    rows = sorted(weak_pii.without_personal_data(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == ["write to <email> or <phone>.", "nothing", None, ""]
    assert rows[0]["n_chars"] == len(rows[0]["text"]) and rows[0].asDict().keys() == set(docs.columns)


def plain_model(found):
    """Expectation-maximisation over single candidates, and logistic regression, with plain loops. ``found``: (kind, votes,
    features) of every candidate."""
    truth = [min(0.95, max(0.05, 0.5 + sum(v) / 10)) for _, v, _ in found]
    for _ in range(100):
        tables = []
        for j in range(5):
            by_truth = []
            for of in ([1 - t for t in truth], truth):
                counts = [1 + math.fsum(t for t, (_, v, _) in zip(of, found, strict=True) if v[j] == x) for x in (-1, 0, 1)]
                by_truth.append([c / sum(counts) for c in counts])
            tables.append(by_truth)
        prior = {}
        for kind in {k for k, _, _ in found}:
            own = [t for t, (k, _, _) in zip(truth, found, strict=True) if k == kind]
            prior[kind] = (sum(own) + 1) / (len(own) + 2)
        truth = []
        for kind, v, _ in found:
            no, yes = ((1 - prior[kind]), prior[kind])
            for j in range(5):
                no, yes = no * tables[j][0][v[j] + 1], yes * tables[j][1][v[j] + 1]
            truth.append(yes / (yes + no))
    size = weak_pii.WIDTH + 1
    w, m, s = [0.0] * size, [0.0] * size, [0.0] * size
    for step in range(1, 201):
        gradient = [0.001 * x / len(found) for x in w]
        for (_, _, f), t in zip(found, truth, strict=True):
            error = (1 / (1 + math.exp(-sum(w[i] for i in f) - w[-1])) - t) / len(found)
            for i in [*f, size - 1]:
                gradient[i] += error
        for i, g in enumerate(gradient):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            w[i] -= 0.1 * (m[i] / (1 - 0.9**step)) / (math.sqrt(s[i] / (1 - 0.999**step)) + 1e-9)
    return w


def test_added_spans_equal_a_plain_twin(spark):
    r = random.Random(9)
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    makers = [lambda: f"call {d(3)}-{d(3)}-{d(4)} now", lambda: f"order {d(3)}-{d(3)}-{d(4)}", lambda: f"ssn {d(3)}-{d(2)}-{d(4)}", lambda: f"version {d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"write joe{d(2)} (at) mail (dot) com", lambda: f"card {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"a{d(2)}@b{d(1)}.org", lambda: f"isbn {d(13)}", lambda: f"phone +{d(2)} {d(6)}", lambda: "plain words"]
    texts = [" and ".join(r.choice(makers)() for _ in range(r.randrange(4))) for _ in range(60)] + [None, ""]
    docs = documents(spark, texts)
    every = [(s.kind, s.votes, s.features) for t in texts for s in weak_pii.scanned(t)]
    w = plain_model(every)
    got = {x["doc_id"]: x for x in weak_pii.find_personal_data(docs).collect()}
    added = 0
    for i, text in enumerate(texts):
        spans = weak_pii.scanned(text)
        taken = [s for s in spans if s.base]
        likely = sorted(((-1 / (1 + math.exp(-sum(w[j] for j in s.features) - w[-1])), s.start - s.end, s.start, -s.end, weak_pii.KINDS.index(s.kind), k) for k, s in enumerate(spans) if not s.base))
        for minus, *_, k in likely:
            s = spans[k]
            if -minus >= 0.5 and all(s.end <= o.start or o.end <= s.start for o in taken):
                taken.append(s)
                added += 1
        want = sorted(((s.kind, s.start, s.end) for s in taken), key=lambda s: (weak_pii.KINDS.index(s[0]), s[1]))
        assert got[i]["spans"] == listed(want), text
    assert added > 10


def test_masked_rows_of_an_empty_table_and_of_clashing_columns(spark):
    docs = documents(spark, ["mail a@b.org", None, "nothing"]).withColumnRenamed("ids", "spans").withColumnRenamed("key", "scanned")
    out = weak_pii.without_personal_data(docs)
    assert out.schema == docs.schema and weak_pii.without_personal_data(docs.limit(0)).collect() == []
    assert {r["doc_id"]: (r["text"], r["spans"], r["n_chars"]) for r in out.collect()} == {0: ("mail <email>", "x", 12), 1: (None, "x", None), 2: ("nothing", "x", 7)}
