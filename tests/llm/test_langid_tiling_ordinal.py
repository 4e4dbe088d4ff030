import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import langid, ordinal, tiling

from .fixtures import awkward, documents

GIVEN = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right, total = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 150 and right >= 0.95 * total


def test_language_of_awkward_rows(spark):
    rows = {(r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.identify(awkward(spark)).collect()}
    assert {(0, "und", True), (1, "und", True), (4, "en", True), (None, "en", True)} <= rows
    assert langid.identify(documents(spark, [])).collect() == []
    only = langid.identify(documents(spark, ["12 345", "... !", "word"])).collect()
    assert [r["lang_pred"] for r in sorted(only, key=lambda r: r["doc_id"])][:2] == ["und", "und"]


def test_unseen_words_back_off_to_grams(spark):
    texts = ["schön grün müde blöd", "ville belle femme elle"] * 30
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("fr"))
    scorer = langid.Scorer(langid.fit(docs))
    assert scorer.text("schönes")[0] == "de" and scorer.text("belles")[0] == "fr"


def test_identified_only_keeps_rows_as_they_are(spark):
    docs = awkward(spark)
    kept = langid.identified_only(docs)
    assert kept.columns == docs.columns and {0, 1}.isdisjoint(r["doc_id"] for r in kept.collect())


def brute_tiles(doc, item, n):
    """Longest first over unmarked words, by trying every pair of places."""
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while q + k < len(item) and p + k < len(doc) and doc_free[p + k] and item_free[q + k] and doc[p + k] == item[q + k]:
                    k += 1
                if k > best[2]:
                    best = (p, q, k)
        if best[2] < n:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            doc_free[best[0] + k] = item_free[best[1] + k] = False


def test_tiles_are_those_of_trying_every_pair():
    r = random.Random(0)
    for _ in range(200):
        item = [r.randrange(6) for _ in range(r.randrange(5, 25))]
        doc = [r.randrange(6) for _ in range(20)] + item[10:] + [r.randrange(6) for _ in range(3)] + item[:10] + item[2:9]
        a, b = np.array(doc, np.int64), np.array(item, np.int64)
        own = tiling.Benchmark.of([(1, b)])
        assert own.tiles(a, 0, list(range(len(doc) - 4))) == brute_tiles(doc, item, 5)


def test_long_runs_of_one_word_cost_little_and_tile_alike():
    r = random.Random(1)
    for _ in range(60):
        item = [r.randrange(2) for _ in range(6)] + [1] * r.randrange(5, 12) + [r.randrange(2) for _ in range(4)]
        doc = [r.randrange(2) for _ in range(5)] + [1] * 150 + item[:8] + [0] * 120 + item[3:]
        own = tiling.Benchmark.of([(1, np.array(item, np.int64))])
        assert own.tiles(np.array(doc, np.int64), 0, list(range(len(doc) - 4))) == brute_tiles(doc, item, 5)
    own = tiling.Benchmark.of([(1, np.ones(200, np.int64))])
    assert own.tiles(np.ones(100_000, np.int64), 0, list(range(99_996))) == [(0, 0, 200)]


def test_repeated_words_and_phrases_on_both_paths(spark):
    item, phrase = "same " * 2000, "one two three four five six seven "
    docs = documents(spark, ["same " * 20_000, phrase * 3000, f"{phrase * 40} other words {phrase * 20}", "same", None])
    bench = spark.createDataFrame([(1, item), (2, phrase * 300), (3, phrase * 55), (4, "same")], "item_id long, text string")
    found = [sorted(map(tuple, tiling.contaminated(docs, bench, broadcast_words=most).collect())) for most in (tiling.BROADCAST_WORDS, 10)]
    assert found[0] == found[1]
    assert [(d, i, round(c, 3)) for d, i, c, *_ in found[0]] == [(0, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)]


def test_a_seed_that_most_documents_hold(spark):
    r = random.Random(9)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    common = "now all of this is known".split()
    items = [(i, " ".join(prose(9) + common + prose(9))) for i in range(30)]
    texts = [" ".join(prose(20) + common + prose(5)) for _ in range(400)] + [" ".join(prose(3)) + " " + t for _, t in items]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, tiling.contaminated(docs, bench, broadcast_words=most).collect())) for most in (tiling.BROADCAST_WORDS, 10)]
    assert found[0] == found[1] == brute_contaminated(list(enumerate(texts)), items, 0.6) and len(found[0]) == 30


def brute_contaminated(docs, items, threshold):
    out = []
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    for doc_id, text in docs:
        for item_id, item in items:
            d, i = words(text), words(item)
            if not i or not d:
                continue
            if len(i) < 5:
                tiles = [(0, 0, len(i))] if d == i else []
            else:
                tiles = brute_tiles(d, i, 5)
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * len(i):
                out.append((doc_id, item_id, covered / len(i), len(tiles), tiles[0][2], len(i)))
    return sorted(out, key=repr)


def test_query_equals_tiling_every_document_against_every_item(spark):
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(12)}" for _ in range(n)]
    items = [(i, " ".join(prose(r.randrange(1, 16)))) for i in range(12)] + [(None, "w1 w2 w3 w4 w5 w6"), (3, None), (4, "?!")]
    docs = []
    for i in range(40):
        parts = [prose(r.randrange(1, 30)), *(t.split()[r.randrange(3) :] for _, t in r.sample(items[:13], 2))]
        docs.append((i % 9 or None, " ".join(sum(r.sample(parts, 3), []))))
    docs += [(50, items[0][1]), (51, " ".join(items[1][1].split()[:3])), (52, None), (53, ""), (54, "w1 w2"), docs[3], docs[3]]
    docs += [(55 + i, t) for i, (_, t) in enumerate(items[:12])]
    frame = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(docs, items, 0.6)
    assert len(want) > 20 and any(w[5] < 5 for w in want)
    for most in (tiling.BROADCAST_WORDS, 0):  # sent to the tasks, and joined by seeds
        assert sorted(map(tuple, tiling.contaminated(frame, bench, broadcast_words=most).collect()), key=repr) == want
        kept = tiling.decontaminated(frame, bench, broadcast_words=most)
        dirty = {t for i, t in docs if any(w[0] == i for w in want) and brute_contaminated([(i, t)], items, 0.6)}
        assert kept.schema == frame.schema
        assert sorted((str((x["doc_id"], x["text"])) for x in kept.collect())) == sorted(str((i, t)) for i, t in docs if t not in dirty)


def test_one_short_answer_takes_no_other_document(spark):
    docs = documents(spark, ["yes", "Yes!", "yes, of course it is so", "no"])
    bench = spark.createDataFrame([(1, "yes")], "item_id long, text string")
    for most in (1000, 0):
        assert sorted(x["doc_id"] for x in tiling.contaminated(docs, bench, broadcast_words=most).collect()) == [0, 1]


def test_reordered_passages_are_caught_and_clean_documents_left(spark):
    r = random.Random(2)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    item = prose(40)
    texts = [prose(100) + item + prose(50), prose(30) + item[20:] + prose(30) + item[:20], prose(30) + item[:12] + prose(30), prose(200)]
    docs = documents(spark, [" ".join(t) for t in texts] + [None, "", " ".join(texts[0])], [0, 1, 2, 3, 4, 5, 0])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "two words"), (7, " ".join(item))], "item_id long, text string")
    got = [(x["doc_id"], x["item_id"], x["coverage"]) for x in tiling.contaminated(docs, bench).collect()]
    assert sorted(got) == [(0, 7, 1.0)] * 4 + [(1, 7, 1.0)] * 2
    assert sorted(tiling.contaminated(docs, bench, broadcast_words=10).collect()) == sorted(tiling.contaminated(docs, bench).collect())
    kept = tiling.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4, 5]
    assert tiling.contaminated(docs, bench.limit(0)).collect() == [] and tiling.contaminated(docs.limit(0), bench).collect() == []


def test_a_contaminated_row_takes_no_clean_row_of_its_id(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    first, second = prose(30), prose(30)
    texts = [prose(20) + " " + first, prose(50), None, prose(50), prose(20) + " " + second, second, prose(50), prose(50)]
    docs = documents(spark, texts, [None, None, None, 7, 7, None, 7, 8])
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    for most in (1_000_000, 30):
        kept = tiling.decontaminated(docs, bench, broadcast_words=most)
        assert kept.schema == docs.schema
        assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=repr) == sorted(zip([None, None, 7, 7, 8], [texts[i] for i in (1, 2, 3, 6, 7)], strict=True), key=repr)
    assert tiling.decontaminated(docs, bench.limit(0)).count() == len(texts)


def test_toxic_documents_get_the_lowest_grade(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.filter(F.col("doc_id") % 3 != 0)
    got = ordinal.grade_documents(docs, learn).join(labels.filter(F.col("doc_id") % 3 == 0), "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(not r["selected"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["selected"] for r in clean) >= 0.98 * len(clean)


def test_grades_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 1, 0), (5, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = ordinal.grade_documents(docs, given).collect()
        assert len(got) == docs.count() and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got)
    assert ordinal.grade_documents(docs.limit(0), labels).collect() == []


def test_thresholds_are_ordered_and_grades_follow_the_words():
    r = random.Random(4)
    grades = np.array([r.randrange(3) for _ in range(600)])
    model = ordinal.train([np.array(sorted({10 + int(g), 20 + r.randrange(50)})) for g in grades], grades)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[10] < model.weights[11] < model.weights[12]


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(3)
    grades, rows, index = r.integers(0, 3, 40), r.integers(0, 40, 200), r.integers(0, 15, 200)
    params = np.concatenate([r.normal(size=15), [-0.5, 0.3]])
    value, gradient = ordinal.loss(params, rows, index, grades, 0.01)
    for i in range(len(params)):
        step = np.zeros_like(params)
        step[i] = 1e-6
        up, down = (ordinal.loss(params + x, rows, index, grades, 0.01)[0] for x in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-6
    # the loss itself, written out
    thresholds = ordinal.ordered(params[15:])
    total = 0.0
    for i, g in enumerate(grades):
        f = sum(params[j] for k, j in zip(rows, index, strict=True) if k == i)
        upto = [0.0, *(1 / (1 + math.exp(f - t)) for t in thresholds), 1.0]
        total -= math.log(upto[g + 1] - upto[g])
    assert abs(total / 40 + 0.005 * (params[:15] ** 2).sum() - value) < 1e-9


def test_scores_and_selection_by_hand(spark):
    weights = np.zeros(1 << ordinal.WIDTH_BITS)
    docs = documents(spark, ["good fine", "bad awful", "plain", None, ""])
    places = {w: r["f"] for w, r in zip(["good", "bad"], documents(spark, ["good", "bad"]).select(ordinal.hashed_features().alias("f")).collect(), strict=True)}
    common = set(places["good"]) & set(places["bad"])
    weights[[i for i in places["good"] if i not in common]] = 3.0
    weights[[i for i in places["bad"] if i not in common]] = -3.0
    got = {r["doc_id"]: r for r in ordinal.score(docs, ordinal.Model(weights, np.array([-1.0, 1.0]))).collect()}
    for i, f in ((0, 3.0), (1, -3.0), (2, 0.0), (3, 0.0), (4, 0.0)):
        reach = [1 - 1 / (1 + math.exp(f - t)) for t in (-1.0, 1.0)]
        assert abs(got[i]["expected_grade"] - sum(reach)) < 1e-9 and abs(got[i]["tail_probability"] - reach[0]) < 1e-9
        assert abs(got[i]["top_probability"] - reach[1]) < 1e-9 and got[i]["selected"] == (sum(reach) >= 0.7 and reach[0] >= 0.7)


def brute_language(docs, text):
    """Word-first back-off with plain counters over all texts."""
    words = {lang: Counter() for lang in sorted({x for _, x in docs})}
    for lang in words:
        for t, x in docs:
            if x == lang:
                words[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
    grams = {lang: Counter() for lang in words}
    for lang, found in words.items():
        for w, n in found.items():
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams[lang][f"^{w}$"[i : i + k]] += n
    logs = []
    for of in (words, grams):
        keys = {k for c in of.values() for k in c}
        logs.append({k: np.array([math.log((c[k] + 0.1) / (sum(c.values()) + 0.1 * len(keys))) for c in of.values()]) for k in keys})
    total = np.zeros(len(words))
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in logs[0]:
            total += logs[0][w]
            continue
        for k in range(4, 0, -1):
            rows = [logs[1][g] for i in range(len(w) + 3 - k) if (g := f"^{w}$"[i : i + k]) in logs[1]]
            if rows:
                total += np.mean(rows, axis=0)
                break
    best = int(total.argmax())
    return list(words)[best], 1 / np.exp(total - total[best]).sum()


def test_language_scores_equal_plain_counting(spark):
    r = random.Random(6)
    stems = {"de": ["schön", "grün", "müde", "straße", "haus"], "fr": ["ville", "belle", "femme", "être", "maison"], "en": ["town", "nice", "woman", "being", "house"]}
    prose = lambda lang: " ".join(r.choice(stems[lang]) + r.choice(["", "", "s", "en", "x"]) for _ in range(r.randrange(1, 12)))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(r.choice(list(stems)) for _ in range(120))] + [(500, "zzz qqq", None), (501, "ville house maisonette", None), (502, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    got = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    for i, t, _ in rows[:-1]:
        lang, score = brute_language(learn, t)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9, t
    assert got[502]["lang_pred"] == "und"


def letters(i):
    """A word of its own for each number."""
    out = ""
    while i:
        i, r = divmod(i, 26)
        out += chr(97 + r)
    return out + "q"


def test_every_word_of_the_sample_is_known(spark):
    words = {"en": [letters(i) for i in range(1, 50_000)], "de": [letters(i) + "u" for i in range(1, 45_000)]}
    rows = [(k, " ".join(ws[k::40]), lang) for lang, ws in words.items() for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.words) == {w for ws in words.values() for w in ws} and len(model.words) > 90_000
    totals = np.array([len(words[x]) for x in model.languages])
    for lang, ws in words.items():
        for w in ws[:: 9_973]:
            n = np.array([w in set(words[x]) for x in model.languages], float)
            want = np.log((n + langid.SMOOTHING) / (totals + langid.SMOOTHING * len(model.words)))
            assert np.allclose(model.word_scores[model.words[w]], want, atol=1e-5)
            assert model.languages[int(model.word_scores[model.words[w]].argmax())] == lang


def test_rows_without_an_id_are_sampled_by_their_text(spark):
    rows = [(None, f"word{letters(i)} here", "en") for i in range(1, 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, texts_per_language=400)
    assert 250 < len(model.words) < 600


def test_without_anything_to_learn_texts_with_letters_stay(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["text"] for r in langid.identified_only(docs).collect()) == sorted(r["text"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    assert langid.identified_only(docs.limit(0)).collect() == []
