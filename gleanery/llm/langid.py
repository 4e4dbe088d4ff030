"""Language identification, word first, with a fall-back to ever shorter character n-grams.

A word that the model knows scores its smoothed log frequency in each language. A word it doesn't know scores the
mean log frequency of its known n-grams of the longest order that has any, from four characters down to one. A text's
score is the sum over its words; the language with the largest sum is predicted.

The model is fitted on a bounded sample of labelled texts: at most about ``texts_per_language`` of each language, taken
by a hash of the key, so the sample does not depend on file order; rows without a key are taken by a hash of their text. Every word
and n-gram of these texts is known to the model. Prediction covers all rows and whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is everything when there is nothing to
learn from; texts without a known word or n-gram get the first language by name with score 1 / number of languages; ties
go to the first language by name; repeated rows are predicted once each; an empty table gives no rows; extra columns are
ignored. As a filter: where nothing can be learned, every text with a letter stays.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches

LONGEST = 4
SMOOTHING = 0.1
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # a row for each word: log frequency in each language
    grams: dict[str, int]
    gram_scores: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _scores(rows: pa.Table, languages: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Places of the keys, and a row of log frequencies for each. ``rows`` has key, lang, n."""
    keys = rows.column(0).combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    place = {key: i for i, key in enumerate(keys.dictionary.to_pylist())}
    counts = np.zeros((len(place), len(languages)), np.float32)
    column = {lang: i for i, lang in enumerate(languages)}
    counts[keys.indices.to_numpy(zero_copy_only=False), [column[x] for x in rows.column(1).to_pylist()]] = rows.column(2).to_numpy()
    return place, np.log((counts + SMOOTHING) / (totals + SMOOTHING * max(1, len(place)))).astype(np.float32)


def fit(labelled: DataFrame, texts_per_language: int = 2000) -> Model:
    """``labelled`` has doc_id, text, lang; rows without a text or language teach nothing."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    per_language = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per_language)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in per_language.items() for x in (lang, min(1.0, texts_per_language / n))])[F.col("lang")]
    point = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(point < share)
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = sample.select("lang", word).filter("word != ''").groupBy("word", "lang").agg(F.count("*").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    padded = F.concat(F.lit("^"), "word", F.lit("$"))

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))

    cuts = [cut(n) for n in range(1, LONGEST + 1)]
    # a padded word has at least three characters, so only the longest order can lack room
    cuts[-1] = F.when(F.length(padded) >= LONGEST, cuts[-1]).otherwise(F.array().cast("array<string>"))
    grams = counts.select("lang", "n", F.explode(F.concat(*cuts)).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n")).persist()
    # as many rows as the sample has words and n-grams
    word_rows, gram_rows = counts.select("word", "lang", "n").orderBy("word", "lang").toArrow(), grams.select("gram", "lang", "n").orderBy("gram", "lang").toArrow()
    gram_totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    counts.unpersist()
    grams.unpersist()
    words, word_scores = _scores(word_rows, languages, np.array([totals.get(x, 0) for x in languages], float))
    pieces, gram_scores = _scores(gram_rows, languages, np.array([gram_totals.get(x, 0) for x in languages], float))
    return Model(languages, words, word_scores, pieces, gram_scores)


def lettered(text: str | None) -> bool:
    return text is not None and any(any(map(str.isalpha, w.group())) for w in WORD.finditer(text))


class Scorer:
    """Scores words of one task; remembers at most ``limit`` unknown ones."""

    def __init__(self, model: Model, limit: int = 50_000):
        self.model, self.limit = model, limit
        self.memo: dict[str, np.ndarray] = {}
        self.nothing = np.zeros(len(model.languages))

    def unseen(self, word: str) -> np.ndarray:
        found = self.memo.get(word)
        if found is None:
            found = self.nothing
            for n in range(LONGEST, 0, -1):
                rows = [i for g in grams_of(word, n) if (i := self.model.grams.get(g)) is not None]
                if rows:
                    found = self.model.gram_scores[rows].mean(axis=0)
                    break
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[word] = found
        return found

    def text(self, text: str | None) -> tuple[str, float]:
        if not self.model.languages or not lettered(text):
            return UNKNOWN, 0.0
        words = Counter(WORD.findall(text.lower()))
        rows, times, total = [], [], self.nothing.copy()
        for word, n in words.items():
            row = self.model.words.get(word)
            if row is None:
                total += n * self.unseen(word)
            else:
                rows.append(row)
                times.append(n)
        if rows:
            total += np.array(times) @ self.model.word_scores[rows]
        best = int(total.argmax())
        return self.model.languages[best], 1.0 / math.fsum(np.exp(np.maximum(total - total[best], -700)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the prediction sees the text alone."""
    held_to_small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            found = [scorer.text(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(score, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled documents that are not held out, and predicts all."""
    return predict(docs, fit(docs.filter(~held_out(F.col("doc_id").cast("long")))))


def identified_only(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is identified: the text has letters and one learned language
    holds at least ``least_score`` of the probability. Where no text has a language to learn from, texts with letters stay."""
    held_to_small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out(F.col("doc_id").cast("long")))))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        stays = (lambda t: scorer.text(t)[1] >= least_score) if shipped.value.languages else lettered
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            yield batch.filter(pa.array([lettered(t) and stays(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
