"""A quality classifier: ordinal cumulative-link regression on graded ratings.

The chance that a text's grade is at most k is sigmoid(threshold[k] - f(text)), with one weight for each hashed word, shared by
all grades, and ordered thresholds. It gives an expected grade and the tail probabilities, the chances of reaching each grade
above the lowest. A document is selected when its expected grade is at least ``least_grade`` and its chance of reaching the
first grade above the lowest at least ``least_tail``. Features are the
distinct words, the distinct runs of other signs, and how much of the text is upper case or signs. Only those weigh whose
mean grade departs from that of all by ``SCREEN`` standard errors, so that rare words of a few texts don't.

The model is fitted on a bounded sample of rated texts (``max_rated``, taken by a hash of the key); every document is scored
on its whole text.

Defined cases: a null or empty text has no words and the grade of a text without any; without rated
texts every document has the middle of the grades and is kept; ratings without a document teach nothing; repeated rows are
scored once each; a document rated more than once counts with its lowest grade; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_to_small_batches, word_hashes

WIDTH_BITS = 18
GRADES = 3
SCREEN, LEAST_TEXTS = 4.0, 5
LEAST_GRADE, LEAST_TAIL = 0.7, 0.7
SCHEMA = "doc_id long, expected_grade double, tail_probability double, top_probability double, floor_probability double, selected boolean"


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def rating_grades(labels: DataFrame) -> DataFrame:
    """Grade 0: toxic; 1: neither toxic nor good; 2: good and not toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def hashed_features(text: str = "text") -> Column:
    """The features of a text as distinct places among the weights."""
    whole = F.coalesce(F.col(text), F.lit(""))
    length = F.greatest(F.length(whole), F.lit(1))
    signs = F.filter(F.split(whole, r"[\p{L}\p{N}\s]+"), lambda x: x != "")
    share = lambda pattern, steps: F.floor(F.lit(steps) * F.length(F.regexp_replace(whole, pattern, "")) / length)
    marks = F.array(F.xxhash64(F.lit("upper"), share(r"[^\p{Lu}]", 10)), F.xxhash64(F.lit("signs"), share(r"[\p{L}\p{N}\s]", 20)))
    hashes = F.concat(word_hashes(F.col(text)), F.transform(F.array_distinct(signs), lambda x: F.xxhash64(F.lit("sign"), x)), marks)
    return F.array_distinct(F.transform(hashes, lambda h: F.pmod(h, F.lit(1 << WIDTH_BITS)).cast("int")))


def ordered(params: np.ndarray) -> np.ndarray:
    """Thresholds: the first as it is, each other the one before plus an exponential."""
    return params[0] + np.concatenate([[0], np.exp(params[1:]).cumsum()])


def loss(params: np.ndarray, rows: np.ndarray, index: np.ndarray, grades: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with an l2 penalty, and its gradient. ``params``: weights, then what ``ordered`` takes;
    feature ``index[j]`` belongs to text ``rows[j]``."""
    free, each = len(params) - GRADES + 1, np.arange(len(grades))
    weights, thresholds = params[:free], ordered(params[free:])
    f = np.bincount(rows, weights[index], minlength=len(grades))
    upto = np.hstack([np.zeros((len(f), 1)), sigmoid(thresholds[None, :] - f[:, None]), np.ones((len(f), 1))])
    chance = np.maximum(upto[each, grades + 1] - upto[each, grades], 1e-9)
    slope = upto * (1 - upto)  # of each cumulative chance by its argument
    high, low = slope[each, grades + 1] / chance, slope[each, grades] / chance
    by_f = (high - low) / len(f)
    by_threshold = np.array([(low[grades == k + 1].sum() - high[grades == k].sum()) / len(f) for k in range(GRADES - 1)])
    by_gap = np.array([by_threshold[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(params[free + 1 :])
    gradient = np.concatenate([np.bincount(index, by_f[rows], minlength=free) + l2 * weights, [by_threshold.sum()], by_gap])
    return -np.log(chance).mean() + l2 / 2 * (weights**2).sum(), gradient


def train(features: list[np.ndarray], grades: np.ndarray, l2: float = 1e-5, steps: int = 600, rate: float = 0.1) -> Model:
    """Full-batch Adam on the likelihood; thresholds stay ordered because each is the one before plus an exponential."""
    lengths = np.array([len(f) for f in features])
    index = np.concatenate(features) if len(features) else np.zeros(0, int)
    rows = np.repeat(np.arange(len(features)), lengths)
    n = np.bincount(index, minlength=1 << WIDTH_BITS)
    mean = np.bincount(index, grades[rows], minlength=1 << WIDTH_BITS) / np.maximum(n, 1)
    spread = grades.std() if len(grades) else 0.0
    telling = (n >= LEAST_TEXTS) & (np.abs(mean - (grades.mean() if len(grades) else 0)) * np.sqrt(n) >= SCREEN * max(spread, 1e-9))
    kept = np.flatnonzero(telling)  # only these weights are trained; all others stay 0
    rows = rows[telling[index]]
    index = np.searchsorted(kept, index[telling[index]])
    shares = np.bincount(grades, minlength=GRADES).cumsum()[:-1] / max(1, len(grades))
    first = np.log(np.clip(shares, 0.01, 0.99) / (1 - np.clip(shares, 0.01, 0.99)))
    params = np.concatenate([np.zeros(len(kept)), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v, free = np.zeros_like(params), np.zeros_like(params), len(kept)
    for step in range(1, steps + 1):
        _, gradient = loss(params, rows, index, grades, l2)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << WIDTH_BITS)
    weights[kept] = params[:free]
    return Model(weights, ordered(params[free:]))


def fit(docs: DataFrame, labels: DataFrame, max_rated: int = 12_000) -> Model:
    rated = rating_grades(labels)
    share = min(1.0, max_rated / max(1, rated.count()))
    point = F.pmod(F.xxhash64("doc_id", F.lit("rated")), F.lit(1 << 20)) / float(1 << 20)
    sample = rated.filter(point < share)  # about max_rated rows of two numbers
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = picked.select(hashed_features().alias("f"), "grade").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(1 << WIDTH_BITS), np.log([0.5, 2.0]))
    return train([f.values.to_numpy() if f.is_valid else np.zeros(0, int) for f in rows["f"]], rows["grade"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model, least_grade: float = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """expected_grade, tail_probability (of a grade above the lowest), top_probability, floor_probability, and selected: both
    the expected grade and the tail probability are high enough."""
    held_to_small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            words = batch.column(1)
            rows = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
            f = np.bincount(rows, own.weights[words.flatten().to_numpy()], minlength=len(words))
            reach = 1 - sigmoid(own.thresholds[None, :] - f[:, None])  # the chance of each grade above the lowest, or more
            expected, tail = reach.sum(axis=1), reach[:, 0]
            chosen = (expected >= least_grade) & (tail >= least_tail)
            columns = [batch.column(0), *map(pa.array, (expected, tail, reach[:, -1], 1 - tail, chosen))]
            yield pa.record_batch(columns, ["doc_id", "expected_grade", "tail_probability", "top_probability", "floor_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed_features().alias("f")).mapInArrow(rate, SCHEMA)


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
