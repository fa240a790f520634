"""Toxicity: cumulative-link ordinal regression on sparse words.

Severity grades are 0 to 3 and P(grade > k) = sigmoid(w . x - b_k) with one weight vector for all thresholds b_0 < b_1 < b_2. The
expected severity is the sum of the three probabilities. Features are hashed words (letters, digits and non-ASCII; A-Z in lower case)
that the text has, worth 1 + ln(count); weights are fitted by proximal gradient with an L1 penalty, which leaves most at zero.

The labels say toxic or not. A toxic training text is graded by how many words it has that mark toxic texts (smoothed log odds
over ``MARK`` and in ``RARE`` or more of them): the lower, middle and upper third are grades 1, 2 and 3.

Training takes at most ``SAMPLE`` labelled documents, half of either label, in order of their ids' hashes (of rows with one id all, up to
twice as many); only their feature counts come to the driver. Scoring covers every document by independent tasks, without a shuffle.

Edge cases: null texts and texts without a word have no features, and the severity that the thresholds alone give; labels without a document, null labels and null ids are left out, of several labels of an
id the largest counts; without labels every weight is zero and every severity near zero; repeated rows are scored alike; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontam import SEPARATES

BITS, SAMPLE, GRADES = 20, 8000, 3
MARK, RARE = 2.5, 4
_U = np.uint64


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word."""
    data = C.fold_ascii(data)
    starts, ends, first = C.word_spans(data, offsets, SEPARATES)
    feature = (C.span_hash(C.prefix_hash(data), starts, ends) >> _U(64 - BITS)).astype(np.int64)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), feature


def summed(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values."""
    keys, n = np.unique(row << BITS | feature, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), 1 + np.log(n)


@dataclass
class Ordinal:
    """Weights by feature and ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def grades(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of training texts."""
    size = 1 << BITS
    with_, without = np.bincount(feature[toxic[row]], minlength=size), np.bincount(feature[~toxic[row]], minlength=size)
    odds = np.log((with_ + 0.5) / (toxic.sum() + 1)) - np.log((without + 0.5) / ((~toxic).sum() + 1))
    marks = (odds > MARK) & (with_ >= RARE)
    count = np.bincount(row[marks[feature]], minlength=len(toxic))
    out = np.zeros(len(toxic), int)
    if toxic.any():
        low, high = np.quantile(count[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (count[toxic] > low) + (count[toxic] > high)
    return out


def likelihood(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -log P(grade), P(grade) = P(> grade - 1) - P(> grade), and its slopes by weights and thresholds."""
    n = len(grade)
    p = 1 / (1 + np.exp(b[None, :] - np.bincount(row, value * w[column], n)[:, None]))
    at = np.arange(n), grade
    upper, lower = np.concatenate([np.ones((n, 1)), p], 1)[at], np.concatenate([p, np.zeros((n, 1))], 1)[at]
    gap = np.maximum(upper - lower, 1e-12)
    score = -(1 - upper - lower) / n  # of log(upper - lower) by the score, for logistic links
    gb = np.array([((upper * (1 - upper) / gap) * (grade == k + 1) - (lower * (1 - lower) / gap) * (grade == k)).sum() for k in range(GRADES)]) / n
    return -float(np.log(gap).mean()), np.bincount(column, value * score[row], len(w)), gb


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, rounds: int = 300, penalty: float = 5e-4) -> Ordinal:
    """Penalised maximum likelihood of the cumulative logit model, by accelerated proximal gradient."""
    n = len(grade)
    if not n or not grade.any():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([6.0, 7.0, 8.0]))
    often = np.bincount(feature, minlength=1 << BITS) >= RARE
    keep = often[feature]
    row, value = row[keep], value[keep]
    used, column = np.unique(feature[keep], return_inverse=True)
    w, b = np.zeros(len(used)), np.log(np.array([(grade <= k).sum() + 1 for k in range(GRADES)]) / np.array([(grade > k).sum() + 1 for k in range(GRADES)]))
    z, zb, t = w.copy(), b.copy(), 1.0
    rate = 4.0 / max(1.0, float(np.median(np.bincount(row, value**2, n))))
    for _ in range(rounds):
        _, gw, gb = likelihood(row, column, value, grade, z, zb)
        new = z - rate * gw
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        gap = np.arange(GRADES) * 1e-3  # thresholds stay apart
        nb = np.maximum.accumulate(zb - rate * gb - gap) + gap
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_new * (new - w), nb + (t - 1) / t_new * (nb - b)
        w, b, t = new, nb, t_new
    live = np.flatnonzero(w)
    return Ordinal(used[live], w[live], np.maximum.accumulate(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = C.materialise(known.withColumn("h", F.xxhash64("doc_id")), "toxicity-labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # At most ``sample`` rows of two numbers.
    chosen = [known.where(condition).orderBy("h", "doc_id").limit(sample // 2) for condition in ("toxic > 0", "toxic <= 0")]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in C.text_chunks(batch.column(1)):
                row, feature = hashed_words(data, offsets)
                row, feature, value = summed(row, feature)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
                values = [value[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(lists, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "toxic", "features", "amounts"])

    rows = rows.join(picked, "doc_id").select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, features binary, amounts binary")
    got = [tuple(r) for r in rows.orderBy("doc_id", "features").limit(2 * sample).collect()]
    C.discard(known)
    features = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in got]
    row = np.repeat(np.arange(len(got)), [len(f) for f in features])
    feature = np.concatenate([*features, np.zeros(0, np.int64)])
    value = np.concatenate([*[np.frombuffer(r[3], "<f4").astype(float) for r in got], np.zeros(0)])
    return fit_ordinal(row, feature, value, grades(row, feature, np.array([r[1] > 0 for r in got], bool)))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), p1 to p3 (of at least that grade), grade (the last with p >= 1/2) and toxic of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.dense()
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for i, j, data, offsets in C.text_chunks(batch.column(1)):
                row, feature = hashed_words(data, offsets)
                live = weights[feature] != 0
                row, feature, value = summed(row[live], feature[live])
                total[i:j] = np.bincount(row, value * weights[feature], j - i)
            p = shared.value.probabilities(total)
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(GRADES)], pa.array(grade.astype(np.int32)), pa.array(grade > 0)], ["doc_id", "severity", "p1", "p2", "p3", "grade", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p1 double, p2 double, p3 double, grade int, toxic boolean")
