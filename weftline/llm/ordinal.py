"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - score). One weight vector over hashed text features is shared by all
grades and the thresholds are ordered, so the model gives an expected grade and the probability of every
tail. Features of a text: each distinct word (letters and digits only, lower-cased) counts once, and each
word shape (runs of upper case, lower case and digits folded to A, a, 9; other characters kept) counts by
its share of the words.

The model is fitted on a bounded sample of the rated rows (``sample``, smallest digests of the id);
scoring covers every row and reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000
BITS = 20
#: A feature must occur in so many sampled texts to get a weight.
LEAST_TEXTS = 12
SHAPE_SCALE = 8.0
REMEMBERED = 400_000

_LETTERS = re.compile(r"[\W_]+")
_FOLD = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "9"))


def _features(word: str) -> tuple[int, int]:
    """Hashed word (0: none) and hashed shape of one word."""
    shape = word
    for pattern, mark in _FOLD:
        shape = pattern.sub(mark, shape)
    plain = _LETTERS.sub("", word.lower())
    mask = (1 << BITS) - 1
    return (zlib.crc32(b"w" + plain.encode()) & mask) if plain else 0, zlib.crc32(b"s" + shape[:8].encode("utf-8", "replace")) & mask


class Hasher:
    """Features of texts, remembering those of words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of one text; no features without words."""
        known, counts = self.known, Counter((text or "").split())
        if not counts:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        if len(known) > REMEMBERED:
            known.clear()
        words, shapes = set(), {}
        for w, n in counts.items():
            f = known.get(w)
            if f is None:
                f = known[w] = _features(w)
            words.add(f[0])
            shapes[f[1]] = shapes.get(f[1], 0) + n
        words.discard(0)
        total = sum(counts.values())
        at = np.fromiter((*words, *shapes), np.int64, len(words) + len(shapes))
        value = np.ones(len(at), np.float32)
        value[len(words) :] = np.fromiter(shapes.values(), np.float32, len(shapes)) * (SHAPE_SCALE / total)
        return at, value


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature numbers with their weights, and ordered thresholds between the grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def column(self, text: Column) -> Column:
        """Score of each row's whole text."""
        features, weights = self.features, self.weights
        cell: dict[str, tuple[np.ndarray, Hasher]] = {}

        @F.arrow_udf("double")
        def score(batch: pa.Array) -> pa.Array:
            if not cell:
                dense = np.zeros(1 << BITS, np.float32)
                dense[features] = weights
                cell["it"] = (dense, Hasher())
            dense, hasher = cell["it"]
            return pa.array([float(dense[at] @ value) for at, value in (hasher(t.as_py()) for t in batch)], pa.float64())

        return score(text)

    def tail(self, score: Column, grade: int) -> Column:
        """P(rating >= grade), grade from 1."""
        return 1 / (1 + F.exp(F.lit(float(self.thresholds[grade - 1])) - score))

    def expected(self, score: Column) -> Column:
        """Mean of the grades under the model."""
        return sum((self.tail(score, g) for g in range(1, len(self.thresholds) + 1)), F.lit(0.0))


def fit_cumulative(at: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, grades: int, steps: int = 300, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood.

    ``at`` numbers features densely from 0; (row, at, value) are the entries of the design matrix. The
    thresholds are a first value plus positive steps, so they stay ordered.
    """
    n, m = len(grade), int(at.max()) + 1 if len(at) else 0
    w, t = np.zeros(m), np.zeros(grades - 1)
    t[0] = -1.0
    moments = [np.zeros(m + grades - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        s = np.bincount(row, value * w[at], n)
        theta = np.concatenate(([-np.inf], t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:])))), [np.inf]))
        with np.errstate(over="ignore"):
            upper, lower = (1 / (1 + np.exp(s - theta[grade + k])) for k in (1, 0))
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gs = (du - dl) / n  # of the negative log-likelihood by the score
        gw = np.bincount(at, value * gs[row], m) + ridge * w
        by_theta = np.bincount(grade + 1, -du, grades + 1) + np.bincount(grade, dl, grades + 1)
        inner = by_theta[1:grades] / n
        gt = np.array([inner[j:].sum() * (np.exp(t[j]) if j else 1.0) for j in range(grades - 1)])
        g = np.concatenate((gw, gt))
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:m], t - move[m:]
    return w, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """Model from ``ratings`` (doc_id, grade 0..grades-1) and the texts of ``docs``.

    At most ``sample`` rated ids (smallest MD5 of the id) are used; an id rated twice counts once, with its
    lowest grade, and rows with a null id or grade are ignored. Only hashed features of the sample reach
    the driver. Without rated texts every document gets the highest grade.
    """
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)

    @F.arrow_udf("struct<at:binary,value:binary>")
    def features(batch: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array([{"at": at.astype(np.int32).tobytes(), "value": v.tobytes()} for at, v in (hasher(t.as_py()) for t in batch)], pa.struct([("at", pa.binary()), ("value", pa.binary())]))

    # at most ``sample`` pairs of numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = texts.select("doc_id", F.col("grade").cast("int").alias("grade"), features("text").alias("f")).toArrow().sort_by("doc_id")  # sums in one order
    grade = got["grade"].to_numpy().astype(np.int64)
    parts = got["f"].combine_chunks()
    parts = parts.flatten() if isinstance(parts, pa.StructArray) else [pa.array([], pa.binary())] * 2
    ats = [np.frombuffer(x.as_py(), np.int32) for x in parts[0]]
    row = np.repeat(np.arange(len(ats)), [len(a) for a in ats])
    at = np.concatenate([*ats, np.empty(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*(np.frombuffer(x.as_py(), np.float32) for x in parts[1]), np.empty(0, np.float32)]).astype(np.float64)
    texts_with = np.bincount(at, minlength=1 << BITS)
    enough = texts_with[at] >= min(LEAST_TEXTS, max(1, len(ats) // 20))
    row, at, value = row[enough], at[enough], value[enough]
    if not len(at):
        return OrdinalModel(np.empty(0, np.int64), np.empty(0, np.float32), np.arange(1 - grades, 0) * 10.0)
    features_used, dense = np.unique(at, return_inverse=True)
    w, theta = fit_cumulative(dense, value, row, grade, grades)
    return OrdinalModel(features_used, w.astype(np.float32), theta)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two judgements: 0 poor text, 1 sound but toxic, 2 sound."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def rate(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade) and kept for every row of ``docs``.

    A null or empty text has no features and is judged by the thresholds alone. Repeated rows get the same
    answer. An empty table gives an empty table.
    """
    model = fit(docs, ratings, grades, sample)
    scored = docs.select("doc_id", model.column(F.col("text")).alias("_score"))
    tail = model.tail(F.col("_score"), grades - 1)
    return scored.select("doc_id", model.expected(F.col("_score")).alias("expected_grade"), tail.alias("tail_probability"), (tail >= least_tail).alias("kept"))


def select(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, least_tail: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose probability of the highest grade is at least ``least_tail``."""
    model = fit(docs, ratings, grades, sample)
    return docs.filter(model.tail(model.column(F.col("text")), grades - 1) >= least_tail)
