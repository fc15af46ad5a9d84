"""Language detection with letter profiles learned from labelled texts.

A profile holds a language's most frequent letter triples (words in lower case between blanks; a triple with a
blank in its middle counts for nothing). A text goes to the language whose profile makes its triples likeliest;
triples outside a profile cost what an unseen one would. Weights are whole thousandths of a logarithm, so scores
are exact sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: triples in a profile; it bounds what is sent to the tasks
TOP = 1000

_LETTERS = re.compile(r"[^\W\d_]+").findall


def _lined(text: str | None) -> str:
    """Words of a text in lower case, between single blanks."""
    return f" {' '.join(_LETTERS((text or '').lower()))} "


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, triple) of all triples of lined texts; a triple's code holds 21 bits of each letter."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = (owner[2:] == owner[:-2]) & (flat[1:-1] != 32)
    return owner[2:][whole], (flat[:-2] << 42 | flat[1:-1] << 21 | flat[2:])[whole]


def triple_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, triple, n), counted in the batches before the shuffle. Rows without a language are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                by.setdefault(name, []).append(_lined(t.as_py()))
            for name, texts in by.items():
                found: Counter = Counter()
                for lo in range(0, len(texts), 256):
                    values, n = np.unique(_codes(texts[lo : lo + 256])[1], return_counts=True)
                    found.update(dict(zip(values.tolist(), n.tolist())))
                triples = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(triples), pa.string()), pa.array(triples, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "triple", "n"])

    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, triple string, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def language_profiles(df: DataFrame, text: str, lang: str, top: int = TOP) -> DataFrame:
    """lang, triple (null: any other), weight: the ``top`` most frequent triples of each language."""
    counts = triple_counts(df, text, lang)
    total = counts.groupBy("lang").agg((F.sum("n") + F.count(F.lit(1))).cast("double").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "triple"))
    best = counts.withColumn("_r", rank).filter(F.col("_r") <= top).join(F.broadcast(total), "lang")  # a row per language
    weight = lambda n: F.floor(1000 * F.log(n / F.col("total"))).cast("long").alias("weight")
    return best.select("lang", "triple", weight(F.col("n") + 1)).unionByName(total.select("lang", F.lit(None).cast("string").alias("triple"), weight(F.lit(1.0))))


@dataclass(frozen=True)
class _Profiles:
    langs: tuple[str, ...]
    triples: np.ndarray
    weights: np.ndarray
    other: np.ndarray

    def best(self, texts: list[str]) -> list[str | None]:
        owner, code = _codes(texts)
        n = np.bincount(owner, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.triples, code), len(self.triples) - 1)
        hit = np.flatnonzero(self.triples[at] == code)
        score = n[:, None] * self.other
        np.add.at(score, owner[hit], self.weights[at[hit]] - self.other)
        first = score.argmax(1)
        return [self.langs[i] if k else None for i, k in zip(first.tolist(), n.tolist())]


def learned_detector(profiles: DataFrame) -> Callable[[Column | str], Column]:
    """A detector for ``filters.filter_language``: the likeliest language of a text, null without a letter (ties: first by code).

    The profiles come to the driver: ``TOP`` rows and one for each language.
    """
    rows = sorted((r["lang"], r["triple"] or "", r["weight"]) for r in profiles.collect())
    langs = tuple(sorted({r[0] for r in rows}))
    other = np.array([next(w for x, t, w in rows if x == lang and not t) for lang in langs], np.int64)
    code = lambda t: ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])
    triples = np.unique(np.array([code(t) for _, t, _ in rows if t], np.int64))
    weights = np.tile(other, (max(len(triples), 1), 1))
    for lang, t, w in rows:
        if t:
            weights[np.searchsorted(triples, code(t)), langs.index(lang)] = w
    known = _Profiles(langs, triples if len(triples) else np.array([-1]), weights, other)

    @F.arrow_udf("string")
    def detect(batch: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for lo in range(0, len(batch), 256):
            out += known.best([_lined(t.as_py()) for t in batch[lo : lo + 256]]) if langs else [None] * len(batch[lo : lo + 256])
        return pa.array(out, pa.string())

    return lambda c: detect(F.col(c) if isinstance(c, str) else c)
