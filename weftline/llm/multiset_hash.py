"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector; the
fingerprint of a text is the sum of its paragraphs' vectors, so it doesn't depend on their order, and
paragraphs can be added to or taken from a fingerprint without the text. A vector has two parts:

* 4 lanes modulo 2^64, a digest of the whole paragraph: equal sums mean equal multisets;
* 128 lanes modulo 2^16, in which every word triple of the paragraph adds +1 or -1 to one lane. Squared
  lengths of such sums estimate numbers of triples, so the length of a difference tells how much two texts
  share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE, LANES = 4, 128
REMEMBERED = 500_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


class Fingerprint:
    """Sum of paragraph vectors."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray) -> None:
        self.wide, self.lanes = wide, lanes

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.lanes - other.lanes)

    def hex(self) -> str:
        return self.wide.astype(">u8").tobytes().hex() + self.lanes.astype(">u2").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], ">u2").astype(np.uint16))


class Hasher:
    """Fingerprints of texts, remembering the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> Fingerprint:
        known, wide, stream = self.known, 0, []
        if len(known) > REMEMBERED:
            known.clear()
        lanes = [0] * WIDE
        for paragraph in text.split("\n"):
            digest = hashlib.blake2b(paragraph.encode("utf-8", "replace"), digest_size=8 * WIDE).digest()
            for k in range(WIDE):
                lanes[k] += int.from_bytes(digest[8 * k : 8 * k + 8], "big")
            words = paragraph.split()
            try:
                stream += [known[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) | 1
                stream += [known[w] for w in words]
            stream += (0, 0)  # triples end with their paragraph
        wide = np.array([x & 0xFFFFFFFFFFFFFFFF for x in lanes], np.uint64)
        h = np.array(stream, np.uint64)
        x = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
        x = (x[h[:-2] != 0]) * _MIX[3]
        x = ((x ^ (x >> np.uint64(31))) * _MIX[0]) >> np.uint64(56)
        counts = np.bincount(x.astype(np.int64), minlength=2 * LANES)
        return Fingerprint(wide, (counts[:LANES] - counts[LANES:]).astype(np.uint16))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal multisets; else near the share of word triples that two texts have in common, in [0, 1]."""
    if (a.wide == b.wide).all():
        return 1.0
    x, y, d = ((v.view(np.int16).astype(np.float64) ** 2).sum() for v in (a.lanes, b.lanes, a.lanes - b.lanes))
    return float(min(1.0, max(0.0, 1 - d / (x + y)))) if x + y else 0.0


def edit(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out in ranges of doc_id: (_b range, _over, doc_id, text), sorted; a row with _over is the next range's first.

    The bounds are ids of the table (one pass over the ids alone), so a range's first id is its bound and
    is sent to the range before as well; the first of all goes to the last range. Null ids come first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    marks = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], max(10_000, 20 * ranges)).alias("q"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    bounds = np.array(sorted({*(marks["q"] or []), *([] if marks["least"] is None else [marks["least"]])}), np.int64)
    first = 0 if marks["nulls"] else 1
    last = len(bounds)

    @F.arrow_udf("array<int>")
    def ranged(ids: pa.Array) -> pa.Array:
        v, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        own = np.where(null, 0, np.searchsorted(bounds, v, "right"))
        opens = null.copy()
        if len(bounds):
            opens |= ~null & (bounds[np.maximum(own - 1, 0)] == v)
        before = np.where(own == first, last, own - 1)
        return pa.array([[2 * o, 2 * b + 1] if x else [2 * o] for o, b, x in zip(own.tolist(), before.tolist(), opens.tolist())], pa.list_(pa.int32()))

    rows = docs.select("doc_id", "text", F.explode(ranged("doc_id")).alias("_r"))
    rows = rows.select(F.expr("_r div 2").alias("_b"), (F.col("_r") % 2).alias("_over"), "doc_id", "text")
    return rows.repartition(parts, "_b").sortWithinPartitions("_b", "_over", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is that of the next larger doc_id (after the last: the first; a single document is
    its own next). A null text counts as empty; null ids come first; rows of one id follow their text.
    The text is moved once, to its range of ids, and rows are read as a stream.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), None
        for b in batches:
            out = [[] for _ in names]
            for part, over, doc_id, text in zip(*(b.column(k) for k in range(4))):
                part, over, text = part.as_py(), over.as_py(), text.as_py() or ""
                if held is None or held[0] != part:
                    if over:
                        continue
                    mark = hasher(text)
                else:
                    mark = hasher(text)
                    _, prior, prior_text, prior_mark = held
                    edited = edit(prior_text, text)
                    changed = hasher(edited)
                    row = (prior, len(prior_text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), prior_mark.hex(), changed.hex(), likeness(prior_mark, changed), likeness(prior_mark, mark))
                    for col, v in zip(out, row):
                        col.append(v)
                held = None if over else (part, doc_id.as_py(), text, mark)
            types = [b.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
