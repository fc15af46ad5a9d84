"""SimHash near-duplicates by anchor-point covering.

Equal fingerprints are merged first, so groups of copies cost one row. The 64 bits are cut into a block
of 23, another of 23 and one of 18 bits. If two fingerprints differ in at most 4 bits, they differ in at
most 1 bit of the first block, or at most 1 of the second, or in none of the third (2 + 2 + 1 > 4). In a
23-bit block the anchors are the 4096 words of the binary Golay code, a perfect covering code of radius 3:
every block value has one anchor within 3, its home. A fingerprint goes to all anchors within
3 + 1 = 4 of its block, so it meets each partner at the partner's home. In the last block every value is
its own anchor (radius 0, threshold 0). Fingerprints of an anchor are compared home against visitors, and
only a spanning forest of the links found leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage
from weftline.llm.components import components

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Golay code: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 and its radius (fixed values).
GOLAY, RADIUS = 0b101011100011, 3
#: (first bit, bits, threshold) of the blocks; the thresholds + 1 sum to more than THRESHOLD.
BLOCKS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: An anchor with more fingerprints is cut into slices that are compared pair by pair in tasks of their own.
SLICE = 4096

_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, with ASCII letters in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_UPPER).split()  # at the six ASCII white-space bytes


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a text (null or no word: 0)."""
    words = ascii_words(text)
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) > SHINGLE:
        starts, stops = [0, *(ends[: -SHINGLE] + 1).tolist()], ends[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], ">u8")
    else:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):  # bounded memory for texts of any length
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of every 23-bit value, and the code words."""
    code = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(code)
    for k in range(12):
        words ^= np.where(code >> k & 1, GOLAY << k, 0)
    home = np.full(1 << 23, -1, np.int32)
    bits = 1 << np.arange(23)
    errors = [0, *bits, *(a ^ b for i, a in enumerate(bits) for b in bits[:i]), *(a ^ b ^ c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for e in errors:
        home[words ^ e] = np.arange(1 << 12)
    return home, words


def anchor_homes() -> np.ndarray:
    """The anchor (number of a code word) within the covering radius of every 23-bit value."""
    return _golay()[0]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor number, is home) of every anchor that each fingerprint (int64) goes to."""
    home, words = _golay()
    rows, keys, homes = [], [], []
    every = np.arange(len(fp))
    for b, (first, bits, near) in enumerate(BLOCKS):
        value = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        if not near:
            rows.append(every), keys.append(value), homes.append(np.ones(len(fp), bool))
        else:
            # an anchor within radius + 1 is the home of the value or of one of its bits' flips
            own = home[value]
            flips = home[value[:, None] ^ (1 << np.arange(bits))]
            both = np.sort(np.concatenate((own[:, None], flips), 1), 1)
            new = np.concatenate((np.ones((len(fp), 1), bool), both[:, 1:] != both[:, :-1]), 1)
            r, c = np.nonzero(new)
            rows.append(r), keys.append(both[r, c].astype(np.int64)), homes.append(both[r, c] == own[r])
        keys[-1] = keys[-1] * 4 + b
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _forest(fp: np.ndarray, at_home: np.ndarray, visiting: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links between home fingerprints and visitors of one anchor."""
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    guests = fp[visiting]
    step = max(1, (1 << 21) // max(1, len(guests)))
    for lo in range(0, len(at_home), step):
        part = at_home[lo : lo + step]
        a, b = np.nonzero(np.bitwise_count((fp[part][:, None] ^ guests).view(np.uint64)) <= limit)
        for i, j in zip(part[a].tolist(), visiting[b].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                yield i, j


def links(fingerprints: DataFrame, limit: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long), enough to connect what is linked.

    Every two fingerprints within ``limit`` (at most 4) bits are joined by a path of links.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for lo in range(0, len(fp), 4096):
                part = fp[lo : lo + 4096]
                r, k, h = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r]), pa.array(h)], names=["anchor", "fp", "home"])

    covered = fingerprints.select("fp").mapInArrow(place, "anchor long, fp long, home boolean")
    counts = covered.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(counts.filter(F.col("n") > SLICE).select("anchor", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))
    spread = covered.join(hot, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("slices").cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1))
    # a home slice meets every visitor slice; an anchor that isn't hot has one of each
    homes = spread.filter("home").select("anchor", own.alias("i"), every.alias("j"), "fp", F.lit(True).alias("home"))
    guests = spread.select("anchor", every.alias("i"), own.alias("j"), "fp", F.lit(False).alias("home"))
    cells = homes.union(guests)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fp, home in _whole_cells(batches):
            edge = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1)))
            stop = np.append(edge[1:], len(fp))
            # most cells hold one fingerprint, at home and as its own visitor
            busy = (np.minimum.reduceat(fp, edge) != np.maximum.reduceat(fp, edge)) & np.logical_or.reduceat(home, edge)
            pairs = []
            for lo, hi in zip(edge[busy].tolist(), stop[busy].tolist()):
                values, at = np.unique(fp[lo:hi], return_inverse=True)
                found = list(_forest(values, np.unique(at[home[lo:hi]]), np.unique(at[~home[lo:hi]]), limit))
                pairs.append(values[np.array(found, np.int64).reshape(-1, 2)])
            pairs = np.concatenate([*pairs, np.empty((0, 2), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = ["anchor", "i", "j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell keys, fingerprints, at home) of sorted rows, cut only between cells."""
    held = []
    for b in batches:
        cell = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        rows = (cell, b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False))
        if not len(cell):
            continue
        last = int(np.flatnonzero((cell != cell[-1]).any(1))[-1]) + 1 if (cell != cell[-1]).any() else 0
        if held and (held[-1][0][-1] != cell[0]).any() or last:
            cut = last if last else 0
            whole = [*held, tuple(x[:cut] for x in rows)]
            held = []
            yield tuple(np.concatenate(x) for x in zip(*whole))
            rows = tuple(x[cut:] for x in rows)
        held.append(rows)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of each row's whole text as a signed 64-bit number."""

    @F.arrow_udf("long")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in batch], pa.int64())

    return of(text)


def near_duplicates(docs: DataFrame, limit: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint can be reached over links of at most ``limit``
    differing bits. Texts without words have fingerprint 0 and link like any other. A null doc_id is never
    a component's name unless no other is there. Repeated rows get the same answer.
    """
    marked = cut_lineage(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = cut_lineage(first)
    named = name_components(marked, distinct, links(distinct, limit))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def name_components(marked: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row of ``marked``.

    ``distinct`` has the least doc_id of each fp, ``linked`` links (a, b) between fps.
    """
    roots = components(linked)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("fp", "component_id")
    return marked.join(answer, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, limit: int = THRESHOLD) -> DataFrame:
    """One row of each component: that of its smallest doc_id; all columns of ``docs``.

    Of repeated rows with that id one stays. Rows without an id stay only if their component has no id.
    """
    return keep_named(docs, near_duplicates(docs, limit))


def keep_named(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` after which the components of ``classes`` (doc_id, component_id) are named."""
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    kept = cut_lineage(kept)
    chosen = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    twice = chosen.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice"))
    return drop_repeats(chosen, cut_lineage(twice))


def drop_repeats(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each id of ``ids``; the other rows as they are."""
    once = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_twice"]), "left_anti")
    twice = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_twice"]), "left_semi")
    return once.unionByName(twice.dropDuplicates(["doc_id"]))
