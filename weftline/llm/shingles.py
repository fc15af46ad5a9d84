"""Near copies by the exact Jaccard similarity of their sets of five-word shingles.

Equal sets are merged first. Two sets whose similarity is at least 0.8 share at least 4/5 of the larger one,
so in any one order of all shingles they have one in common among the first n // 5 + 1 of each (n: its size).
Shingles that are common in a sample of texts stand last in that order, the others follow their digests;
the sample decides how many candidates there are, never which links are found. Texts meet at the shingles
that their beginnings share. Of few texts at a shingle every pair of like size is a candidate if their beginnings
share enough; many are cut into slices. Every candidate pair is checked on the whole sets, and only a spanning forest of the links of a
pair or of two slices leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage
from weftline.llm.simhash import SEED, ascii_words, keep_named, name_components

WIDTH = 5
#: Texts in the sample (about), and the share of them, one in so many, from which a shingle is common.
SAMPLE, COMMON = 8192, 1024
#: More texts than this at a shingle are cut into slices of SLICE.
FEW, SLICE = 32, 1024
#: Up to so many texts that have a candidate are looked up by broadcast, so that the others don't move.
BROADCAST = 1_000_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word shingles of a text (no word: none; few words: one)."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.int64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts, stops = [0], [len(line)]
    if len(words) > width:
        starts, stops = [0, *(ends[:-width] + 1).tolist()], ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64).view(np.int64))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the distinct texts (sorted), and their counts."""
    of = max(1, docs.count() // SAMPLE)
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(of).cast("long")) == 0).dropDuplicates(["text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], names=["s"])

    counts = texts.mapInArrow(cut, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    got = counts.filter(F.col("n") >= max(2, SAMPLE // COMMON)).orderBy("s").toArrow()
    return got["s"].to_numpy(), got["n"].to_numpy()


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the set), digest of the text, size of the set and its first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))

    @F.arrow_udf("struct<node:long,size:long,first:array<long>>")
    def of(batch: pa.Array) -> pa.Array:
        known, times = shared.value
        nodes, sizes, firsts = [], [], []
        for t in batch:
            s = shingles(t.as_py())
            n = np.zeros(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                n = np.where(known[at] == s, times[at], 0)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63))
            sizes.append(len(s))
            firsts.append(s[np.lexsort((s, n))[: len(s) // 5 + 1]])
        parts = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(parts, names=["node", "size", "first"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), of(F.col("text")).alias("m")).select("doc_id", "digest", "m.*")


def _cells(sets: DataFrame) -> DataFrame:
    """(x, y, z, side, node): nodes to compare in cell (x, y, z), those of side 0 or 2 with those of 1 or 2."""
    spread = sets.select(F.explode("first").alias("s"), "node", "size").repartition("s")
    # both columns are read here too, so that rows move once
    entry = F.struct("node", "size")
    busy = spread.groupBy("s").agg(F.min(entry).alias("a"), F.max(entry).alias("b")).filter("a <> b").select("s")
    met = cut_lineage(spread.join(busy, "s"))
    counts = cut_lineage(met.groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    few = met.join(counts.filter(F.col("n") <= FEW), "s")
    other = few.select("s", F.col("node").alias("other"), F.col("size").alias("its"))
    like = F.least("size", "its") * 5 >= F.greatest("size", "its") * 4
    pairs = few.join(other, "s").filter((F.col("node") < F.col("other")) & like)
    # what isn't common to both beginnings lies behind one of them; a pair that also meets among many is compared there
    rest = F.expr("greatest(size, its) - greatest(size, its) div 5 - 1")
    shared = pairs.groupBy("node", "other", "size", "its").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared.filter((F.col("n") + rest) * 9 >= (F.col("size") + F.col("its")) * 4)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("node").alias("node")), F.struct(F.lit(1).alias("side"), F.col("other").alias("node"))))
    pairs = pairs.select(F.col("node").alias("x"), F.col("other").alias("y"), F.lit(-1).cast("long").alias("z"), ends.alias("e")).select("x", "y", "z", "e.side", "e.node")

    slices = F.ceil(F.col("n") / SLICE).cast("long")
    many = met.join(counts.filter(F.col("n") > FEW), "s").withColumn("i", F.pmod(F.xxhash64("node"), slices))
    many = many.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    return pairs.union(many.select(F.col("s").alias("x"), F.least("i", "j").alias("y"), F.greatest("i", "j").alias("z"), side.alias("side"), "node"))


def _forest(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links of one cell."""
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    guests = [i for i, side in enumerate(sides) if side != 0]
    if not guests:
        return
    every, owner = np.concatenate([sets[i] for i in guests]), np.repeat(guests, size[guests])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for i in (i for i, side in enumerate(sides) if side != 1):
        lo, hi = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(nodes))
        for j in np.flatnonzero(both * 9 >= (size + size[i]) * 4).tolist():  # shared / all >= 4 / 5
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield nodes[i], nodes[j]


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) between sets, enough to join by a path every two whose similarity is at least 0.8."""
    sets = cut_lineage(marked.groupBy("node").agg(F.min("digest").alias("digest"), F.first("size").alias("size"), F.first("first").alias("first")))
    cells = cut_lineage(_cells(sets))
    wanted = cut_lineage(sets.select("node", "digest").join(cells.select("node").distinct(), "node", "left_semi"))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sides, sets in _whole(batches):
            found = list(_forest(nodes, sides, sets))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["x", "y", "z"]
    read = cells.join(texts, "node").select(*keys, "side", "node", "text")
    return read.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Nodes, sides and sets of each cell, from sorted rows."""
    last, held = None, ([], [], [])
    for b in batches:
        for x, y, z, side, node, text in zip(*[b.column(k).to_pylist() for k in range(5)], b.column(5)):
            if (x, y, z) != last and held[0]:
                yield held
                held = ([], [], [])
            last = (x, y, z)
            for values, v in zip(held, (node, side, shingles(text.as_py()))):
                values.append(v)
    if held[0]:
        yield held


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of similarity 0.8 or more. Texts
    without words are copies of each other. A null doc_id is a component's name only if no other is there.
    """
    marked = cut_lineage(_marked(docs))
    named = marked.withColumnRenamed("node", "fp")
    distinct = cut_lineage(named.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return name_components(named, distinct, links(docs, marked)).select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, as ``simhash.keep_first`` chooses it."""
    return keep_named(docs, near_copies(docs))
