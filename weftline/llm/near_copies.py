"""Near copies by SimHash anchors, with an exact check of word shingles.

Every text's set of five-word shingles gets a wide SimHash. It is cut into blocks of 23 bits, each with the
4096 words of the binary Golay code as anchors, the covering code of ``simhash``. Two sets whose similarity
(Jaccard) is 0.8 differ in 15 % of the bits, so in one of ``BLOCKS`` blocks they differ in at most one bit
with a probability of 0.95 (0.98 at 0.83, 0.995 at 0.86); such a block brings them to a common anchor: values
of even parity go to all anchors within radius + 1 = 4, those of odd parity only to their home, and of two
values one bit apart one is even.

Sets of an anchor whose block values, sizes and check bits are near are candidates. All candidates of a
thinly settled anchor are checked on the whole sets. In a dense one (a large group of near copies) a spanning
forest of the candidates is made, of which a pair for each set is checked first. What such forests hold
together, and the links found leave in different components, is then compared whole, all sets with all, in
tiles of bounded size; a tile gives a spanning forest of its links, so pairs grow with the sets, not with the
square of a group. Only links of similarity 0.8 or more count, so a text is never called a near copy without
being one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage
from weftline.llm.components import components
from weftline.llm.simhash import SEED, anchor_homes, ascii_words, keep_named, name_components

WIDTH = 5
#: 23-bit blocks of a wide fingerprint (two to a 64-bit word, so an even number).
BLOCKS = 24
BITS = 23
#: Differing check bits (of 64) beyond which two sets aren't candidates: four deviations above the mean at 0.8.
CHECK = 22
#: Candidate pairs per row of an anchor up to which it is thinly settled.
THIN = 1
#: An anchor with more sets is cut into slices that are compared pair by pair in tasks of their own.
SLICE = 32_768
#: Shingles of a slice of a dense group; a tile compares two slices.
TILE = 1 << 20
#: Up to so many sets that have a candidate are looked up by broadcast, so that the other texts don't move.
BROADCAST = 1_000_000
#: Cells of a comparison at a time.
CELLS = 1 << 20


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


def wide_fingerprint(digests: np.ndarray) -> bytes:
    """SimHash of ``BLOCKS`` / 2 words of 64 bits: a bit is 1 if set in over half the digests' expansions."""
    ones = np.zeros(BLOCKS * 32, np.int64)
    steps = np.arange(1, BLOCKS // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(digests), 255):  # a byte counts so many
        x = digests[lo : lo + 255].view(np.uint64)[:, None] + steps
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(digests)).tobytes()


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, node (digest of its set), size of the set and wide fingerprint."""

    @F.arrow_udf("struct<node:long,size:int,bits:binary>")
    def of(batch: pa.Array) -> pa.Array:
        nodes, sizes, bits = [], [], []
        for t in batch:
            s = shingles(t.as_py())
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63))
            sizes.append(len(s))
            bits.append(wide_fingerprint(s))
        parts = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
        return pa.StructArray.from_arrays(parts, names=["node", "size", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), of(F.col("text")).alias("m")).select("doc_id", "digest", "m.*")


def settle(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor that each 23-bit value goes to."""
    home = anchor_homes()
    own = home[value]
    even = np.flatnonzero(np.bitwise_count(value) % 2 == 0)
    # an anchor within radius + 1 is the home of a value one bit away
    flips = np.sort(np.concatenate((own[even, None], home[value[even, None] ^ (1 << np.arange(BITS))]), 1), 1)
    new = np.concatenate((np.ones((len(even), 1), bool), flips[:, 1:] != flips[:, :-1]), 1)
    r, c = np.nonzero(new)
    away = flips[r, c] != own[even][r]
    rows = np.concatenate((np.arange(len(value)), even[r[away]]))
    return rows, np.concatenate((own, flips[r, c][away])), np.arange(len(rows)) < len(value)


def _values(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, values) of the rows of wide fingerprints."""
    for block in range(BLOCKS):
        yield block, (words[:, block // 2] >> np.uint64(block % 2 * BITS)).astype(np.int64) & ((1 << BITS) - 1)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), BLOCKS // 2)


def _crowded(sets: DataFrame) -> DataFrame:
    """(cell, slices) of the anchors with more than SLICE sets; at most BLOCKS * 4096 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCKS << 12, np.int64)
        for b in batches:
            for block, value in _values(_words(b.column(0))):
                total += np.bincount(block << 12 | settle(value)[1], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    counts = sets.select("bits").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") > SLICE).select("cell", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))


def _settled(sets: DataFrame) -> DataFrame:
    """cell (block and anchor), i, j (slices), home, value, check, node and size, a row for each anchor of each set.

    A slice of the homes of a crowded anchor meets every slice of its sets.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "home", "value", "check", "node", "size"]
        for b in batches:
            words = _words(b.column(2))
            kept = [b.column(k).to_numpy() for k in (0, 1)]
            check = np.zeros(b.num_rows, np.uint64)  # from the bits that no block uses
            for k in range(4):
                check |= (words[:, k] >> np.uint64(46) & np.uint64(0xFFFF)) << np.uint64(16 * k)
            for block, value in _values(words):
                row, anchor, home = settle(value)
                node, size = (x[row] for x in kept)
                columns = ((block << 12 | anchor).astype(np.int32), home, value[row].astype(np.int32), check[row].view(np.int64), node, size)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = sets.select("node", "size", "bits").mapInArrow(place, "cell int, home boolean, value int, check long, node long, size int")
    rows = rows.join(F.broadcast(cut_lineage(_crowded(sets))), "cell", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own, every = F.pmod(F.xxhash64("node"), F.col("slices").cast("long")).cast("int"), F.sequence(F.lit(0), F.col("slices") - 1)
    place_at = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), home.alias("home"))
    none = F.array().cast("array<struct<i:int,j:int,home:boolean>>")
    homes = F.when(F.col("home"), F.transform(every, lambda j: place_at(own, j, F.lit(True)))).otherwise(none)
    guests = F.transform(every, lambda i: place_at(i, own, F.lit(False)))
    at = F.when(F.col("slices") == 1, F.array(place_at(F.lit(0), F.lit(0), F.col("home")))).otherwise(F.concat(homes, guests))
    return rows.withColumn("at", F.explode(at)).select("cell", "at.i", "at.j", "at.home", "value", "check", "node", "size")


class _Anchor:
    """Sets that meet at one anchor."""

    def __init__(self, t: pa.Table) -> None:
        order = np.argsort(t.column("node").to_numpy())  # so that the forests of all anchors begin at the same sets
        self.home, self.value, self.check, self.node, self.size = (t.column(c).to_numpy()[order] for c in ("home", "value", "check", "node", "size"))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the rows ``a`` (down) and ``b`` (across) are candidates."""
        found = np.bitwise_count(self.value[a][:, None] ^ self.value[b]) <= 1
        if found.any():
            x, y = np.nonzero(found)
            p, q = a[x], b[y]
            small, large = np.minimum(self.size[p], self.size[q]).astype(np.int64), np.maximum(self.size[p], self.size[q])
            ok = (self.node[p] != self.node[q]) & (5 * small >= 4 * large.astype(np.int64))
            ok &= np.bitwise_count((self.check[p] ^ self.check[q]).view(np.uint64)) <= CHECK
            found[x, y] = ok
        return found

    def pairs(self, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Candidate pairs of nodes, smaller first; None if there are more than ``limit``."""
        homes, every = np.flatnonzero(self.home), np.arange(len(self.node))
        step, total, out = max(1, CELLS // max(1, len(every))), 0, []
        for lo in range(0, len(homes), step):
            part = homes[lo : lo + step]
            x, y = np.nonzero(self.near(part, every))
            total += len(x)
            if total > 2 * limit:  # two homes meet twice
                return None
            out.append(np.stack((self.node[part[x]], self.node[y]), 1))
        both = np.concatenate([*out, np.empty((0, 2), np.int64)])
        both = np.unique(np.sort(both, 1), axis=0)
        return both[:, 0], both[:, 1]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that connect all candidates: each node from the one that met it first."""
        rest, a, b = np.arange(len(self.node)), [], []
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            for i in queue:  # grows
                if not len(rest):
                    break
                near = self.near(np.array([i]), rest)[0] & (self.home[rest] | self.home[i])
                new, rest = rest[near], rest[~near]
                queue += new.tolist()
                a.append(np.full(len(new), self.node[i]))
                b.append(self.node[new])
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (a, b))
        return np.minimum(a, b), np.maximum(a, b)


def _candidates(settled: DataFrame) -> DataFrame:
    """(a, b, dense): candidate pairs, those of dense anchors thinned to a forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, 3):
            if t.num_rows < 2 or not (rows := _Anchor(t)).home.any():
                continue
            found = rows.pairs(THIN * t.num_rows)
            dense = found is None
            a, b = rows.forest() if dense else found
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), dense))], names=["a", "b", "dense"])

    keys = ["cell", "i", "j"]
    found = settled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, dense boolean")
    return found.groupBy("a", "b").agg(F.max("dense").alias("dense"))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one value of the first ``keys`` columns, from sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy() for k in range(keys)], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            now = tuple(key[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _read(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its shingles ``s`` for each of the distinct ``nodes``."""

    @F.arrow_udf("array<long>")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py()) for t in batch], pa.list_(pa.int64()))

    wanted = cut_lineage(sets.select("node", "digest").join(nodes, "node", "left_semi"))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    # texts of one digest are equal, sets of one node as well
    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text"))
    return cut_lineage(texts.select("node", of("text").alias("s")))


def _checked(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""
    read = _read(docs, sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    both = pairs.join(read.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(read.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    return both.filter(shared * 5 >= (F.size("s") + F.size("t") - shared) * 4).select("a", "b")


def tile_links(node: np.ndarray, root: np.ndarray, of: np.ndarray, sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Links of similarity 0.8 or more between rows that ``of`` marks and all rows, enough to join the roots that are linked."""
    size = sets.value_lengths().to_numpy().astype(np.int64)
    start, (_, code) = np.cumsum(size) - size, np.unique(sets.flatten().to_numpy(), return_inverse=True)
    holder = np.repeat(np.arange(len(size)), size)[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    name, a, b = np.unique(root, return_inverse=True)[1], [], []
    for x in np.flatnonzero(of).tolist():
        mine = code[start[x] : start[x] + size[x]]
        shared = np.zeros(len(size), np.int64)
        for c in mine.tolist():
            shared[holder[ends[c - 1] if c else 0 : ends[c]]] += 1  # a row holds a shingle once
        for y in np.flatnonzero((9 * shared >= 4 * (size + size[x])) & (name != name[x])).tolist():
            if name[y] != name[x]:
                a.append(node[x])
                b.append(node[y])
                name[name == name[y]] = name[x]
        if a and (name == name[x]).all():
            break
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _left_apart(docs: DataFrame, sets: DataFrame, dense: DataFrame, found: DataFrame) -> DataFrame:
    """Links between sets that the pairs ``dense`` hold together and the links ``found`` leave in different components.

    A group of over TILE shingles is cut into slices; every two of them meet in a tile.
    """
    roots = cut_lineage(components(found))
    rooted = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    between = dense.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    groups = components(between.filter("a <> b")).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    members = sets.select("node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(groups, "root")
    members = cut_lineage(members)
    apart = members.groupBy("cluster").agg(F.sum("size").alias("n"))
    slices = F.ceil(F.col("n") / TILE).cast("int")
    members = members.join(apart.select("cluster", slices.alias("slices")), "cluster")
    own = F.pmod(F.xxhash64("node"), F.col("slices").cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = members.join(_read(docs, sets, members.select("node")), "node").select("cluster", "node", "root", "s", own.alias("own"), F.explode(tiles).alias("at"))
    rows = rows.select("cluster", "at.i", "at.j", "own", "node", "root", "s")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, 3):
            own, node, root = (t.column(c).to_numpy() for c in ("own", "node", "root"))
            a, b = tile_links(node, root, own == t.column("i")[0].as_py(), t.column("s").combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["cluster", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) between sets of similarity 0.8 or more, enough to connect the candidates that are linked."""
    sets = cut_lineage(marked.groupBy("node").agg(F.min("digest").alias("digest"), F.first("size").alias("size"), F.first("bits").alias("bits")))
    pairs = cut_lineage(_candidates(_settled(sets.filter("size > 0"))))
    dense = pairs.filter("dense").select("a", "b")
    # one of a set's pairs in the forests; what the others hold together and links don't is compared whole
    least = dense.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = cut_lineage(_checked(docs, sets, pairs.filter("not dense").select("a", "b").unionByName(least)))
    if dense.isEmpty():
        return found
    return found.unionByName(cut_lineage(_left_apart(docs, sets, dense, found)))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over the links found. Texts without words are
    copies of each other. A null doc_id is a component's name only if no other is there.
    """
    marked = cut_lineage(_marked(docs))
    named = marked.withColumnRenamed("node", "fp")
    distinct = cut_lineage(named.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return name_components(named, distinct, links(docs, marked)).select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, as ``simhash.keep_first`` chooses it."""
    return keep_named(docs, near_copies(docs))
