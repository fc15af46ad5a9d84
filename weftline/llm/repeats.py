"""Exact removal of repeated long passages with run-length indexes.

A passage is a string of ``LENGTH`` bytes that starts at two places or more, in one document or in two. Every
byte that such a string covers is removed.

One index of the whole corpus would need one machine, so the corpus is cut where equal passages meet:

1. Every window of LENGTH bytes is named by its minimizer, the k-byte string of least hash inside it. Equal
   windows have the same minimizer at the same distance. Neighbouring windows share it, so a document
   becomes runs of windows, about one per 75 bytes. A run is described by two 64-bit digests: that of its
   minimizer and that of its whole stretch (all bytes its windows cover, and where the minimizer lies).
2. Runs meet by minimizer. One that stands alone holds no repeat. Runs with equal stretches are repeated as
   a whole. Runs of one task's texts with equal stretches are marked and merged before they are dealt out,
   so a passage that a third of all documents share costs one row per task, not per document.
3. What is left are runs with the same minimizer and different stretches: the edges of repeats. One stretch
   of each kind is read again, and the stretches are dealt out by minimizer. A task builds a
   run-length compressed Burrows-Wheeler index of its stretches. Common prefix lengths with the
   neighbours in suffix order are worked out at the ends of runs only; at all other places they follow from the place before (one less),
   so matching statistics stream through the text. Windows whose match is LENGTH or longer are marked.
   A minimizer with very many different stretches is compared window by window through digests instead,
   spread over all tasks.

Stretches are compared by 64-bit digests of their bytes, windows of the index byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage

LENGTH = 200
KMER = 50
#: Bytes of text hashed at a time, and bytes of stretches in one index.
BLOCK, INDEX = 1 << 20, 1 << 20
#: Stretches of one minimizer that are compared in one task; more are spread window by window.
TOGETHER = 2048

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as long as needed."""

    up = down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, n.bit_length())
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, b, _U)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


class TextHash:
    """Digests of any substring of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, from running minima of blocks in both directions."""
    n = len(x) - w + 1
    pad = np.append(x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    right = np.minimum.accumulate(pad, 1).ravel()
    left = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def runs(data: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: (first window, windows, minimizer place, minimizer digest, stretch digest)."""
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    h = TextHash(data)
    at = np.arange(len(data) - k + 1)
    kmer = h.of(at, at + k)
    # the place in the low bits: the first of equal strings counts, in every copy the same
    bits = _U(21)  # of a place in a block
    place = (_sliding_least((kmer >> bits << bits) | at.astype(_U), length - k + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(first, len(place)))
    q = place[first]
    stretch = _mix(h.of(first, first + count - 1 + length) + (q - first).astype(_U) * _U(_BASE))
    return first, count, q, kmer[q], stretch


class Stretches:
    """Run-length compressed Burrows-Wheeler index of some byte strings, each ended by a mark of its own."""

    def __init__(self, parts: list[bytes]) -> None:
        size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.zeros(self.start[-1], np.int64)
        text[:] = -1
        body = np.ones(len(text), bool)
        ends = self.start[1:] - 1
        body[ends] = False
        text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + len(parts)
        text[ends] = np.arange(len(parts))
        self.text = text
        self._sort()

    def _sort(self) -> None:
        """Suffix order by doubling, then the run ends of the transform."""
        n, width = len(self.text), 1
        rank = self.text
        self.ranks = []  # ranks by the first 1, 2, 4, ... symbols, for common prefixes
        while True:
            self.ranks.append(rank.astype(np.int32))
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 512) + after
            order = np.argsort(key, kind="stable")
            fresh = np.append(True, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            width *= 2
            if fresh.all():
                break
        self.order = order
        bwt = self.text[order - 1]  # before the first suffix stands the last mark
        head = np.append(True, bwt[1:] != bwt[:-1])
        #: sampled run ends: places in suffix order where a run of the transform begins or ends
        self.heads, self.tails = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes, by halving steps over the kept ranks."""
        n, total = len(self.text), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            x, y = a + total, b + total
            inside = (x < n) & (y < n)
            r = self.ranks[level]
            same = inside & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
            total += same << level
        return total

    def matches(self) -> np.ndarray:
        """Longest match of every suffix with another suffix, streamed from the run ends."""
        n, best = len(self.text), np.zeros(len(self.text), np.int64)
        at = np.arange(n)
        for ends, step in ((self.heads, -1), (self.tails, 1)):
            ends = ends[(ends + step >= 0) & (ends + step < n)]
            own, other = self.order[ends], self.order[ends + step]
            known = np.full(n, -1, np.int64)
            known[own] = own
            value = np.zeros(n, np.int64)
            value[own] = self._common(own, other)
            edge = self.order[0 if step < 0 else n - 1]  # has no neighbour on that side
            known[edge], value[edge] = edge, 0
            last = np.maximum.accumulate(known)
            # off the run ends a suffix matches one symbol less than the one before it
            best = np.maximum(best, np.where(last >= 0, value[last] - (at - last), 0))
        return best


def _key(docs: DataFrame) -> DataFrame:
    """_id and _d name a row by its id and a digest of its text; rows equal in both are repeats of each other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_d"), text.alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """Rows of :func:`_key` with the text compressed, as texts are moved twice to meet what was found in them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = pa.array([squeeze(t.as_py()) for t in b.column(3).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], names=["doc_id", "_id", "_d", "packed"])

    return _key(docs).mapInArrow(pack, f"doc_id {kind}, _id long, _d long, packed binary")


def _unpack() -> Callable[[pa.Scalar], bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return lambda x: expand(x.as_py())


_RUN = "m long, s long, kept boolean, _id long, _d long, first int, count int, lead int"


def _runs_of(rows: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: (minimizer m, stretch s, kept, row, first window, windows, lead to the minimizer).

    Equal runs of one batch are repeats: each of them is reported without m as such, and one stands for
    them, with ``kept`` false, where runs of other tasks are met.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            ids, digests = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, text in enumerate(b.column(2).cast(pa.binary())):
                raw = text.as_buffer()
                data = np.frombuffer(raw, np.uint8) if len(raw) >= length else np.empty(0, np.uint8)
                for lo, found in _blocks(data, length, BLOCK):
                    first, count, q, m, s = found
                    for col, v in zip(cols, (m.view(np.int64), s.view(np.int64), np.full(len(m), ids[i]), np.full(len(m), digests[i]), first + lo, count, q - first)):
                        col.append(v)
            m, s, rid, dig, first, count, lead = (np.concatenate([*c, np.empty(0, np.int64)]) for c in cols)
            order = np.lexsort((s, m))
            m, s, rid, dig, first, count, lead = (x[order] for x in (m, s, rid, dig, first, count, lead))
            head = np.append(True, (m[1:] != m[:-1]) | (s[1:] != s[:-1]))[: len(m)]
            single = head & np.append(head[1:], True)[: len(m)]
            # the merged ones: marked where they are, and one of them goes on
            on, again = head, ~single
            null = np.concatenate((np.zeros(on.sum(), bool), np.ones(again.sum(), bool)))
            both = lambda x: np.concatenate((x[on], x[again]))
            arrays = [pa.array(both(m), pa.int64()), pa.array(both(s), pa.int64(), mask=null), pa.array(both(single)), *(pa.array(both(x), pa.int64()) for x in (rid, dig)), *(pa.array(both(x).astype(np.int32)) for x in (first, count, lead))]
            for at in range(0, len(null), 1 << 17):
                yield pa.RecordBatch.from_arrays([a[at : at + (1 << 17)] for a in arrays], names=["m", "s", "kept", "_id", "_d", "first", "count", "lead"])

    return rows.select("_id", "_d", "text").mapInArrow(cut, _RUN)


def _blocks(data: np.ndarray, length: int, block: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Runs of a text in pieces of bounded memory; pieces overlap so that every window lies in one."""
    for lo in range(0, max(1, len(data) - length + 1), block):
        yield lo, runs(data[lo : lo + block + length - 1], length)


def _meet(rows: DataFrame) -> DataFrame:
    """Marks (m null) and stretches to compare (m set) from runs that meet by minimizer.

    open: 0 a mark of ``count`` windows from ``first``; 1 a stretch to compare; 2 the same, in a crowd;
    ``kept``: the stretch itself is not yet known as a repeat.
    """
    known = rows.filter("s is null").select(F.lit(0).alias("open"), F.lit(None).cast("long").alias("m"), F.lit(False).alias("kept"), "_id", "_d", "first", "count", "lead")
    live = rows.filter("s is not null")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            m, s = t["m"].to_numpy(), t["s"].to_numpy()
            kept = t["kept"].to_numpy()
            new_m = np.append(True, m[1:] != m[:-1])
            new_s = new_m | np.append(True, s[1:] != s[:-1])
            group, kind = np.cumsum(new_m) - 1, np.cumsum(new_s) - 1
            kinds = np.bincount(group[new_s])  # different stretches of a minimizer
            many = np.bincount(kind)  # rows of a stretch
            whole = many[kind] > 1
            fresh = new_s & kept & ~whole  # nothing equals it yet
            unsolved = np.bincount(group, fresh)  # stretches that may hold repeats of parts
            compare = new_s & (kinds[group] > 1) & (unsolved[group] > 0)
            mark = whole & kept
            crowd = kinds[group] > TOGETHER
            rows_out = np.concatenate((np.flatnonzero(mark), np.flatnonzero(compare)))
            is_mark = np.arange(len(rows_out)) < mark.sum()
            out = t.take(pa.array(rows_out))
            opened = np.where(is_mark, 0, 1 + crowd[rows_out]).astype(np.int32)
            yield from pa.table({
                "open": pa.array(opened), "m": pa.array(out["m"].to_numpy(), mask=is_mark), "kept": pa.array(fresh[rows_out] & ~is_mark),
                **{c: out[c] for c in ("_id", "_d", "first", "count", "lead")},
            }).to_batches()

    met = live.repartition("m").sortWithinPartitions("m", "s").mapInArrow(meet, "open int, m long, kept boolean, _id long, _d long, first int, count int, lead int")
    return known.unionByName(met)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables that are cut only between values of m."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        m = b["m"].to_numpy()
        new = np.flatnonzero(m[1:] != m[:-1])
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and held[-1]["m"][-1].as_py() != m[0] and not cut:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_MARK = "_id long, _d long, first int, count int"


def _compare(docs: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """Marks of single windows, from the stretches that were left open."""
    asked = met.filter("open > 0").groupBy("_id", "_d").agg(F.collect_list(F.struct("m", "open", "kept", "first", "count")).alias("asked"))  # at most a text's runs
    joined = _packed(docs).select("_id", "_d", "packed").join(asked, ["_id", "_d"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("m", pa.int64()), ("w", pa.int64()), ("kept", pa.bool_()), ("_id", pa.int64()), ("_d", pa.int64()), ("first", pa.int32()), ("part", pa.binary())])
        unpack = _unpack()
        for b in batches:
            out: list[tuple] = []
            for rid, dig, text, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                raw = unpack(text)
                for a in asks.as_py():
                    part = raw[a["first"] : a["first"] + a["count"] - 1 + length]
                    if a["open"] == 1:
                        out.append((a["m"], None, a["kept"], rid, dig, a["first"], part))
                        continue
                    at = np.arange(a["count"])
                    h = TextHash(np.frombuffer(part, np.uint8)).of(at, at + length).view(np.int64)
                    out += [(a["m"], w, a["kept"], rid, dig, a["first"] + i, None) for i, w in enumerate(h.tolist())]
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo : lo + 20_000]), schema)], schema=schema)

    parts = cut_lineage(joined.mapInArrow(read, "m long, w long, kept boolean, _id long, _d long, first int, part binary"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t in _whole_groups(batches):
            held.append(t)
            size += t["part"].nbytes
            if size >= INDEX:
                yield from _marks(pa.concat_tables(held), length)
                held, size = [], 0
        if held:
            yield from _marks(pa.concat_tables(held), length)

    near = parts.filter("w is null").repartition("m").sortWithinPartitions("m").mapInArrow(index, _MARK)
    # in a crowd: digests of single windows; sums of copies are made before the shuffle
    crowd = parts.filter("w is not null")
    twice = crowd.groupBy("m", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m", "w")
    far = crowd.filter("kept").join(twice, ["m", "w"], "left_semi").select("_id", "_d", "first", F.lit(1).alias("count"))
    return near.unionByName(far)


def _marks(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows of open stretches that match elsewhere; large tables are cut between minimizers."""
    m = t["m"].to_numpy()
    size = np.cumsum(np.array([len(x) for x in t["part"].to_pylist()], np.int64))
    edges = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    lo = 0
    cuts = []
    for e, nxt in zip(edges, np.append(edges[1:], len(m))):
        if size[nxt - 1] - (size[lo - 1] if lo else 0) > INDEX and e > lo:
            cuts.append((lo, e))
            lo = e
    cuts.append((lo, len(m)))
    for a, z in cuts:
        part = t.slice(a, z - a)
        index = Stretches(part["part"].to_pylist())
        long = np.append(index.matches() >= length, False)
        owner = np.searchsorted(index.start, np.arange(len(long)), "right") - 1
        begin = np.flatnonzero(long & ~np.append(False, long[:-1]))
        end = np.flatnonzero(long & ~np.append(long[1:], False)) + 1
        kept = part["kept"].to_numpy()[owner[begin]]
        begin, end = begin[kept], end[kept]
        who = owner[begin]
        first = part["first"].to_numpy()[who] + (begin - index.start[who])
        yield pa.RecordBatch.from_arrays([pa.array(part["_id"].to_numpy()[who]), pa.array(part["_d"].to_numpy()[who]), pa.array(first.astype(np.int32)), pa.array((end - begin).astype(np.int32))], names=["_id", "_d", "first", "count"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _d, marks): byte spans [from, to) of each text that repeated passages cover, unmerged."""
    met = cut_lineage(_meet(_runs_of(_key(docs), length)))
    marks = met.filter("open = 0").select("_id", "_d", "first", "count").unionByName(_compare(docs, met, length))
    return marks.groupBy("_id", "_d").agg(F.collect_list(F.struct("first", "count")).alias("marks"))


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row.

    A null text counts as empty. A repeated row repeats all its passages, so both rows lose them. Texts
    shorter than ``length`` keep all bytes. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _packed(docs).join(repeated_spans(docs, length), ["_id", "_d"], "left").select("doc_id", "packed", "marks")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack()
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            marks = b.column(2)
            for i, text in enumerate(b.column(1)):
                raw = unpack(text)
                kept, removed, spans = raw, 0, 0
                if marks[i].is_valid:
                    first = np.asarray(marks[i].values.field("first"))
                    stop = first + np.asarray(marks[i].values.field("count")) - 1 + length
                    step = np.bincount(first, minlength=len(raw) + 1) - np.bincount(stop, minlength=len(raw) + 1)
                    gone = np.cumsum(step)[: len(raw)] > 0
                    removed = int(gone.sum())
                    spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for col, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, x) for c, x in zip(out, types))], names=names)

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
