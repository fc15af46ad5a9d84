"""Best-fit packing of whole documents into fixed-size sequences by large-item matching.

1. A document's ids are cut into pieces of at most ``capacity``; only longer documents are cut.
2. The packing is decided on the histogram of piece lengths. It has at most ``capacity`` rows whatever
   the corpus holds, so the driver decides for the whole corpus at once and no chunk is packed alone:
   pieces above a third of the capacity pair at most twice per sequence (from the longest, each with the
   longest that still fits), the others go, longest first, to the tightest gap that takes them.
3. The answer is a list of slots (length, from, to, sequence, offset). The pieces of a length are numbered
   on the cluster and look their slot up, so no piece row passes through the driver.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage, place_in_order

CAPACITY = 2048
END_ID = 0
#: Pieces of text whose ids one worker remembers (about 200 bytes each).
REMEMBERED = 1_000_000

_PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
_WORKER: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts from one tokenizer file, remembering the ids of text pieces.

    The tokenizer cuts text at white space, contractions, letter runs, digits and punctuation runs before
    it merges, so the ids of a text are those of its pieces. Texts with characters outside ASCII and the
    Latin-1 letters are given to the tokenizer whole, as their normal form may cross a piece; so are texts
    that hold an added token such as ``<|endoftext|>``, which the tokenizer reads as one id.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.odd = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]").search
        self.pieces = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+").findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.odd(text) or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, pieces = self.known, self.pieces(text.lower())
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            ids = [t.id for t in self.model.tokenize(p)] if p.isascii() else self.tokenizer.encode(p, add_special_tokens=False).ids
            known[p] = np.array(ids, "<u4").tobytes()
        return b"".join([known[p] for p in pieces])


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process; read once."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, on demand, the ids.

    A null text counts as empty: its only id is the end id. Repeated rows give repeated pieces.
    ``tokenizer_path`` must be readable on the executors.
    """
    step = capacity * 4
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if keep_ids else []
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(tokenizer_path)
        for b in batches:
            rows, out = [], [[] for _ in fields]
            for i, text in enumerate(b.column(1)):
                ids = tok.encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    for col, v in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(v)
            doc_id = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, t) for c, (_, t) in zip(out, fields))], names=["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, from, to, first_sequence, offset, per_sequence) for ``counts`` pieces of each length.

    Pieces ``from <= place < to`` of a length fill sequences first_sequence, first_sequence + 1, ... with
    ``per_sequence`` pieces each from ``offset`` on. Work and result depend on the number of lengths only.
    """
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    opened = 0

    def put(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        slots.append((length, used[length], used[length] + n, first, offset, each))
        used[length] += n
        left[length] -= n

    large = [n for n in sorted(counts, reverse=True) if 3 * n > capacity and counts[n]]
    for z in large:
        while left[z]:
            mate = next((w for w in large if w <= min(z, capacity - z) and left[w]), None)
            n = left[z] if mate is None else left[z] // 2 if mate == z else min(left[z], left[mate])
            if mate == z and n == 0:  # one is left without a twin: the next shorter one, if any
                mate = next((w for w in large if w < z and w <= capacity - z and left[w]), None)
                n = 1
            put(z, n, opened, 0)
            if mate is not None:
                put(mate, n, opened, z)
            gaps.setdefault(capacity - z - (mate or 0), []).append((opened, n))
            opened += n
    small = [n for n in sorted(counts, reverse=True) if 3 * n <= capacity and counts[n]]
    for z in small:
        for gap in range(z, capacity + 1):
            runs = gaps.get(gap, [])
            while runs and left[z]:
                first, n = runs.pop()
                each = gap // z
                full = min(n, left[z] // each)
                if full:
                    put(z, full * each, first, capacity - gap, each)
                    gaps.setdefault(gap - each * z, []).append((first, full))
                if full < n and left[z]:  # fewer than ``each`` are left: one sequence takes them
                    rest = left[z]
                    put(z, rest, first + full, capacity - gap, rest)
                    gaps.setdefault(gap - rest * z, []).append((first + full, 1))
                    full += 1
                if full < n:
                    runs.append((first + full, n - full))
            if not left[z]:
                break
        if left[z]:
            each = capacity // z
            n = -(-left[z] // each)
            full = left[z] // each
            if full:
                put(z, full * each, opened, 0, each)
                gaps.setdefault(capacity - each * z, []).append((opened, full))
            if left[z]:
                rest = left[z]
                put(z, rest, opened + full, 0, rest)
                gaps.setdefault(capacity - rest * z, []).append((opened + full, 1))
            opened += n
    return slots


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``length`` must lie in 1..capacity.

    Pieces of one length are interchangeable for the packing; they are taken in the order of a digest of
    (doc_id, piece). An empty table gives an empty table.
    """
    parts = cut_lineage(parts)
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = sorted(plan_slots(counts, capacity))
    length = np.array([s[0] for s in slots], np.int64)
    start = np.array([s[1] for s in slots], np.int64)
    rest = np.array([s[3:] for s in slots], np.int64).reshape(-1, 3)
    shift = int(max(counts.values(), default=0)) + 1
    keys = length * shift + start

    @F.pandas_udf("sequence_id long, offset long")
    def slot(n, place):
        import pandas as pd

        n, place = n.to_numpy(np.int64), place.to_numpy(np.int64)
        at = np.searchsorted(keys, n * shift + place, side="right") - 1
        inside, (first, offset, each) = place - start[at], rest[at].T
        return pd.DataFrame({"sequence_id": first + inside // each, "offset": offset + inside % each * n})

    placed = place_in_order(parts.withColumn("_same", F.lit(0)), "length", "_same", ["doc_id", "piece"], "_place")
    return placed.withColumn("_slot", slot("length", "_place")).select(*parts.columns, "_slot.sequence_id", "_slot.offset")
