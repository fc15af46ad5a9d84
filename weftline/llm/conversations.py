"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn, so a task meets every conversation's rows in order and
never holds one whole. ``mapInPandas`` carries the state of a dynamic program over Arrow batches: for each
place in the grammar (an optional system row, then pairs of user and assistant) the cheapest edits so far and
their order as texts. Each row leaves four backpointers of one byte. Backpointers and rows of a conversation
with more than ``HELD`` bytes are spilled to an unlinked file in the task's Spark folder. At the end of a
conversation the backpointers are followed from its last row to its first, and its rows are read once more
to write the repaired text's digest.

Whether a row repeats an earlier one is settled before, by a window over equal rows inside the same partitioning:
texts move once, and no task keeps what it has seen.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space; a row of nothing else is blank.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a conversation's rows and backpointers that a task holds in memory before it spills them.
HELD = 32 << 20
#: Places of the grammar: nothing yet, behind the system row, behind a user row, behind an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a repaired conversation may end, and what an inserted or re-roled row leads to.
ENDS, NEXT = (NOTHING, ASSISTANT), (USER, USER, ASSISTANT, USER)
FAULTS = ("", "blank", "duplicate", "truncated")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone), dealt by conversation, with ``fault``: the first of blank, duplicate, truncated, or none.

    Rows of a conversation stand by turn (nulls first), then by role and text; of equal ones the first isn't ``_again``.
    """
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    dealt = rows.repartition("conv_id").withColumn("_again", F.row_number().over(same) > 1)
    fault = F.when(last == "", "blank").when(F.col("_again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return dealt.withColumn("fault", fault)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows for ``repair`` after damage by crc32(`conv_id:turn`) % 20; a null reads as one space, but conv_id and turn stay null.

    Dropped rows stay with ``gone``, so that their conversation isn't lost.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    work = as_rows(rows).withColumn("_d", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20)
    new = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    return work.select("conv_id", "turn", role.alias("role"), new.alias("text"), (F.col("_d") == 0).alias("gone"), times.alias("_time")).drop("_time")


def as_rows(conversations: DataFrame) -> DataFrame:
    """Rows for ``repair`` from a table of conv_id, turn, role and text as it is; a null role or text reads as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(False).alias("gone"))


@lru_cache(64)
def _moves(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each place the moves (cost, edits, next place) that take a row with that initial."""
    late = TRUNCATED * truncated
    out = []
    for place in range(4):
        found, at, edits, cost = [], place, "", 0
        for _ in range(3):  # up to two rows inserted before this one
            found.append((cost + DELETE, edits + "D", at))
            if not must_go:
                if initial == "s" and at == NOTHING:
                    found.append((cost + late, edits + "K", SYSTEM))
                if initial == "ua"[NEXT[at] - USER]:
                    found.append((cost + late, edits + "K", NEXT[at]))
                found.append((cost + REROLE + late, edits + "R", NEXT[at]))
            at, edits, cost = NEXT[at], edits + "I", cost + INSERT
        out.append(tuple(found))
    return tuple(out)


#: All edits that a move can hold, for backpointers: place * 16 + number fits a byte.
_EDITS = ("D", "K", "R", "ID", "IK", "IR", "IID", "IIK", "IIR")
_START = ((0, 0), None, None, None)


@lru_cache(100_000)
def _step(state: tuple, initial: str, must_go: bool, truncated: bool) -> tuple[tuple, int, bytes]:
    """(state, cost, backpointers) behind a row.

    A state has (cost above the least, rank of the edits so far as texts) for each place, or None. Edits that
    lead to two places never begin one another, as both end with what was done to the same row; so ranks and
    the edits of the row decide every later order.
    """
    best: list[tuple | None] = [None] * 4
    for place, (old, moves) in enumerate(zip(state, _moves(initial, must_go, truncated))):
        for cost, edits, to in moves if old else ():
            new = (old[0] + cost, old[1], edits, place)
            if best[to] is None or new < best[to]:
                best[to] = new
    least = min(b[0] for b in best if b)
    order = sorted(b[1:] for b in best if b)
    state = tuple(b and (b[0] - least, order.index(b[1:])) for b in best)
    return state, least, bytes(b[3] * 16 + _EDITS.index(b[2]) if b else 255 for b in best)


def _finish(state: tuple) -> tuple[int, str, int]:
    """(cost, edits, place) of the cheapest end."""
    found = []
    for place, old in enumerate(state):
        at, edits = place, ""
        while old and at not in ENDS:
            at, edits = NEXT[at], edits + "I"
        if old:
            found.append((old[0] + INSERT * len(edits), old[1], edits, place))
    cost, _, edits, place = min(found)
    return cost, edits, place


class _Store:
    """Bytes that are written once and read in blocks from either end; beyond ``HELD`` they go to a file."""

    def __init__(self) -> None:
        self.held, self.file, self.size = bytearray(), None, 0

    def add(self, data: bytes) -> None:
        self.held += data
        self.size += len(data)
        if len(self.held) > HELD:
            if self.file is None:
                # Spark's own folder of this executor, where it spills its shuffles; the file has no name
                where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
                self.file = tempfile.TemporaryFile(dir=where if where and os.path.isdir(where) else None)
            self.file.write(self.held)
            self.held.clear()

    def read(self, start: int, stop: int) -> bytes:
        if self.file is None:
            return bytes(self.held[start:stop])
        if self.held:
            self.file.seek(0, os.SEEK_END)
            self.file.write(self.held)
            self.held.clear()
        self.file.seek(start)
        return self.file.read(stop - start)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """One conversation, fed with its rows in order."""

    def __init__(self) -> None:
        self.state, self.cost, self.rows = _START, 0, 0
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.distinct, self.least, self.last_turn, self.before = 0, 0, None, None, None
        self.back, self.lines = _Store(), _Store()

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        self.state, least, back = _step(self.state, initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
        self.cost += least
        self.rows += 1
        self.back.add(back)
        role_bytes, text_bytes = role.encode("utf-8", "replace"), text.encode("utf-8", "replace")
        self.lines.add(len(role_bytes).to_bytes(8, "little") + len(text_bytes).to_bytes(8, "little") + role_bytes + text_bytes)

    def finish(self, texts: bool = False) -> dict:
        """Counts, cost, edits and digest of the repaired conversation; with ``texts`` also its rows."""
        cost, tail, place = _finish(self.state)
        edits, step = [tail[::-1]], 1 << 20
        for hi in range(self.rows, 0, -step):
            lo = max(0, hi - step)
            block = self.back.read(4 * lo, 4 * hi)
            for i in range(hi - lo - 1, -1, -1):
                code = block[4 * i + place]
                edits.append(_EDITS[code % 16][::-1])
                place = code // 16
        audit = "".join(edits)[::-1]
        digest, fresh, place, out = hashlib.sha256(), True, NOTHING, []
        lines = self._lines()
        for e in audit:
            role, text = next(lines) if e != "I" else (b"", b"")
            if e == "D":
                continue
            place = SYSTEM if e == "K" and place == NOTHING and role[:1] == b"s" else NEXT[place]
            if e != "K":
                role = b"user" if place == USER else b"assistant"
            digest.update((b"" if fresh else b"\n") + role + b":")
            digest.update(text)
            fresh = False
            if texts:
                out.append((role.decode(), text.decode()))
        self.back.close()
        self.lines.close()
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.distinct
        found = {"gaps": min(gaps, (1 << 63) - 1), **{k: self.counts[k] for k in FAULTS[1:]}, "illegal": self.illegal, "cost": self.cost + cost, "audit": audit, "repaired_sha256": digest.hexdigest()}
        return found | ({"repaired": out} if texts else {})

    def _lines(self) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        block, start = b"", 0  # bytes from ``start`` on

        def take(n: int) -> bytes:
            nonlocal block, start, at
            if at + n > start + len(block):
                block, start = self.lines.read(at, min(self.lines.size, at + max(n, 1 << 20))), at
            at += n
            return block[at - n - start : at - start]

        for _ in range(self.rows):
            head = take(16)
            role = take(int.from_bytes(head[:8], "little"))
            yield role, take(int.from_bytes(head[8:], "little"))


def repair(rows: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, gone): its faults, cheapest edits and digest.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; with ``texts`` also
    ``repaired``, an array of (role, text), which holds a whole conversation in one row. Rows with ``gone``
    count for nothing but their conversation's place in the answer. Rows without a conv_id are one
    conversation. A row with an empty role has no initial, so it is never kept as it is. An empty table
    gives an empty one.
    """
    kind = rows.schema["conv_id"].dataType
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_again"]
    ready = faults(rows.select("conv_id", "turn", "role", "text", "gone")).sortWithinPartitions(*order)
    # nullable numbers would become floats in pandas
    ready = ready.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "fault", "gone")
    long = T.LongType()
    fields = [T.StructField("conv_id", T.StringType()), *[T.StructField(c, long) for c in ("gaps", *FAULTS[1:], "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    if texts:
        fields.append(T.StructField("repaired", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, name = None, None
        for b in batches:
            done: list[dict] = []
            for conv, known, turn, role, text, fault, gone in b.itertuples(index=False, name=None):
                if now is None or conv != name:
                    if now is not None:
                        done.append({"conv_id": name, **now.finish(texts)})
                    now, name = Conversation(), conv
                if not gone:
                    now.add(turn if known else None, role, text, fault)
            if done:
                yield pd.DataFrame(done)
        if now is not None:
            yield pd.DataFrame([{"conv_id": name, **now.finish(texts)}])

    found = ready.mapInPandas(run, T.StructType(fields))
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
