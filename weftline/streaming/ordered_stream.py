"""Keyed streams in event-time order, whatever the order and the micro-batches they arrive in.

Rows wait in list state until the watermark has passed them, as no earlier row can arrive any more. Event-time
timers release them in order to a fold over the stream's session. A session ends when no row came within
``gap`` of event time; its state is freed by a timer then, and a later row opens a new one. So the same rows come
out for any arrival within the watermark's delay, and state is held for open sessions only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A row at this time or later closes a replayed source: it lifts the watermark over all others and is no row itself.
END_OF_TIME = "9999-01-01"

#: (what the session has come to, its next rows in order, whether it ends with them) -> (the same, a tuple for each row)
Fold = Callable[[Any, list[dict], bool], tuple[Any, list[tuple]]]


class _Sessions(StatefulProcessor):
    """Waiting rows and the carried value of one key."""

    def __init__(self, fold: Fold, names: list[str], gap_us: int, hold: bool) -> None:
        self.fold, self.names, self.gap, self.hold = fold, names, gap_us, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, no long, payload string")
        self.carry = handle.getValueState("carry", "value string, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["us"].tolist(), pdf["no"].tolist(), pdf["payload"].tolist())]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready = sum(r[0] <= now for r in rows)
        value, last = None, None  # of the open session: what it has come to, and the time of its last row in that
        if self.carry.exists():
            text, last = self.carry.get()
            value = json.loads(text)
        out, at, ended = [], 0, True
        while ended:
            stop, end = at, last
            while stop < ready and (end is None or rows[stop][0] - end <= self.gap):
                end = rows[stop][0]
                stop += 1
            if end is None:
                break
            ended = stop < ready or now > end + self.gap
            take = stop - 1 if self.hold and not ended and stop > at else stop
            part = rows[at:take]
            if part:
                value, made = self.fold(value, [json.loads(r[2]) for r in part], ended)
                out += [(*key, r[1], *m) for r, m in zip(part, made)]
                last = part[-1][0]
            at = take
            if ended:
                value, last = None, None
            else:
                self._wake(end + self.gap + 1000)
        if len(rows) > at:
            self.waiting.put(rows[at:])
        else:
            self.waiting.clear()
        if last is None:
            self.carry.clear()
        else:
            self.carry.update((json.dumps(value), last))
        if len(rows) > ready:
            self._wake(rows[ready][0])
        yield pd.DataFrame(out, columns=self.names)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def in_order(
    frames: DataFrame, stream: str, time: str, order: str, payload: list[str], fold: Fold, out: list[T.StructField], gap: str, hold: bool = False
) -> DataFrame:
    """stream, order and the columns ``out`` that ``fold`` makes of each row's ``payload``, in order of (time, order) within a session.

    ``frames`` is a stream with a watermark on ``time``; ``order`` is a whole number, unique in a stream. The
    carried value of the fold must be one that JSON holds. With ``hold`` the last row of an open session
    waits until it is known whether the session ends with it. Rows without a time or at ``END_OF_TIME`` are left out.
    """
    gap_us = frames.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap}) AS us").first()["us"]
    rows = frames.filter(F.col(time) < F.lit(END_OF_TIME).cast("timestamp")).select(
        stream, time, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("no"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload")
    )
    schema = T.StructType([frames.schema[stream], T.StructField(order, T.LongType()), *out])
    return rows.groupBy(stream).transformWithStateInPandas(
        statefulProcessor=_Sessions(fold, schema.names, gap_us, hold), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def replay(frames: DataFrame, folder: str, time: str, parts: int, disorder_seconds: int) -> None:
    """Write a table as the files of a stream that arrives in ``parts``, out of order by up to ``disorder_seconds``, then its end.

    ``time`` is a timestamp. The row that ends the stream has ``END_OF_TIME`` and nulls.
    """
    from weftline.functions.seeded import seeded_uniform

    seconds = F.unix_micros(time) / 1e6
    late = frames.withColumn("_at", seconds + seeded_uniform("replay", F.col(time)) * disorder_seconds)
    bounds = late.agg(F.percentile_approx("_at", [i / parts for i in range(1, parts)], 1000).alias("b")).first()["b"] or []
    edges = [float("-inf"), *bounds, float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        late.filter((F.col("_at") > lo) & (F.col("_at") <= hi)).drop("_at").write.mode("append").parquet(folder)
    end = [F.lit(END_OF_TIME).cast("timestamp").alias(c) if c == time else F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in frames.columns]
    frames.sparkSession.range(1).select(*end).write.mode("append").parquet(folder)
