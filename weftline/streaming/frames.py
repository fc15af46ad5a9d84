"""Keyed frame streams: source, flags, rolling buffers, smoothing windows, running metrics.

Every operator has one definition that works on a batch and on a stream where Spark allows it; the
stateful ones have a batch twin without a per-stream sort in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordered import running
from weftline.session import cut_lineage, ensure_checkpoint_dir, remove_folder
from weftline.streaming.ordered_stream import in_order


def read_frames(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", time: str | None = None,
    delay: str = "1 hour", keys: list[str] | None = None, max_files: int | None = None,
) -> DataFrame:
    """Frames of many keyed streams read together.

    File sources may repeat rows after a retry of the writer and deliver them out of order; with
    ``time`` a watermark bounds the state and ``keys`` drop repeats inside it.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    frames = reader.parquet(folder)
    if time:
        frames = frames.withWatermark(time, delay)
        if keys:
            frames = frames.dropDuplicatesWithinWatermark(keys)
    return frames


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, then return the result as a batch table.

    ``complete`` keeps the last full result. The stream's folders in the checkpoint folder are removed at
    the end; keyed state lies in RocksDB, as timers and lists need it.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    out, log = f"{base}/out", f"{base}/log"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    with state_in_rocksdb(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()
    result = cut_lineage(spark.read.schema(stream.schema).parquet(out))
    remove_folder(spark, base)
    return result


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, unless the session names a provider."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    named = own is not None and not own.endswith("HDFSBackedStateStoreProvider")
    if not named:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def frame_flags(frames: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """Frame number from 0, ``is_first`` and ``is_last`` of every stream."""
    one = F.lit(1)
    out = running(frames, order, [stream], row_no="_n", lead={"_next": one})
    return out.select(
        *frames.columns, (F.col("_n") - 1).alias("frame_no"), (F.col("_n") == 1).alias("is_first"), F.col("_next").isNull().alias("is_last")
    )


def multiplex(frames: DataFrame, stream: str, time: str, order: str, gap: str) -> DataFrame:
    """Streaming side of :func:`frame_flags`: numbers the frames of every session, marks its first and its last.

    A session ends when no frame came for ``gap`` of event time; then its state is freed.
    """

    def fold(seen: int | None, rows: list[dict], ended: bool) -> tuple[int, list[tuple]]:
        first = seen or 0
        upto = first + len(rows)
        return upto, [(n, n == 0, ended and n == upto - 1) for n in range(first, upto)]

    out = [T.StructField("seen", T.LongType()), T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType())]
    return in_order(frames, stream, time, order, [order], fold, out, gap, hold=True)


def rolling_buffer(frames: DataFrame, stream: str, frame_no: str, samples: str, size: int) -> DataFrame:
    """Batch buffers: the last ``size`` samples up to every frame, and how much of it is padding.

    Frames may differ in length. Each gets the place of its last sample in the stream; a frame reaches
    the buffers that end less than ``size`` samples later, so it is met in its own block of ``size``
    samples and in the next. No stream is sorted as a whole.
    """
    width = frames.select(F.max(F.size(samples))).first()[0] or 1
    if width > size:
        raise ValueError(f"frame size ({width}) exceeds buffer size ({size})")
    placed = running(frames.select(stream, frame_no, samples), [frame_no], [stream], sums={"_end": F.size(samples).cast("long")})
    block = F.floor(F.col("_end") / size)
    held = placed.select(
        F.col(stream).alias("_k"), F.col(frame_no).alias("_f"), F.col("_end").alias("_at"), F.col(samples).alias("_s"),
        F.explode(F.array(block, block + 1)).alias("_b"),
    )
    ends = placed.select(stream, frame_no, "_end", block.alias("_block"))
    near = ends.join(held, ends[stream].eqNullSafe(held["_k"]) & (ends["_block"] == held["_b"]))
    near = near.filter((F.col("_f") <= F.col(frame_no)) & (F.col("_at") > F.col("_end") - size) | (F.col("_f") == F.col(frame_no)))
    grouped = near.groupBy(stream, frame_no).agg(F.array_sort(F.collect_list(F.struct("_f", "_s"))).alias("_x"))
    flat = F.flatten(F.transform("_x", lambda x: x["_s"]))
    padding = F.greatest(F.lit(size) - F.size(flat), F.lit(0))
    filled = F.slice(F.concat(F.array_repeat(F.lit(0.0), padding), flat), -size, size)
    return grouped.select(stream, frame_no, filled.alias("buffer"), padding.cast("long").alias("left_padding"))


def rolling_buffer_stream(frames: DataFrame, stream: str, time: str, order: str, samples: str, size: int, gap: str) -> DataFrame:
    """Streaming twin of :func:`rolling_buffer`; the state is one buffer per open session."""

    def fold(state: list | None, rows: list[dict], ended: bool) -> tuple[list, list[tuple]]:
        buffer, padding = state or ([0.0] * size, size)
        out = []
        for r in rows:
            fresh = r[samples]
            if len(fresh) > size:
                raise ValueError(f"frame size ({len(fresh)}) exceeds buffer size ({size})")
            buffer = [*buffer, *map(float, fresh)][-size:]
            padding = max(0, padding - len(fresh))
            out.append((buffer, padding))
        return [buffer, padding], out

    out = [T.StructField("buffer", T.ArrayType(T.DoubleType())), T.StructField("left_padding", T.LongType())]
    return in_order(frames, stream, time, order, [samples], fold, out, gap)


def smooth_windows(frames: DataFrame, stream: str, time: str, value: str, size: str, hop: str, median: bool = False) -> DataFrame:
    """Overlapping windows of ``size`` every ``hop``: mean, and in a batch the exact median.

    Works on a stream (with a watermark on ``time``) for the mean; a stream's median is approximate.
    """
    agg = [F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean")]
    if median:
        middle = F.percentile_approx(value, 0.5, 10000) if frames.isStreaming else F.percentile(value, F.lit(0.5))
        agg.append(middle.alias("median"))
    return frames.groupBy(F.col(stream), F.window(time, size, hop).alias("w")).agg(*agg).select(
        stream, F.col("w.start").alias("start"), *[c for c in ("frames", "mean", "median")[: len(agg)]]
    )


def running_metric(frames: DataFrame, name: str, hit: Column, value: Column) -> DataFrame:
    """Sums across batches and datasets: the same aggregation on a batch or, in update or complete
    mode, on a stream."""
    return frames.groupBy(F.col(name).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(F.when(hit, value)).alias("mean")
    )


# ---------------------------------------------------------------- binarisation

def binarise(frames: DataFrame, stream: str, order: list[str], score: str, onset: Column, offset: Column, by: list[str] | None = None) -> DataFrame:
    """Hysteresis: on from a score >= onset, off from a score < offset, unchanged between.

    The state is the latest mark that is not null, found over value buckets of the order.
    """
    mark = F.when(F.col(score) >= onset, 1).when(F.col(score) < offset, 0)
    out = running(frames, order, [stream, *(by or [])], last={"_on": mark})
    return out.withColumn("active", F.coalesce(F.col("_on"), F.lit(0))).drop("_on")


def active_segments(active: DataFrame, stream: str, order: list[str], time: str, min_on: float = 0.0, min_off: float = 0.0) -> DataFrame:
    """Runs of active frames as segments; gaps under ``min_off`` are filled, then runs under
    ``min_on`` seconds dropped. ``time`` is in seconds; a run ends at the next frame's time.
    """
    nxt = running(active, order, [stream], lead={"_end": F.col(time)})
    on = nxt.filter(F.col("active") == 1).withColumn("_end", F.coalesce("_end", F.col(time)))
    gap = running(on, order, [stream], lag={"_prev": F.col("_end")})
    start = F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > min_off), 1).otherwise(0)
    runs = running(gap.withColumn("_new", start), order, [stream], sums={"segment": F.col("_new")})
    seg = runs.groupBy(stream, "segment").agg(F.min(time).alias("start"), F.max("_end").alias("end"))
    return seg.filter(F.col("end") - F.col("start") >= min_on)


def threshold_search(frames: DataFrame, stream: str, order: list[str], score: str, truth: str, grid: list[tuple[float, float]]) -> DataFrame:
    """False alarms, misses and detection error rate at every (onset, offset) pair of a small grid."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("onset"), F.lit(b).alias("offset")) for i, (a, b) in enumerate(grid)]))
    rows = frames.withColumn("_c", cells).select(*frames.columns, "_c.*")
    marked = binarise(rows, stream, order, score, F.col("onset"), F.col("offset"), by=["cell"])
    fa = F.sum(((F.col("active") == 1) & (F.col(truth) == 0)).cast("long"))
    miss = F.sum(((F.col("active") == 0) & (F.col(truth) == 1)).cast("long"))
    return marked.groupBy("onset", "offset").agg(
        fa.alias("false_alarm"), miss.alias("miss"), ((fa + miss) / F.sum(F.col(truth))).alias("det_error")
    )


TransformStep = Callable[[DataFrame], DataFrame]


def compose(df: DataFrame, *steps: TransformStep) -> DataFrame:
    """Filter and map steps one after the other."""
    for step in steps:
        df = df.transform(step)
    return df
