"""Streams give the same rows as their batch twins, over several micro-batches."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.streaming import endpoints as ep
from weftline.streaming import frames as fr
from weftline.streaming import ordered_stream as ordered
from weftline.streaming import state as ss


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve files, written one after the other, of three interleaved streams."""
    where = str(tmp_path_factory.mktemp("frames"))
    rows = spark.range(240).select(
        "id", (F.col("id") % 3).alias("stream_id"), (F.col("id") * 7 % 11).cast("double").alias("value"),
        F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"), (F.col("id") >= 237).alias("is_last"),
    )
    for part in range(12):
        rows.filter(F.floor(F.col("id") / 20) == part).coalesce(1).write.mode("append").parquet(where)
    return where


SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("stream_id", T.LongType()), T.StructField("value", T.DoubleType()),
        T.StructField("ts", T.TimestampType()), T.StructField("is_last", T.BooleanType()),
    ]
)


def open_stream(spark, folder, **kw):
    return fr.read_frames(spark, folder, SCHEMA, max_files=3, **kw)


def arrivals(spark, where, files, shuffled=False):
    """The frames in so many files, in order or dealt at random, and the row that ends the stream."""
    rows = spark.range(240).select(
        "id", (F.col("id") % 3).alias("stream_id"), (F.col("id") * 7 % 11).cast("double").alias("value"),
        F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"), F.lit(False).alias("is_last"),
    )
    part = F.pmod(F.xxhash64("id"), F.lit(files).cast("long")) if shuffled else F.floor(F.col("id") * files / 240)
    for i in range(files):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(where)
    end = F.lit(ordered.END_OF_TIME).cast("timestamp").alias("ts")
    spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("stream_id"), F.lit(None).cast("double").alias("value"), end, F.lit(None).cast("boolean").alias("is_last")).write.mode("append").parquet(where)
    # shuffled frames are late by up to the whole length of the streams
    return fr.read_frames(spark, where, SCHEMA, time="ts", delay="5 hours" if shuffled else "0 seconds", max_files=1)


@pytest.fixture(scope="module", params=[(1, False), (3, False), (10, False), (4, True)])
def arriving(spark, tmp_path_factory, request):
    return arrivals(spark, str(tmp_path_factory.mktemp("arriving")), *request.param)


def test_multiplex(spark, folder, arriving):
    got = fr.run_available(fr.multiplex(arriving, "stream_id", "ts", "id", "1 day"))
    want = fr.frame_flags(spark.read.parquet(folder), "stream_id", ["id"])
    a = sorted((r["id"], r["seen"], r["is_first"], r["is_last"]) for r in got.collect())
    b = sorted((r["id"], r["frame_no"], r["is_first"], r["is_last"]) for r in want.collect())
    assert a == b


def test_sessions_end_after_a_gap(spark, tmp_path):
    """Frames every minute but for two holes; each part is numbered on its own and its state is freed."""
    ids = [*range(10), *range(50, 55), 100]
    rows = spark.createDataFrame([(i, 1) for i in ids], "id long, stream_id long").withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    ordered.replay(rows, str(tmp_path), "ts", 3, 300)
    stream = fr.read_frames(spark, str(tmp_path), rows.schema, time="ts", delay="10 minutes", max_files=1)
    seen = {}

    def fold(state, part, ended):
        n = (state or 0) + len(part)
        return n, [(n, ended) for _ in part]

    out = [T.StructField("n", T.LongType()), T.StructField("ended", T.BooleanType())]
    got = fr.run_available(ordered.in_order(stream, "stream_id", "ts", "id", ["id"], fold, out, "5 minutes", hold=True))
    seen = {r["id"]: r["ended"] for r in got.collect()}
    assert sorted(seen) == ids and all(seen[i] for i in (9, 54, 100))
    flags = fr.multiplex(fr.read_frames(spark, str(tmp_path), rows.schema, time="ts", delay="10 minutes", max_files=2), "stream_id", "ts", "id", "5 minutes")
    marks = {r["id"]: (r["seen"], r["is_first"], r["is_last"]) for r in fr.run_available(flags).collect()}
    assert marks[0] == (0, True, False) and marks[9] == (9, False, True) and marks[50] == (0, True, False) and marks[100] == (0, True, True)


def test_state_of_ended_sessions_is_freed(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") % 20).alias("stream_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    ordered.replay(rows, str(tmp_path / "in"), "ts", 4, 0)
    stream = fr.read_frames(spark, str(tmp_path / "in"), rows.schema, time="ts", delay="0 seconds", max_files=1)
    flags = fr.multiplex(stream, "stream_id", "ts", "id", "1 hour")
    with fr.state_in_rocksdb(spark):
        log = str(tmp_path / "log")
        query = flags.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination()
        assert spark.read.format("statestore").option("path", log).option("stateVarName", "carry").load().count() == 0
        assert spark.read.format("statestore").option("path", log).option("stateVarName", "waiting").load().count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_rolling_buffer(spark, folder, arriving):
    stream = arriving.select("ts", "stream_id", "id", F.array("value", F.col("value") + 0.5).alias("s"))
    got = fr.run_available(fr.rolling_buffer_stream(stream, "stream_id", "ts", "id", "s", 5, "1 day"))
    flat = fr.frame_flags(spark.read.parquet(folder), "stream_id", ["id"]).withColumn("s", F.array("value", F.col("value") + 0.5))
    want = fr.rolling_buffer(flat, "stream_id", "frame_no", "s", 5)
    a = {(r["stream_id"], (r["id"] - r["stream_id"]) // 3): (r["buffer"], r["left_padding"]) for r in got.collect()}
    b = {(r["stream_id"], r["frame_no"]): (r["buffer"], r["left_padding"]) for r in want.collect()}
    assert a == b
    assert a[0, 0][1] == 3 and a[0, 2][1] == 0


def test_oversized_frame(spark, folder):
    flat = fr.frame_flags(spark.read.parquet(folder), "stream_id", ["id"]).withColumn("s", F.array_repeat("value", 9))
    with pytest.raises(ValueError, match="exceeds buffer size"):
        fr.rolling_buffer(flat, "stream_id", "frame_no", "s", 5)


def test_running_metric_and_duplicates(spark, folder):
    hit = F.col("value") > 4
    stream = open_stream(spark, folder, time="ts", delay="1 day", keys=["id"])
    got = fr.run_available(fr.running_metric(stream, "stream_id", hit, F.col("value")), "complete")
    want = fr.running_metric(spark.read.parquet(folder), "stream_id", hit, F.col("value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_append_stream_equals_fold(spark, folder, arriving):
    chunk = lambda d: d.select(
        "ts", "stream_id", "id", F.array((F.col("id") % 4).cast("long"), (F.col("id") % 5).cast("long")).alias("tokens"),
        F.array(F.lit(0.0), F.lit(1.0)).alias("times"), F.col("id").cast("double").alias("offset"), (F.col("id") % 17 == 0).alias("eou"),
    )
    got = {(r["stream_id"], r["id"]): (r["tokens"], r["times"]) for r in fr.run_available(ss.append_stream(chunk(arriving), "stream_id", "ts", "id", "1 day")).collect()}
    states = {}
    for r in sorted(chunk(spark.read.parquet(folder)).collect(), key=lambda r: r["id"]):
        state, new, at = ss.append_chunk(states.get(r["stream_id"], ss.EMPTY), list(r["tokens"]), [t + r["offset"] for t in r["times"]], r["eou"])
        states[r["stream_id"]] = state
        assert got[r["stream_id"], r["id"]] == (new, at)


def test_windows_on_a_stream(spark, folder):
    stream = open_stream(spark, folder, time="ts", delay="1 day")
    got = fr.run_available(fr.smooth_windows(stream, "stream_id", "ts", "value", "30 minutes", "10 minutes"), "complete")
    want = fr.smooth_windows(spark.read.parquet(folder), "stream_id", "ts", "value", "30 minutes", "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(
    "times, stop, residue, want",
    [
        ([1, 2, 3], -1, 0, (False, -1)), ([1, 2], 0, 0, (True, 20)), ([], 0, 0, (False, -1)), ([1, 5], 6, 0, (True, 9)),
        ([1, 15, 18], 6, 0, (True, 5)), ([1, 2], 18, 0, (False, -1)), ([1, 13], 6, 2, (True, 5)),
    ],
)
def test_endpoint_times(spark, times, stop, residue, want):
    df = spark.createDataFrame([(times,)], "t array<int>")
    assert tuple(df.select(ep.eou_from_times(F.col("t"), F.lit(20), stop, residue).alias("e")).first()["e"]) == want


def walk(em, pivot, stop, starts):
    n, at, tok, hit = 0, -1, None, False
    i = len(em) - 1
    while i >= max(0, pivot - stop):
        if em[i] == 0:
            n += 1
            hit = n > stop and (tok is None or starts(tok))
            if hit:
                at = i
        else:
            if hit:
                break
            n, hit, at, tok = 0, False, -1, em[i]
        i -= 1
    return (True, at + stop // 2) if n > stop else (False, -1)


@pytest.mark.parametrize("seed", range(6))
def test_endpoint_emissions(spark, seed):
    import random

    rnd = random.Random(seed)
    em = [0 if rnd.random() < 0.8 else rnd.randint(1, 4) for _ in range(40)]
    pivot, stop = rnd.randint(10, 30), rnd.randint(2, 6)
    df = spark.createDataFrame([(em, pivot)], "e array<int>, p int")
    got = df.select(ep.eou_from_emissions(F.col("e"), F.col("p"), stop, 0, lambda t: t % 2 == 1).alias("x")).first()["x"]
    assert tuple(got) == walk(em, pivot, stop, lambda t: t % 2 == 1)


def test_endpoint_segments(spark):
    seg = "s array<struct<start:double,end:double>>"
    check = lambda s: tuple(spark.createDataFrame([(s,)], seg).select(ep.eou_from_segments(F.col("s"), 4.0, 800, 0.08).alias("e")).first()["e"])
    assert check([(0.0, 1.0), (1.5, 2.0)]) == (True, 30)
    assert check([(0.0, 1.0), (2.0, 3.5)]) == (True, 17)
    assert check([(0.0, 3.9)]) == (False, -1)
    assert check([]) == (False, -1)
