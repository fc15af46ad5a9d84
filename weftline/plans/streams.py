"""Stream operator queries: batch forms with check SQL, and streams run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans import ansi
from weftline.plans.catalog import Tables, query
from weftline.plans.scoring import rounded
from weftline.streaming import endpoints as ep
from weftline.streaming import frames as fr
from weftline.session import ensure_checkpoint_dir, remove_folder
from weftline.streaming import ordered_stream as ordered
from weftline.streaming import state as ss


def event_stream(t: Tables, **kw):
    """The events table as a file stream."""
    return fr.read_frames(t.spark, t.folder, t.events.schema, "events.parquet", **kw)


def arriving(t: Tables, *columns):
    """The events as a stream that arrives in four parts, out of order by up to a day, and ends; ``at`` is its event time."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/arriving-{uuid.uuid4()}"
    frames = t.events.select(F.col("ts").cast("timestamp").alias("at"), "user_id", "event_id", *columns)
    ordered.replay(frames, folder, "at", 4, 86_400)
    return folder, fr.read_frames(t.spark, folder, frames.schema, time="at", delay="1 day", max_files=8)


#: Longer than the table's time, so that a user's events are one session.
GAP = "400 days"


def run_arriving(t: Tables, columns: list, build):
    """``build`` of the arriving events, run to their end."""
    folder, stream = arriving(t, *columns)
    out = fr.run_available(build(stream))
    remove_folder(t.spark, folder)
    return out


FLAGS = (
    "f AS (SELECT event_id, user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM events)"
)


def numbered(t):
    return fr.frame_flags(t.events.select("event_id", "user_id", "value"), "user_id", ["event_id"])


@query("frame_flags", "T1 M13", f"WITH {FLAGS} SELECT event_id, frame_no, frame_no = 0 AS is_first, frame_no = n - 1 AS is_last FROM f")
def _(t):
    return numbered(t).select("event_id", "frame_no", "is_first", "is_last")


@query("frame_flags_stream", "T1 M14", f"WITH {FLAGS} SELECT event_id, frame_no AS seen, frame_no = 0 AS is_first, frame_no = n - 1 AS is_last FROM f")
def _(t):
    out = run_arriving(t, [], lambda s: fr.multiplex(s, "user_id", "at", "event_id", GAP))
    return out.select("event_id", "seen", "is_first", "is_last")


BUFFER = (
    f"WITH {FLAGS}, b AS (SELECT user_id, frame_no, list(value) OVER (PARTITION BY user_id ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS v FROM f) "
    "SELECT user_id, frame_no, CAST(8 - len(v) AS BIGINT) AS left_padding, round(list_sum(v), 4) AS total, round(list_sum(list_transform(v, lambda x_, i_: x_ * (i_ + 8 - len(v)))), 4) AS weighted FROM b"
)


def buffer_checks(df):
    total = F.aggregate("buffer", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("buffer", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("user_id", "frame_no", "left_padding", F.round(total, 4).alias("total"), F.round(weighted, 4).alias("weighted"))


@query("rolling_buffer", "T2", BUFFER)
def _(t):
    frames = numbered(t).withColumn("samples", F.array("value"))
    return buffer_checks(fr.rolling_buffer(frames, "user_id", "frame_no", "samples", 8))


@query("rolling_buffer_stream", "T2 M14", BUFFER)
def _(t):
    out = run_arriving(t, [F.array("value").alias("samples")], lambda s: fr.rolling_buffer_stream(s, "user_id", "at", "event_id", "samples", 8, GAP))
    ids = numbered(t).select("user_id", "event_id", "frame_no")
    return buffer_checks(out.join(ids, ["user_id", "event_id"]))


@query(
    "smooth_windows",
    "T3",
    """WITH e AS (SELECT user_id, value, epoch_us(ts) AS us FROM events), w AS (SELECT user_id, value, (us // 3600000000 - k) * 3600000000 AS s, us FROM e, (SELECT unnest(range(6)) AS k) h)
    SELECT user_id, s // 1000000 AS start_second, count(*) AS frames, round(avg(value), 8) AS mean, round(median(value), 8) AS median FROM w WHERE s <= us AND us < s + 21600000000 GROUP BY 1, 2""",
)
def _(t):
    frames = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = fr.smooth_windows(frames, "user_id", "ts", "value", "6 hours", "1 hour", median=True)
    return rounded(out.withColumn("start_second", F.unix_seconds("start")).drop("start"), "mean", "median", digits=8)


@query(
    "smooth_windows_stream",
    "T3 T10",
    """WITH e AS (SELECT event_type, value, epoch_us(ts) AS us FROM events), w AS (SELECT event_type, value, (us // 21600000000 - k) * 21600000000 AS s, us FROM e, (SELECT unnest(range(4)) AS k) h)
    SELECT event_type, s // 1000000 AS start_second, count(*) AS frames, round(avg(value), 8) AS mean FROM w WHERE s <= us AND us < s + 86400000000 GROUP BY 1, 2""",
)
def _(t):
    stream = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    out = fr.run_available(fr.smooth_windows(stream, "event_type", "ts", "value", "24 hours", "6 hours"), "complete")
    return rounded(out.withColumn("start_second", F.unix_seconds("start")).drop("start"), "mean", digits=8)


def buffers(t):
    """Per user and day: the distinct 10-minute steps that hold an event."""
    step = F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)
    return (
        t.events.select("user_id", F.to_date("ts").alias("day"), step.cast("long").alias("step"), F.col("value"))
        .groupBy("user_id", "day")
        .agg(F.array_sort(F.collect_set("step")).alias("times"))
    )


STEPS = (
    "b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, hour(ts) * 6 + minute(ts) // 10 AS t FROM events), "
    "g AS (SELECT user_id, day, t, lead(t) OVER (PARTITION BY user_id, day ORDER BY t) - t - 1 AS gap FROM b), "
    "r AS (SELECT user_id, day, max(t) AS last_, max(t) FILTER (WHERE gap > 30) AS at_ FROM g GROUP BY 1, 2)"
)


@query(
    "endpoint_times",
    "T4",
    f"""WITH {STEPS} SELECT user_id, CAST(day AS VARCHAR) AS day, greatest(144 - last_ - 1, 0) > 30 OR at_ IS NOT NULL AS is_eou,
    CAST(CASE WHEN greatest(144 - last_ - 1, 0) > 30 THEN last_ + 1 + 15 WHEN at_ IS NOT NULL THEN at_ + 1 + 15 ELSE -1 END AS BIGINT) AS at FROM r""",
)
def _(t):
    out = buffers(t).withColumn("e", ep.eou_from_times(F.col("times"), F.lit(144), 30))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "e.is_eou", "e.at")


@query(
    "endpoint_emissions",
    "T5",
    f"""WITH {STEPS}, e AS (SELECT user_id, day, t FROM b WHERE t >= 80 UNION ALL SELECT DISTINCT user_id, day, 79 FROM b UNION ALL SELECT DISTINCT user_id, day, 144 FROM b),
    h AS (SELECT *, lead(t) OVER (PARTITION BY user_id, day ORDER BY t) - t - 1 AS gap FROM e), m AS (SELECT user_id, day, max(t) FILTER (WHERE gap > 20) AS t FROM h GROUP BY 1, 2)
    SELECT user_id, CAST(day AS VARCHAR) AS day, t IS NOT NULL AS is_eou, CAST(coalesce(t + 1 + 10, -1) AS BIGINT) AS at FROM m""",
)
def _(t):
    # a step emits token 1 where an event happened, silence (0) elsewhere
    emissions = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(143).cast("long")), lambda i: F.when(F.array_contains("times", i), 1).otherwise(0))
    rows = buffers(t).withColumn("em", emissions)
    out = rows.withColumn("e", ep.eou_from_emissions(F.col("em"), F.lit(100), 20, 0, lambda tok: F.lit(True)))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "e.is_eou", "e.at")


@query(
    "endpoint_segments",
    "T6",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) * 3600 + minute(ts) * 60 AS a, hour(ts) * 3600 + minute(ts) * 60 + value AS b, event_id FROM events),
    c AS (SELECT user_id, day, greatest(a, 3600.0) AS a, round_even(b, 4) AS b, row_number() OVER (PARTITION BY user_id, day ORDER BY a, b) AS k FROM s WHERE round_even(b, 4) > 3600),
    g AS (SELECT *, lead(a) OVER (PARTITION BY user_id, day ORDER BY k) - b AS gap FROM c),
    r AS (SELECT user_id, day, arg_max(b, k) AS last_, arg_max(b, k) FILTER (WHERE gap > 7200) AS at_ FROM g GROUP BY 1, 2)
    SELECT user_id, CAST(day AS VARCHAR) AS day, 86400 - last_ > 7200 OR at_ IS NOT NULL AS is_eou, CAST(CASE WHEN 86400 - last_ > 7200 THEN floor((last_ + 3600) / 10) WHEN at_ IS NOT NULL THEN floor((at_ + 3600) / 10) ELSE -1 END AS BIGINT) AS at FROM r""",
)
def _(t):
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("double")
    seg = t.events.select("user_id", F.to_date("ts").alias("day"), F.struct(second.alias("start"), (second + F.col("value")).alias("end")).alias("s"))
    rows = seg.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    rows = rows.withColumn("e", ep.eou_from_segments(F.col("segments"), 86400.0, 7_200_000, 10.0, 360))
    kept = rows.filter(F.exists("segments", lambda s: F.bround(s["end"], 4) > 3600))
    return kept.select("user_id", F.col("day").cast("string").alias("day"), "e.is_eou", "e.at")


#: The append as a recursion over a user's chunks: state after each (token, time) list of at most three, and the last token after an end.
APPEND = """WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
      [CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5, event_id % 3] AS tok, [event_id + 0.0::DOUBLE, event_id + 1.0::DOUBLE] AS at, event_type = 'error' AS eou FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS tail, CAST([] AS DOUBLE[]) AS times, false AS ended, CAST(-1 AS BIGINT) AS last_token, 0.0::DOUBLE AS last_time,
        CAST([] AS BIGINT[]) AS fresh, CAST([] AS DOUBLE[]) AS placed FROM c GROUP BY user_id
      UNION ALL SELECT user_id, k, event_id, (tail || fresh)[-3:], (times || placed)[-3:], eou, CASE WHEN len(fresh) > 0 THEN fresh[-1] ELSE last_token END,
        CASE WHEN len(fresh) > 0 THEN placed[-1] ELSE last_time END, fresh, placed FROM (
        SELECT *, list_transform(cut, lambda x_: x_ + CASE WHEN len(cut) > 0 AND len(times) > 0 AND greatest(cut[1], 0) <= times[-1] THEN times[-1] + 1 ELSE greatest(cut[1], 0) END - cut[1]) AS placed FROM (
          SELECT *, tok[skip + 1:] AS fresh, at[skip + 1:] AS cut FROM (
            SELECT s.user_id, c.k, c.event_id, tail, times, last_token, last_time, eou, tok, at,
              CASE WHEN ended THEN CASE WHEN last_token = tok[1] AND abs(last_time - at[1]) <= 2 THEN 1 ELSE 0 END
                WHEN len(tail) >= 2 AND tail[-2:] = tok THEN CASE WHEN at[2] - times[-2] <= 2 THEN 2 ELSE 0 END
                WHEN len(tail) >= 1 AND tail[-1] = tok[1] AND at[1] - times[-1] <= 2 THEN 1 ELSE 0 END AS skip
            FROM s JOIN c ON c.user_id = s.user_id AND c.k = s.k + 1))))
    SELECT user_id, event_id, array_to_string(fresh, ' ') AS tokens, array_to_string(placed, ' ') AS times FROM s WHERE k > 0"""


@query("overlap_append_stream", "T7 M14", APPEND)
def _(t):
    """One chunk per event: its own token and the one before it, as overlapping decoder output."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 5
    chunk = [
        F.array(k, (F.col("event_id") % 3).cast("long")).alias("tokens"),
        F.array(F.lit(0.0), F.lit(1.0)).alias("times"),
        F.col("event_id").cast("double").alias("offset"),
        (F.col("event_type") == "error").alias("eou"),
    ]
    out = run_arriving(t, chunk, lambda s: ss.append_stream(s, "user_id", "at", "event_id", GAP))
    return out.select("user_id", "event_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), F.array_join(F.col("times").cast("array<string>"), " ").alias("times"))


@query(
    "merge_tail",
    "T8",
    """SELECT c.conv_id, c.turn, rtrim(c.text, right(c.text, 1)) || d.text AS text, CAST(c.turn AS DOUBLE) AS "start", d.turn + 0.5::DOUBLE AS "end", least(0.9, 0.8)::DOUBLE AS conf
    FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1 WHERE right(c.text, 1) IN ('.', ',', '?', '!')
    UNION ALL SELECT c.conv_id, c.turn, c.text || d.text, CAST(c.turn AS DOUBLE), d.turn + 0.5::DOUBLE, 0.8 FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1 WHERE right(c.text, 1) NOT IN ('.', ',', '?', '!')""",
)
def _(t):
    seg = lambda conf: F.struct("text", F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), F.lit(conf).alias("conf"))
    head = t.conversations.select("conv_id", "turn", seg(0.9).alias("head"))
    tail = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), seg(0.8).alias("tail"))
    both = head.join(tail, ["conv_id", "turn"])
    merged = both.withColumn("m", ss.merge_tail(F.col("head"), F.col("tail"), F.least))
    return merged.select("conv_id", "turn", "m.*")


METRIC = "SELECT event_type AS name, count(*) AS rows, round(avg(CASE WHEN value <= 60 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(avg(value) FILTER (WHERE value <= 60), 6) AS mean FROM events GROUP BY 1"


@query("running_metric", "T9 U4", METRIC)
def _(t):
    return rounded(fr.running_metric(t.events, "event_type", F.col("value") <= 60, F.col("value")), "accuracy", "mean")


@query("running_metric_stream", "T9 T10 U4", METRIC)
def _(t):
    stream = event_stream(t)
    out = fr.run_available(fr.running_metric(stream, "event_type", F.col("value") <= 60, F.col("value")), "complete")
    return rounded(out, "accuracy", "mean")


HYST = (
    "m AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS sec, CASE WHEN value >= 80 THEN 1 WHEN value < 30 THEN 0 END AS mark FROM events), "
    "a AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS active FROM m)"
)


def scored_frames(t):
    return t.events.select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), (F.col("event_type") == "purchase").cast("int").alias("truth"))


@query("binarise", "T11", f"WITH {HYST} SELECT event_id, active FROM a")
def _(t):
    return fr.binarise(scored_frames(t), "user_id", ["event_id"], "value", F.lit(80), F.lit(30)).select("event_id", "active")


@query(
    "active_segments",
    "T11",
    f"""WITH {HYST}, n AS (SELECT *, coalesce(lead(sec) OVER (PARTITION BY user_id ORDER BY event_id), sec) AS e FROM a), o AS (SELECT * FROM n WHERE active = 1),
    p AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS pe FROM o), s AS (SELECT *, sum(CASE WHEN pe IS NULL OR sec - pe > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM p)
    SELECT user_id, CAST(seg AS BIGINT) AS segment, round(min(sec), 3) AS "start", round(max(e), 3) AS "end" FROM s GROUP BY 1, 2 HAVING max(e) - min(sec) >= 3600""",
)
def _(t):
    active = fr.binarise(scored_frames(t), "user_id", ["event_id"], "value", F.lit(80), F.lit(30))
    out = fr.active_segments(active, "user_id", ["event_id"], "sec", min_on=3600, min_off=7200)
    return rounded(out.withColumn("segment", F.col("segment").cast("long")), "start", "end", digits=3)


PAIRS_GRID = [(60.0, 20.0), (80.0, 30.0), (100.0, 60.0)]


@query(
    "threshold_search",
    "T11",
    "WITH "
    + ", ".join(
        f"m{i} AS (SELECT event_id, user_id, event_type, CASE WHEN value >= {a} THEN 1 WHEN value < {b} THEN 0 END AS mark FROM events), "
        f"a{i} AS (SELECT event_type, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS active FROM m{i}), "
        f"r{i} AS (SELECT {a}::DOUBLE AS onset, {b}::DOUBLE AS \"offset\", count(*) FILTER (WHERE active = 1 AND event_type <> 'purchase') AS fa, count(*) FILTER (WHERE active = 0 AND event_type = 'purchase') AS miss, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM a{i})"
        for i, (a, b) in enumerate(PAIRS_GRID)
    )
    + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(3)) + ") "
    + 'SELECT onset, "offset", CAST(fa AS BIGINT) AS false_alarm, CAST(miss AS BIGINT) AS miss, round((fa + miss) / n, 6) AS det_error FROM u',
)
def _(t):
    return rounded(fr.threshold_search(scored_frames(t), "user_id", ["event_id"], "value", "truth", PAIRS_GRID), "det_error")


@query("composed_steps", "U2", ansi.with_views(ansi.UTT) + "SELECT cls, count(*) AS rows FROM utt WHERE duration > 5 AND num_tokens > 3 GROUP BY 1")
def _(t):
    from weftline.sources.views import manifest_view

    return fr.compose(
        t.events,
        manifest_view,
        lambda d: d.filter(F.col("duration") > 5),
        lambda d: d.filter(F.col("num_tokens") > 3),
        lambda d: d.groupBy("cls").agg(F.count(F.lit(1)).alias("rows")),
    )
