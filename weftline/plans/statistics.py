"""Corpus statistics and bucket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import word_count, words
from weftline.operators import buckets as bk
from weftline.operators import stats as st
from weftline.plans import ansi
from weftline.plans.ansi import UTT, with_views
from weftline.plans.catalog import query
from weftline.plans.filtering import CHAT_LENGTHS, TAGGED, chat_lengths, tagged_words
from weftline.plans.scoring import rounded
from weftline.sources import views

BUCKETS_2D = [(30, 20), (30, 60), (60, 40), (60, 100), (120, 30), (120, 100)]


@query(
    "bucket_1d",
    "G4",
    with_views(UTT) + "SELECT id, CASE WHEN duration <= 10 THEN 0 WHEN duration <= 30 THEN 1 WHEN duration <= 60 THEN 2 WHEN duration <= 150 THEN 3 END AS bucket FROM utt",
)
def _(t):
    return views.manifest_view(t.events).select("id", bk.bucket_of([10, 30, 60, 150], F.col("duration")).alias("bucket"))


STRICT = """CASE WHEN duration <= 30 THEN CASE WHEN num_tokens <= 20 THEN CASE WHEN num_tokens / duration <= 4 THEN 0 END WHEN num_tokens <= 60 THEN CASE WHEN num_tokens / duration <= 4 THEN 1 END END
WHEN duration <= 60 THEN CASE WHEN num_tokens <= 40 THEN CASE WHEN num_tokens / duration <= 2 THEN 2 END WHEN num_tokens <= 100 THEN CASE WHEN num_tokens / duration <= 2 THEN 3 END END
WHEN duration <= 120 THEN CASE WHEN num_tokens <= 30 THEN CASE WHEN num_tokens / duration <= 1 THEN 4 END WHEN num_tokens <= 100 THEN CASE WHEN num_tokens / duration <= 1 THEN 5 END END END"""


@query("bucket_2d_strict", "G4 B6", with_views(UTT) + f"SELECT id, {STRICT} AS bucket FROM utt WHERE {STRICT} IS NOT NULL")
def _(t):
    args = (BUCKETS_2D, F.col("duration"), F.col("num_tokens"), True, [4, 4, 2, 2, 1, 1])
    kept = bk.filter_bucketable(views.manifest_view(t.events), *args)
    return kept.select("id", bk.bucket_of(*args).alias("bucket"))


@query(
    "bucket_2d_lenient",
    "G4",
    with_views(UTT)
    + "SELECT id, CASE "
    + " ".join(f"WHEN duration <= {a} AND num_tokens <= {b} THEN {i}" for i, (a, b) in enumerate(BUCKETS_2D))
    + " END AS bucket FROM utt",
)
def _(t):
    b = bk.bucket_of(BUCKETS_2D, F.col("duration"), F.col("num_tokens"), strict=False)
    return views.manifest_view(t.events).select("id", b.alias("bucket"))


def _bounds_sql(source: str, n: int) -> str:
    """Row by row definition: the first row whose preceding sum since the last bound passes the share."""
    ctes = [
        f"v AS (SELECT v, row_number() OVER (ORDER BY v) AS r, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - v AS below, sum(v) OVER () / {n}.0 AS share FROM ({source}))",
        "b0 AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS HUGEINT) AS below, CAST(0 AS BIGINT) AS v)",
    ]
    for i in range(1, n):
        ctes.append(f"b{i} AS (SELECT v.r, v.below, v.v FROM v, b{i - 1} b WHERE v.r > b.r AND v.below - b.below > share ORDER BY v.r LIMIT 1)")
    return ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT {i - 1} AS i, CAST(v AS BIGINT) AS bound FROM b{i}" for i in range(1, n))


def _cuts_sql(rows: str, size: str, n: int, parts: int) -> tuple[str, list[str]]:
    """Buckets of ``rows`` (size, inner value n) at equal-mass bounds of the size, and the bounds of n inside each.

    A bucket that stands for k equal bounds is cut into k * ``parts``.
    """
    ctes = [
        f"rows_ AS ({rows})",
        f"marks AS (SELECT bound FROM ({'WITH ' + _bounds_sql(f'SELECT {size} AS v FROM rows_', n)}) UNION ALL SELECT max({size}) FROM rows_)",
        "plan AS (SELECT bound AS top, count(*) AS k, row_number() OVER (ORDER BY bound) - 1 AS bucket FROM marks GROUP BY bound)",
        f"placed AS (SELECT r.*, (SELECT count(*) FROM plan p WHERE p.top <= r.{size} AND p.bucket < (SELECT max(bucket) FROM plan)) AS bucket FROM rows_ r)",
    ]
    return ", ".join(ctes), [
        f"o AS (SELECT i.*, row_number() OVER w AS r, sum(n) OVER w - n AS below, sum(n) OVER (PARTITION BY bucket) / (k * {parts}.0) AS share "
        "FROM (SELECT x.*, k, top FROM inner_ x JOIN plan USING (bucket)) i WINDOW w AS (PARTITION BY bucket ORDER BY n ROWS UNBOUNDED PRECEDING))",
        "c0 AS (SELECT bucket, CAST(0 AS BIGINT) AS r, CAST(0 AS HUGEINT) AS below, CAST(0 AS BIGINT) AS n FROM plan)",
        *[
            f"c{i} AS (SELECT o.bucket, min(o.r) AS r, arg_min(o.below, o.r) AS below, arg_min(o.n, o.r) AS n FROM o JOIN c{i - 1} p USING (bucket) WHERE o.r > p.r AND o.below - p.below > share GROUP BY o.bucket)"
            for i in range(1, n * parts)
        ],
        "inside AS (" + " UNION ALL ".join(f"SELECT bucket, n FROM c{i}" for i in range(1, n * parts)) + ")",
    ]


def _buckets_2d_sql() -> str:
    first, rest = _cuts_sql("SELECT CAST(round(duration * 1000) AS BIGINT) AS ms, CAST(num_tokens AS BIGINT) AS n FROM utt WHERE round(duration * 1000) > 0", "ms", 5, 3)
    kept = (
        "rated AS (SELECT *, n / (ms / 1000.0::DOUBLE) AS tps FROM placed), dev AS (SELECT bucket, avg(tps) AS mu, stddev_pop(tps) AS sd FROM rated GROUP BY 1), "
        "inner_ AS (SELECT r.* FROM rated r JOIN dev USING (bucket) WHERE sd = 0 OR (tps - mu) / sd <= 4)"
    )
    ctes = ", ".join([first, kept, *rest, "fast AS (SELECT bucket, max(tps) AS tps, max(n) AS last FROM inner_ GROUP BY 1)", "ends AS (SELECT bucket, n FROM inside UNION ALL SELECT bucket, last FROM fast)"])
    return with_views(UTT)[:-1] + f", {ctes} SELECT top / 1000.0::DOUBLE AS bound, CAST(n AS BIGINT) AS tokens, round(tps, 6) AS max_tps FROM ends JOIN plan USING (bucket) JOIN fast USING (bucket)"


def _token_buckets_2d_sql() -> str:
    first, rest = _cuts_sql("SELECT CAST(input_length AS BIGINT) AS i, CAST(output_length AS BIGINT) AS n FROM lens WHERE input_length > 0", "i", 5, 3)
    ctes = ", ".join([first, "inner_ AS (SELECT * FROM placed)", *rest, "ratio AS (SELECT max(n / i) AS q FROM rows_)"])
    return with_views(CHAT_LENGTHS)[:-1] + f", {ctes} SELECT CAST(top AS BIGINT) AS source, CAST(n AS BIGINT) AS target FROM inside JOIN plan USING (bucket) UNION ALL SELECT CAST(top AS BIGINT), CAST(ceil(top * q) AS BIGINT) FROM plan, ratio"


def bounds_frame(t, bounds):
    return t.spark.createDataFrame([(i, int(b)) for i, b in enumerate(bounds)], "i int, bound long")


@query("duration_bounds", "G5", with_views(UTT)[:-1] + ", " + _bounds_sql("SELECT CAST(round(duration * 1000) AS BIGINT) AS v FROM utt WHERE duration > 0", 8))
def _(t):
    utt = views.manifest_view(t.events).filter(F.col("duration") > 0).select(F.round(F.col("duration") * 1000).cast("long").alias("v"))
    return bounds_frame(t, bk.equal_mass_bounds(utt, "v", 8))


@query("token_bounds", "G7", with_views(CHAT_LENGTHS)[:-1] + ", " + _bounds_sql("SELECT total_length AS v FROM lens", 6))
def _(t):
    return bounds_frame(t, bk.token_buckets(chat_lengths(t), "total_length", 6))


@query("buckets_2d", "G6", _buckets_2d_sql())
def _(t):
    return rounded(bk.buckets_2d(views.manifest_view(t.events), "duration", "num_tokens", 5, 3), "max_tps")


@query("token_buckets_2d", "G7", _token_buckets_2d_sql())
def _(t):
    return bk.token_buckets_2d(chat_lengths(t), "input_length", "output_length", 5, 3)


@query(
    "label_stats",
    "G1",
    """SELECT lang AS label, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 5) AS share, row_number() OVER (ORDER BY count(*) DESC, lang) AS rank, lang = max(lang) OVER () AS is_max_label FROM documents GROUP BY lang""",
)
def _(t):
    return st.label_stats(t.documents, "lang")


@query(
    "multi_label_stats",
    "G2",
    """SELECT CAST(i AS BIGINT) AS index, CAST(sum(v) AS BIGINT) AS positive, CAST(sum(1 - v) AS BIGINT) AS negative FROM (SELECT 0 AS i, quality AS v FROM labels UNION ALL SELECT 1, toxic FROM labels) GROUP BY 1""",
)
def _(t):
    return st.multi_label_stats(t.labels, F.array("quality", "toxic"))


@query(
    "class_weights",
    "G3",
    """WITH c AS (SELECT length(text) % 10 AS label, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT sum(n) AS total, count(*) AS k FROM c)
    SELECT i AS label, round(coalesce(total / (k * n), 1.0), 6)::DOUBLE AS weight FROM (SELECT unnest(range(12)) AS i) LEFT JOIN c ON c.label = i, s""",
)
def _(t):
    labelled = t.documents.select((F.length("text") % 10).alias("label"))
    return rounded(st.class_weights(labelled, "label", 12), "weight")


@query(
    "bce_weights",
    "G3",
    "SELECT CAST(i AS BIGINT) AS index, round(CASE WHEN sum(v) > 0 THEN sum(1 - v) / sum(v) ELSE 0 END, 6)::DOUBLE AS weight FROM (SELECT 0 AS i, quality AS v FROM labels UNION ALL SELECT 1, toxic FROM labels UNION ALL SELECT 2, 0 FROM labels) GROUP BY 1",
)
def _(t):
    return rounded(st.bce_weights(t.labels, F.array("quality", "toxic", F.lit(0))), "weight")


@query(
    "leaf_weights",
    "G8",
    with_views(UTT) + "SELECT cls, speaker % 5 AS part, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours FROM utt GROUP BY 1, 2",
)
def _(t):
    utt = views.manifest_view(t.events).withColumn("part", F.col("speaker") % 5)
    return rounded(st.leaf_weights(utt, ["cls", "part"], "duration"), "hours")


@query(
    "group_weights",
    "G9 M17",
    with_views(
        UTT,
        "leaf AS (SELECT cls, speaker % 5 AS part, sum(duration) / 3600 AS w FROM utt GROUP BY 1, 2)",
        "g AS (SELECT cls, pow(sum(w), 0.5) AS p FROM leaf GROUP BY 1)",
        "gs AS (SELECT cls, p / sum(p) OVER () AS s FROM g)",
    )
    + "SELECT leaf.cls, part, round(s, 6) AS share_0, round(pow(w, 0.8) / sum(pow(w, 0.8)) OVER (PARTITION BY leaf.cls), 6) AS share_1 FROM leaf JOIN gs USING (cls)",
)
def _(t):
    utt = views.manifest_view(t.events).withColumn("part", F.col("speaker") % 5)
    out = st.group_weights(st.leaf_weights(utt, ["cls", "part"], "duration"), ["cls", "part"], "hours", [0.5, 0.8])
    return rounded(out.select("cls", "part", "share_0", "share_1"), "share_0", "share_1")


@query(
    "feature_stats",
    "G10",
    """SELECT coalesce(CAST(label AS VARCHAR), 'default') AS speaker, count(*) AS frames, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM
    (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ROLLUP (label)""",
)
def _(t):
    out = st.feature_stats(t.embeddings, "label", F.col("embedding").cast("array<double>"), skip_zero=True)
    return rounded(out, "mean", "std")


@query(
    "speaker_value_stats",
    "G10",
    """SELECT coalesce(CAST(user_id AS VARCHAR), 'default') AS speaker, count(*) AS frames, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events WHERE value <> 0 GROUP BY ROLLUP (user_id)""",
)
def _(t):
    return rounded(st.feature_stats(t.events, "user_id", F.array("value"), skip_zero=True), "mean", "std")


@query(
    "length_histogram",
    "G11",
    with_views(ansi.LINES, f"c AS (SELECT len({ansi.words('utt')}) - 1 AS n, count(*) AS c FROM utterances GROUP BY 1)")
    + "SELECT i AS length, coalesce(c, 0) AS rows FROM (SELECT unnest(range((SELECT max(n) FROM c) + 1)) AS i) LEFT JOIN c ON n = i",
)
def _(t):
    return st.length_histogram(views.utterances(t.documents), F.size(words("utt")))


SWEEP = (
    "m AS (SELECT speaker, id, CAST(round(\"start\" * 1000) AS BIGINT) AS t, 1 AS step FROM spans UNION ALL SELECT speaker, id, CAST(round(\"end\" * 1000) AS BIGINT), -1 FROM spans), "
    "s AS (SELECT speaker, sum(step) OVER w AS depth, coalesce(lead(t) OVER (PARTITION BY speaker ORDER BY t, step, id) - t, 0) AS width FROM m WINDOW w AS (PARTITION BY speaker ORDER BY t, step, id ROWS UNBOUNDED PRECEDING)), "
    "x AS (SELECT speaker, sum(width) / 1000 AS session_dur, coalesce(sum(width) FILTER (WHERE depth >= 1), 0) / 1000 AS speech, coalesce(sum(width) FILTER (WHERE depth = 0), 0) / 1000 AS silence, coalesce(sum(width) FILTER (WHERE depth >= 2), 0) / 1000 AS overlap FROM s GROUP BY 1)"
)


@query("session_sweep", "G12", with_views(ansi.SPANS, SWEEP) + "SELECT speaker, round(session_dur, 3) AS session_dur, round(speech, 3) AS speech, round(silence, 3) AS silence, round(overlap, 3) AS overlap FROM x")
def _(t):
    return rounded(st.session_sweep(views.spans_view(t.events), "speaker"), "session_dur", "speech", "silence", "overlap", digits=3)


@query(
    "session_summary",
    "G12",
    with_views(ansi.SPANS, SWEEP)
    + """SELECT count(*) AS sessions, round(sum(session_dur) / 3600, 6) AS hours, round(sum(silence) / sum(session_dur), 6) AS silence_mean, round(var_pop(silence / session_dur), 6) AS silence_var,
    round(sum(overlap) / sum(speech), 6) AS overlap_mean, round(var_pop(overlap / speech), 6) AS overlap_var FROM x""",
)
def _(t):
    out = st.session_summary(st.session_sweep(views.spans_view(t.events), "speaker"))
    return rounded(out, "hours", "silence_mean", "silence_var", "overlap_mean", "overlap_var")


@query(
    "imbalance_report",
    "G13",
    "SELECT p_type AS value, count(*) AS rows, round_even(100 * count(*) / (SELECT count(*) FROM part), 0)::DOUBLE AS percent FROM part GROUP BY 1 ORDER BY rows DESC, value LIMIT 5",
)
def _(t):
    return st.imbalance_report(t.part, "p_type")


@query(
    "quality_issues",
    "G14",
    """WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text FROM documents)
    SELECT row, 'empty' AS issue FROM n WHERE text = '' UNION ALL SELECT row, 'duplicate' FROM (SELECT row, row_number() OVER (PARTITION BY text ORDER BY row) AS k FROM n) WHERE k > 1""",
)
def _(t):
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text")).alias("text"))
    return st.quality_issues(docs, "doc_id", ["text"], "text")


@query("low_count", "G14", "SELECT count(*) AS rows, count(*) < 64 AS too_few FROM benchmark")
def _(t):
    return st.low_count(t.benchmark, 64)


@query("common_suffix", "G15", "SELECT CASE WHEN count(DISTINCT length(p_name) % 2) > 1 THEN 'part.html' END AS suffix FROM part")
def _(t):
    tail = F.when(F.length("p_name") % 2 == 0, "x").otherwise("y")
    return st.common_suffix(t.part.select(F.concat("p_name", tail, F.lit("part.html")).alias("s")), "s")


@query(
    "size_report",
    "G16",
    with_views(ansi.TURNS, "x AS (SELECT length(src) + length(tgt) AS n FROM turns)", "m AS (SELECT count(*) AS rows, avg(n) AS mean, stddev_pop(n) AS std, max(n) AS longest FROM x)",
    "p AS (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM x) WHERE r = ceil(c * 0.995))")
    + """SELECT rows, round(mean, 6) AS mean, round(std, 6) AS std, longest, p.n AS p995, CAST(floor(greatest(least(mean + 2 * std, longest), p.n) / 4) + 100 AS BIGINT) AS max_seq_length,
    CASE WHEN rows <= 100 THEN 1024 WHEN rows <= 1000 THEN 2048 ELSE 4096 END AS hidden_size,
    CASE WHEN rows >= 128 OR rows * 0.9 > 128 THEN 128 WHEN rows * 0.9 > 64 THEN 64 WHEN rows * 0.9 > 32 THEN 32 WHEN rows * 0.9 > 16 THEN 16 WHEN rows * 0.9 > 12 THEN 12 WHEN rows * 0.9 > 8 THEN 8 WHEN rows * 0.9 > 4 THEN 4 ELSE 2 END AS max_batch FROM m, p""",
)
def _(t):
    out = st.size_report(views.turn_pairs(t.conversations), F.length("src") + F.length("tgt"))
    return rounded(out, "mean", "std")


@query(
    "run_summary",
    "G17",
    with_views(UTT, "g AS (SELECT speaker % 6 AS domain, cls, count(*) AS n, sum(CASE WHEN id % 10 = 0 THEN NULL ELSE duration END) AS r, count(CASE WHEN id % 10 = 0 THEN NULL ELSE duration END) AS rn, sum(num_tokens) AS t, sum(duration) AS s FROM utt GROUP BY 1, 2)")
    + "SELECT domain, CAST(sum(n) AS BIGINT) AS episodes, round(sum(r) / sum(rn), 6) AS mean_reward, CAST(sum(t) AS BIGINT) AS ticks, round(sum(s), 4) AS seconds, string_agg(cls || '=' || n, ', ' ORDER BY cls) AS terminations FROM g GROUP BY 1",
)
def _(t):
    utt = views.manifest_view(t.events)
    reward = F.when(F.col("id") % 10 != 0, F.col("duration"))
    out = st.run_summary(utt, F.col("speaker") % 6, reward, F.col("num_tokens"), F.col("duration"), F.col("cls"))
    return rounded(rounded(out, "mean_reward"), "seconds", digits=4)


@query(
    "tool_report",
    "G18",
    """SELECT 'tool_' || user_id AS tool, count(*) AS calls, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, user_id >= 100 AS invented FROM events GROUP BY user_id ORDER BY calls DESC, tool LIMIT 20""",
)
def _(t):
    calls = t.events.withColumn("tool", F.concat(F.lit("tool_"), F.col("user_id").cast("string")))
    return st.tool_report(calls, "tool", F.col("event_type") == "error", [f"tool_{i}" for i in range(100)])


@query("invented_share", "G18", "SELECT round(avg(CASE WHEN user_id >= 100 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS invented_share FROM events")
def _(t):
    calls = t.events.withColumn("tool", F.concat(F.lit("tool_"), F.col("user_id").cast("string")))
    return rounded(st.invented_share(calls, "tool", [f"tool_{i}" for i in range(100)]), "invented_share")


@query(
    "multi_reference_vocabulary",
    "G19",
    with_views(TAGGED, "s AS (SELECT cls, spoken, written, count(*) AS n FROM tagged WHERE spoken <> '' AND written <> '' AND spoken <> '<self>' AND len(string_split(spoken, ' ')) < 100 GROUP BY 1, 2, 3)", "u AS (SELECT * FROM s UNION ALL SELECT DISTINCT cls, spoken, spoken, 1 FROM s)")
    + "SELECT cls, spoken, written, max(n) AS n FROM u GROUP BY 1, 2, 3",
)
def _(t):
    return st.multi_reference_vocabulary(tagged_words(t), "cls", "spoken", "written")


@query(
    "episode_table",
    "G21 M5",
    """SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS results, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1""",
)
def _(t):
    return st.episode_table(t.conversations, "conv_id", F.col("role") == "assistant", F.col("role") == "user")


@query("chat_word_counts", "M5", f"SELECT role, CAST(sum(len({ansi.words('text')})) AS BIGINT) AS words FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("role").agg(F.sum(word_count("text")).alias("words"))
