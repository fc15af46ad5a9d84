"""Ordering, batching and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import words
from weftline.operators import order as od
from weftline.plans import ansi
from weftline.plans.catalog import query
from weftline.sources import views


@query("keep_first", "W1 S4", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return od.keep_first(t.documents.select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


@query(
    "label_quota",
    "W2 S4",
    ansi.with_views(ansi.LINES)
    + f""", t AS (SELECT doc_id, pos, unnest({ansi.words('lower(utt)')}) AS w, unnest(range(len({ansi.words('lower(utt)')}))) AS i FROM utterances),
    n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos, i) AS n FROM t)
    SELECT doc_id, pos, coalesce(bool_or(n <= 5), false) AS kept FROM utterances LEFT JOIN n USING (doc_id, pos) GROUP BY doc_id, pos""",
)
def _(t):
    utt = views.utterances(t.documents).select("doc_id", "pos", "utt")
    return od.label_quota(utt, ["doc_id", "pos"], words(F.lower("utt")), 5).select("doc_id", "pos", "kept")


PATTERNS = {"digit": ("[0-9]", 40), "mail": ("@", 30), "question": ("[?]", 20), "upper": ("[A-Z]{2}", 25)}


def _pattern_sql() -> str:
    parts = [
        f"SELECT doc_id, pos, '{k}' AS p, row_number() OVER (ORDER BY doc_id, pos) AS n, {n} AS target FROM u WHERE regexp_matches(utt, '{rx}')"
        for k, (rx, n) in PATTERNS.items()
    ]
    return (
        ansi.with_views(ansi.LINES, "u AS (SELECT doc_id, pos, utt FROM utterances)", "h AS (" + " UNION ALL ".join(parts) + ")")
        + "SELECT DISTINCT doc_id, pos FROM h WHERE n <= target"
    )


@query("pattern_quota", "W3", _pattern_sql())
def _(t):
    utt = views.utterances(t.documents).select("doc_id", "pos", "utt")
    return od.pattern_quota(utt, ["doc_id", "pos"], {k: (F.col("utt").rlike(rx), n) for k, (rx, n) in PATTERNS.items()}).select("doc_id", "pos")


@query(
    "semi_sorted_batches",
    "W4",
    f"""WITH s AS (SELECT max(value) - min(value) AS span, count(*) AS n FROM events),
    o AS (SELECT event_id, row_number() OVER (ORDER BY value + ({ansi.uniform(3, 'event_id')} * 2 - 1) * span * 0.1 / 2, event_id) - 1 AS at_, n FROM events, s),
    x AS (SELECT n, ((7 - CAST(ceil(n / 16) AS BIGINT) % 7) % 7) * 16 AS missing FROM s),
    pad AS (SELECT i, n + i AS at_, {ansi.seeded_int(3, "'pad'", 'i')} % n AS src FROM (SELECT n, unnest(range(missing)) AS i FROM x)),
    r AS (SELECT event_id, at_ FROM o UNION ALL SELECT o.event_id, pad.at_ FROM pad JOIN o ON o.at_ = pad.src)
    SELECT event_id, at_ % 7 AS rank, at_ // 7 // 16 AS batch FROM r""",
)
def _(t):
    return od.semi_sorted_batches(t.events.select("event_id", "value"), "value", "event_id", 16, 7, 0.1, 3)


@query(
    "token_budget_batches",
    "W5",
    f"""WITH RECURSIVE w AS (SELECT doc_id, len({ansi.words('text')}) AS n FROM documents), o AS (SELECT doc_id, n, row_number() OVER (ORDER BY n, doc_id) AS r FROM w),
    f AS (SELECT r, doc_id, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS filled FROM o WHERE r = 1
      UNION ALL SELECT o.r, o.doc_id, CASE WHEN o.n * (f.filled + 1) > 40000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN o.n * (f.filled + 1) > 40000 THEN 1 ELSE f.filled + 1 END FROM f JOIN o ON o.r = f.r + 1)
    SELECT doc_id, batch FROM f""",
)
def _(t):
    rows = t.documents.select("doc_id", F.size(words("text")).alias("n"))
    return od.token_budget_batches(rows, "doc_id", "n", 40000).select("doc_id", "batch")


@query(
    "multimodal_length",
    "W6",
    ansi.with_views(ansi.UTT)
    + "SELECT id, round(ceil(duration / 0.08) + num_tokens + pow(ceil(duration / 0.08) + num_tokens, 2) / 5000.0, 6)::DOUBLE AS length FROM utt",
)
def _(t):
    n = od.sample_length(F.col("duration"), 0.08, F.col("num_tokens"), 5000.0)
    return views.manifest_view(t.events).select("id", F.round(n, 6).alias("length"))


@query(
    "rank_batches",
    "W7",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
    x AS (SELECT o_orderkey, r - 100 AS at_, n - 100 AS n FROM o WHERE r >= 100), p AS (SELECT *, (48 - n % 48) % 48 AS short FROM x),
    u AS (SELECT o_orderkey, at_ FROM p UNION ALL SELECT o_orderkey, at_ + short FROM p WHERE short > 0 AND at_ >= n - short)
    SELECT o_orderkey, at_ // 48 AS step, at_ % 48 // 8 AS rank, at_ % 8 AS place FROM u""",
)
def _(t):
    return od.rank_batches(t.orders, "o_orderkey", 8, 6, offset=100, pad=True)


@query(
    "rank_batches_drop",
    "W7",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at_, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, at_ // 44 AS step, at_ % 44 // 4 AS rank, at_ % 4 AS place FROM o WHERE at_ < n - n % 44""",
)
def _(t):
    return od.rank_batches(t.orders, "o_orderkey", 4, 11)


FUSED = "(l_extendedprice * 0.001::DOUBLE + l_discount * 2.0::DOUBLE + l_tax * 3.0::DOUBLE) / l_quantity / pow((l_quantity + 5) / 6, 0.6)"


@query(
    "noisy_channel_rerank",
    "W8",
    f"""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, {FUSED} AS score, struct_pack(a := -l_linenumber, b := -l_partkey) AS tie FROM lineitem)
    SELECT l_orderkey, arg_max(l_partkey, (score, tie)) AS l_partkey, round(max(score), 6) AS score FROM s GROUP BY 1""",
)
def _(t):
    score = od.fused_score(
        [(F.col("l_extendedprice"), 0.001), (F.col("l_discount"), 2.0), (F.col("l_tax"), 3.0)], F.col("l_quantity"), alpha=0.6
    )
    return od.rerank(t.lineitem, "l_orderkey", score, ["l_partkey"], [F.col("l_linenumber"), F.col("l_partkey")]).withColumn("score", F.round("score", 6))


GRID = [0.0, 0.5, 1.0, 2.0, 4.0]


@query(
    "coefficient_search",
    "W9",
    "WITH s AS (SELECT *, struct_pack(a := -l_linenumber, b := -l_partkey) AS tie FROM lineitem), "
    + ", ".join(
        f"g{i} AS (SELECT {c}::DOUBLE AS coefficient, sum(e) / sum(n) AS rate FROM (SELECT arg_max(l_suppkey % 7, (l_discount + l_tax * {c}::DOUBLE, tie)) AS e, max(l_quantity) AS n FROM s GROUP BY l_orderkey))"
        for i, c in enumerate(GRID)
    )
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(GRID)))
    + ") SELECT coefficient, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate, coefficient) = 1 AS best FROM u",
)
def _(t):
    tie = [F.col("l_linenumber"), F.col("l_partkey")]
    out = od.coefficient_search(
        t.lineitem, "l_orderkey", F.col("l_discount"), F.col("l_tax"), F.col("l_suppkey") % 7, F.col("l_quantity"), GRID, tie
    )
    return out.withColumn("rate", F.round("rate", 6))


@query("even_subset", "W10")
def _(t):
    return od.even_subset(t.documents.select("lang", "doc_id", "source"), "lang", "doc_id", "source", 6)
