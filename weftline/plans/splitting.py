"""Split, sampling and mixing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import split as sp
from weftline.plans import ansi
from weftline.plans.catalog import query
from weftline.sources import views


def _rank(seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {ansi.key(seed, 'doc_id')}, doc_id)"


@query(
    "exact_split",
    "H1",
    f"SELECT doc_id, CASE WHEN {_rank(42)} <= floor(0.1 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM documents",
)
def _(t):
    return sp.exact_split(t.documents.select("doc_id"), "doc_id", 0.1)


@query(
    "ratio_split",
    "H2",
    f"""WITH r AS (SELECT doc_id, {_rank(42)} AS r, count(*) OVER () AS n FROM documents), c AS (SELECT *, CAST(floor(0.2 * n) AS BIGINT) AS t FROM r)
    SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + floor(0.1 / 0.8 * (n - t)) THEN 'val' ELSE 'train' END AS split FROM c""",
)
def _(t):
    return sp.ratio_split(t.documents.select("doc_id"), "doc_id", 0.2, 0.1)


@query(
    "string_split",
    "H3",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at_, count(*) OVER () AS n FROM documents),
    c AS (SELECT *, round_even(0.949 * n, 0) AS a, round_even(0.05 * n, 0) AS b, round_even(0.001 * n, 0) AS d FROM r)
    SELECT doc_id, CASE WHEN at_ < a - (a + b + d - n) THEN 'train' WHEN at_ < a + b - (a + b + d - n) THEN 'val' ELSE 'test' END AS split FROM c""",
)
def _(t):
    return sp.string_split(t.documents.select("doc_id"), "doc_id", "949,50,1")


@query(
    "stratified_split",
    "H4",
    f"SELECT doc_id, lang, CASE WHEN {_rank(7, 'lang')} <= floor(count(*) OVER (PARTITION BY lang) * 0.1) THEN 'val' ELSE 'train' END AS split FROM documents",
)
def _(t):
    return sp.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang", 0.1, 7)


@query(
    "tail_split",
    "H5",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.15) THEN 'dev' ELSE 'train' END AS split FROM documents",
)
def _(t):
    return sp.tail_split(t.documents.select("doc_id"), "doc_id", 0.15)


@query(
    "group_split",
    "H6",
    f"SELECT conv_id, turn, CASE WHEN {ansi.uniform(13, 'conv_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM conversations",
)
def _(t):
    return sp.group_split(t.conversations.select("conv_id", "turn"), "conv_id", 0.2, 13)


@query(
    "rebalance",
    "H7",
    f"""WITH r AS (SELECT doc_id, lang, {_rank(17, 'lang')} AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents), m AS (SELECT max(n) AS top FROM r)
    SELECT doc_id, lang, unnest(range(top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END)) AS copy FROM r, m""",
)
def _(t):
    return sp.rebalance(t.documents.select("doc_id", "lang"), "doc_id", "lang", 17)


@query(
    "resample_down",
    "H8",
    f"SELECT doc_id, CAST(0 AS BIGINT) AS draw FROM (SELECT doc_id, {_rank(19)} AS r, count(*) OVER () AS n FROM documents) WHERE r <= n // 3",
)
def _(t):
    docs = t.documents.select("doc_id")
    return sp.resample(docs, "doc_id", docs.count() // 3, 19)


@query(
    "resample_up",
    "H8",
    f"""WITH r AS (SELECT doc_id, {_rank(19)} AS r, count(*) OVER () AS n FROM documents), n AS (SELECT max(n) AS n FROM r),
    d AS (SELECT i AS draw, {ansi.seeded_int(19, "'draw'", 'i')} % n + 1 AS r FROM (SELECT n, unnest(range(n * 2)) AS i FROM n))
    SELECT doc_id, draw FROM d JOIN r USING (r)""",
)
def _(t):
    docs = t.documents.select("doc_id")
    return sp.resample(docs, "doc_id", docs.count() * 2, 19)


@query(
    "weighted_draws",
    "H9",
    f"""WITH c AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS hi, sum(n_chars) OVER () AS total, count(*) OVER () AS n FROM documents),
    k AS (SELECT max(total) AS total, max(n) AS n FROM c), d AS (SELECT i AS draw, {ansi.uniform(23, "'w'", 'i')} * total AS u FROM (SELECT total, unnest(range(n)) AS i FROM k))
    SELECT draw, doc_id FROM d JOIN c ON u >= hi - n_chars AND u < hi""",
)
def _(t):
    docs = t.documents.select("doc_id", "n_chars")
    return sp.weighted_draws(docs, "doc_id", "n_chars", docs.count(), 23)


def _sizes(t) -> list[int]:
    rows = t.lineitem.groupBy("l_returnflag").count().orderBy("l_returnflag").collect()
    return [r["count"] for r in rows]


@query(
    "blend_stride",
    "H10",
    """WITH s AS (SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag),
    b AS (SELECT i AS bin, CASE WHEN i < 50 THEN 0 WHEN i < 80 THEN 1 ELSE 2 END AS d, CASE WHEN i < 50 THEN i WHEN i < 80 THEN i - 50 WHEN i < 99 THEN i - 80 ELSE 18 END AS bias FROM (SELECT unnest(range(100)) AS i)),
    x AS (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS idx)
    SELECT idx, b.d AS dataset, (bias + idx // 100 * CASE b.d WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE 20 END) % n AS sample FROM x JOIN b ON b.bin = idx % 100 JOIN s ON s.d = b.d""",
)
def _(t):
    sizes = _sizes(t)
    return sp.blend_stride(t.spark, [0.502, 0.304, 0.194], sizes, sum(sizes))


#: Weights of the languages in their order, repeating.
GREEDY = [4.0, 3.0, 2.000001, 1.0]


@query(
    "blend_greedy",
    "H11",
    """WITH RECURSIVE g AS (SELECT row_number() OVER (ORDER BY lang NULLS LAST) - 1 AS d, count(*) AS n FROM documents GROUP BY lang),
    k AS (SELECT list(n ORDER BY d) AS ns, list(([4000000, 3000000, 2000001, 1000000])[d % 4 + 1] ORDER BY d) AS ws, CAST(sum(([4000000, 3000000, 2000001, 1000000])[d % 4 + 1]) AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS size FROM g),
    f AS (SELECT CAST(-1 AS BIGINT) AS idx, list_transform(ns, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS d FROM k
      UNION ALL SELECT idx + 1, list_transform(c, lambda x, i: x + CASE WHEN i = d THEN 1 ELSE 0 END), CAST(d AS BIGINT) FROM
      (SELECT idx, c, list_position(e, list_max(e)) AS d FROM
        (SELECT idx, c, list_transform(ws, lambda x, i: x * greatest(idx + 1, 1) - w * c[i]) AS e FROM f, k WHERE idx + 1 < size * 2)))
    SELECT idx, d - 1 AS dataset, (c[d] - 1) % ns[d] AS sample FROM f, k WHERE idx >= 0""",
)
def _(t):
    # a row per language, null among them
    counts = [r["count"] for r in t.documents.groupBy("lang").count().orderBy(F.col("lang").asc_nulls_last()).collect()]
    weights = [GREEDY[d % len(GREEDY)] for d in range(len(counts))]
    return sp.blend_greedy(t.spark, weights, counts, 2 * sum(counts))


@query(
    "sample_counts",
    "H12 M17",
    "WITH w AS (SELECT lang, count(*) AS weight FROM documents GROUP BY 1) SELECT lang, weight, CAST(ceil(5000.0::DOUBLE * (weight / (SELECT CAST(sum(weight) AS DOUBLE) FROM w)) * 1.005::DOUBLE) AS BIGINT) AS samples FROM w",
)
def _(t):
    return sp.sample_counts(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("weight")), 5000)


@query(
    "mixed_samples",
    "H13",
    f"""WITH r AS (SELECT event_id, event_type, CAST(round(value * 1000) AS BIGINT) AS ms, {ansi.key(29, 'event_id')} AS k FROM events WHERE value <= 120),
    c AS (SELECT *, sum(ms) OVER (ORDER BY k, event_id) AS e FROM r), p AS (SELECT *, (e - ms) // 60000 AS sample FROM c)
    SELECT CAST(sample AS BIGINT) AS sample, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY k) AS ids, string_agg(event_type, ' ' ORDER BY k) AS langs, CAST(sum(ms) AS BIGINT) AS total_ms FROM p GROUP BY 1 HAVING sum(ms) BETWEEN 60000 AND 120000""",
)
def _(t):
    out = sp.mixed_samples(t.events, "event_id", "event_type", "value", 60, 120, 29)
    return out.select("sample", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join("langs", " ").alias("langs"), "total_ms")


PROMPTS = ["When does {} happen?", "Find: {}", "Where is '{}' said?"]


@query(
    "grounding_questions",
    "H14",
    f"""WITH r AS (SELECT doc_id, text, {_rank(37)} AS r, count(*) OVER () AS n FROM documents),
    s AS (SELECT doc_id, unnest(p) AS sentence, CAST(unnest(range(len(p))) AS BIGINT) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\\s+|\\n') AS p FROM r WHERE r <= floor(0.25 * n)))
    SELECT doc_id, pos, sentence, replace(['When does {{}} happen?', 'Find: {{}}', 'Where is ''{{}}'' said?'][CAST({ansi.seeded_int(37, 'doc_id', 'pos')} % 3 AS BIGINT) + 1], '{{}}', sentence) AS question FROM s""",
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    return sp.grounding_questions(docs, "doc_id", F.split("text", r"[.!?]\s+|\n"), PROMPTS, 0.25, 37)


@query(
    "train_remainder",
    "S4",
    f"SELECT event_id FROM events WHERE {ansi.uniform(3, 'event_id')} >= 0.3",
)
def _(t):
    keyed = sp.group_split(t.events.select("event_id"), "event_id", 0.3, 3)
    return keyed.filter(F.col("split") == "train").select("event_id")


@query(
    "union_schemas",
    "S1 S2",
    """SELECT lang AS label, count(*) AS rows FROM (SELECT lang FROM documents UNION ALL SELECT role FROM conversations UNION ALL SELECT event_type FROM events) GROUP BY 1""",
)
def _(t):
    parts = [t.documents.select(F.col("lang").alias("label"), "doc_id"), t.conversations.select(F.col("role").alias("label"), "turn"), t.events.select(F.col("event_type").alias("label"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("weighted_hours", "H12 G8", ansi.with_views(ansi.UTT) + "SELECT cls, round(sum(duration) / 3600, 6) AS hours FROM utt GROUP BY 1")
def _(t):
    return views.manifest_view(t.events).groupBy("cls").agg(F.round(F.sum("duration") / 3600, 6).alias("hours"))
