"""Dialogue, understanding and normalisation score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.edit import correct_marks
from weftline.functions.text import is_blank, words
from weftline.metrics import dialogue as dg
from weftline.plans import ansi
from weftline.plans.ansi import HEARD, PAIRS, with_views
from weftline.plans.catalog import query
from weftline.plans.scoring import rounded
from weftline.plans.texts import ANSWER_SQL, answer_text, choice_sql
from weftline.sources import views


@query(
    "choice_report",
    "F21 E3",
    f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn = 7 THEN '  ' ELSE {ANSWER_SQL} END AS pred, CASE WHEN turn % 5 = 4 THEN NULL ELSE upper('abcd'[(conv_id + turn) % 4 + 1]) END AS truth FROM conversations),
    c AS (SELECT *, trim(pred) = '' AS empty, {choice_sql('lower(trim(pred))')} AS choice FROM a),
    g AS (SELECT *, coalesce(choice, 'ABCD'[{ansi.seeded_int(1, 'conv_id', 'turn')} % 4 + 1]) AS final FROM c)
    SELECT conv_id % 2 AS part, count(*) AS num_samples, CAST(count(*) FILTER (WHERE NOT empty AND final = truth) AS BIGINT) AS num_correct, CAST(count(*) FILTER (WHERE empty) AS BIGINT) AS num_empty,
    CAST(count(*) FILTER (WHERE NOT empty AND choice IS NULL) AS BIGINT) AS num_failed, CAST(count(*) FILTER (WHERE NOT empty AND truth IS NULL) AS BIGINT) AS num_skipped,
    round(count(*) FILTER (WHERE NOT empty AND final = truth) / count(*), 6) AS acc FROM g GROUP BY 1""",
)
def _(t):
    pick = F.upper(F.element_at(F.split(F.lit("abcd"), ""), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")))
    rows = t.conversations.withColumn("pred", F.when(F.col("turn") == 7, "  ").otherwise(answer_text())).withColumn("part", F.col("conv_id") % 2)
    truth = F.when(F.col("turn") % 5 != 4, pick)
    return rounded(dg.choice_report(rows, "pred", truth, ["conv_id", "turn"], 1, ["part"]), "acc")


@query(
    "turn_taking",
    "F22",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(step) FILTER (WHERE event_type = 'purchase') AS e, min(step) FILTER (WHERE event_type = 'view') AS s
      FROM (SELECT *, hour(ts) * 6 + minute(ts) // 10 AS step FROM events) GROUP BY 1, 2)
    SELECT user_id % 10 AS part, count(*) AS turns, round(avg(CASE WHEN abs(s - e) <= 13 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy,
    round(coalesce(avg((s - e) * 0.08) FILTER (WHERE abs(s - e) <= 13), 0), 6)::DOUBLE AS latency FROM s WHERE e IS NOT NULL GROUP BY 1""",
)
def _(t):
    steps = t.events.select(
        "user_id", F.to_date("ts").alias("day"), "event_type", (F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).alias("step"), (F.col("user_id") % 10).alias("part")
    )
    out = dg.turn_taking(steps, ["part", "user_id", "day"], "step", F.col("event_type") == "purchase", F.col("event_type") == "view", ["part"])
    return rounded(out, "accuracy", "latency")


@query(
    "confidence_marks",
    "F28",
    with_views(PAIRS) + f"SELECT lang, CAST(sum(len(h)) AS BIGINT) AS words, CAST(sum({HEARD}) AS BIGINT) AS correct FROM pairs GROUP BY 1",
)
def _(t):
    marks = views.pairs_view(t.documents).select("lang", F.size("h").cast("long").alias("n"), correct_marks("r", "h").alias("m"))
    return marks.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.size(F.filter("m", lambda x: x))).cast("long").alias("correct"))


def frames(t):
    """Four slots per order: status and year (categorical), priority and total (free)."""
    k = F.col("o_orderkey")
    slot = lambda name, cat, v, ref_on, hyp_on, hyp_v: F.struct(
        F.lit(name).alias("slot"), F.lit(cat).alias("categorical"), F.when(ref_on, F.array(v)).alias("ref"), F.when(hyp_on, hyp_v).alias("hyp")
    )
    year = F.year("o_orderdate").cast("string")
    slots = F.array(
        slot("status", True, F.col("o_orderstatus"), k % 5 != 0, k % 7 != 0, F.col("o_orderstatus")),
        slot("year", True, year, F.lit(True), F.lit(True), F.when(k % 11 == 0, F.lit("1900")).otherwise(year)),
        slot("priority", False, F.col("o_orderpriority"), k % 3 != 0, k % 3 != 0, F.when(k % 13 == 0, F.lit("x")).otherwise(F.col("o_orderpriority"))),
        slot("total", False, F.col("o_totalprice").cast("string"), k % 2 == 0, k % 4 == 0, F.col("o_totalprice").cast("string")),
    )
    return t.orders.select("o_orderkey", F.explode(slots).alias("s")).select("o_orderkey", "s.*")


GOAL = """WITH s AS (SELECT o_orderkey AS k, 'status' AS slot, true AS cat, o_orderkey % 5 <> 0 AS r, o_orderkey % 7 <> 0 AS h, true AS same FROM orders
  UNION ALL SELECT o_orderkey, 'year', true, true, true, o_orderkey % 11 <> 0 FROM orders
  UNION ALL SELECT o_orderkey, 'priority', false, o_orderkey % 3 <> 0, o_orderkey % 3 <> 0, o_orderkey % 13 <> 0 FROM orders
  UNION ALL SELECT o_orderkey, 'total', false, o_orderkey % 2 = 0, o_orderkey % 4 = 0, true FROM orders),
c AS (SELECT *, CASE WHEN r AND h THEN CASE WHEN same THEN 1.0 ELSE 0.0 END WHEN r OR h THEN 0.0 ELSE 1.0 END AS cor, CASE WHEN r = h THEN 1.0 ELSE 0.0 END AS st, CASE WHEN r AND h THEN CASE WHEN same THEN 1.0 ELSE 0.0 END END AS val FROM s),
f AS (SELECT k, avg(cor) FILTER (WHERE r) AS average_all, min(cor) AS joint_all, avg(cor) FILTER (WHERE r AND cat) AS average_cat, min(cor) FILTER (WHERE cat) AS joint_cat,
  avg(cor) FILTER (WHERE r AND NOT cat) AS average_noncat, min(cor) FILTER (WHERE NOT cat) AS joint_noncat, avg(st) FILTER (WHERE r AND cat) AS average_cat_status, min(st) FILTER (WHERE cat) AS joint_cat_status,
  avg(st) FILTER (WHERE r AND NOT cat) AS average_noncat_status, min(st) FILTER (WHERE NOT cat) AS joint_noncat_status, avg(val) FILTER (WHERE cat) AS average_cat_value, min(val) FILTER (WHERE cat) AS joint_cat_value,
  avg(val) FILTER (WHERE NOT cat) AS average_noncat_value, min(val) FILTER (WHERE NOT cat) AS joint_noncat_value FROM c GROUP BY 1)
SELECT """
GOAL_COLUMNS = [
    "average_all", "joint_all", "average_cat", "joint_cat", "average_noncat", "joint_noncat", "average_cat_status", "joint_cat_status",
    "average_noncat_status", "joint_noncat_status", "average_cat_value", "joint_cat_value", "average_noncat_value", "joint_noncat_value",
]


@query("goal_accuracy", "F30", GOAL + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}" for c in GOAL_COLUMNS) + " FROM f")
def _(t):
    per = dg.goal_accuracy(dg.slot_correctness(frames(t)), ["o_orderkey"])
    return rounded(per.agg(*[F.avg(c).alias(c) for c in GOAL_COLUMNS]), *GOAL_COLUMNS)


@query("goal_accuracy_fuzzy", "F30")
def _(t):
    rows = frames(t).withColumn("first_ref", F.coalesce(F.get("ref", F.lit(0)), F.lit(""))).withColumn("h", F.coalesce("hyp", F.lit("")))
    scored = dg.slot_correctness(dg.fuzzy_ratio(rows, "first_ref", "h", "similarity"), F.col("similarity"))
    per = dg.goal_accuracy(scored, ["o_orderkey"])
    return rounded(per.agg(*[F.avg(c).alias(c) for c in GOAL_COLUMNS]), *GOAL_COLUMNS)


@query(
    "requested_slots",
    "F31",
    with_views(
        ansi.TURNS,
        f"x AS (SELECT conv_id, turn, {ansi.words('lower(src)')} AS a, {ansi.words('lower(tgt)')} AS b FROM turns)",
        "u AS (SELECT conv_id, turn, 0 AS s, unnest(a) AS w FROM x UNION ALL SELECT conv_id, turn, 1, unnest(b) FROM x)",
        "c AS (SELECT conv_id, turn, w, count(*) FILTER (WHERE s = 0) AS p, count(*) FILTER (WHERE s = 1) AS q FROM u GROUP BY ALL)",
        "o AS (SELECT conv_id, turn, sum(least(p, q)) AS i, sum(p) AS n, sum(q) AS m FROM c GROUP BY 1, 2)",
    )
    + "SELECT conv_id, turn, round(i / m, 6) AS precision, round(i / n, 6) AS recall, round(CASE WHEN i > 0 THEN 2 * i / (n + m) ELSE 0 END, 6)::DOUBLE AS f1 FROM o",
)
def _(t):
    s = dg.list_f1(words(F.lower("src")), words(F.lower("tgt")))
    out = views.turn_pairs(t.conversations).select("conv_id", "turn", *[c.alias(k) for k, c in s.items()])
    return rounded(out, *s)


@query(
    "understanding_report",
    "F32",
    """WITH d AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS pl, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE source END AS ps FROM documents),
    w AS (SELECT *, levenshtein(source, CASE WHEN doc_id % 3 = 0 THEN source || 'z' ELSE source END) / length(source) AS dc, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS dw FROM d),
    s AS (SELECT count(*) AS total, sum(CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END) AS invalid, avg(CASE WHEN lang = pl THEN 1.0 ELSE 0 END) AS scenario, avg(CASE WHEN source = ps THEN 1.0 ELSE 0 END) AS action,
      avg(CASE WHEN lang = pl AND source = ps THEN 1.0 ELSE 0 END) AS intent, sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) AS hit, count(*) * 2 AS gold, count(*) + sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS pred,
      count(*) AS found, sum(least(dw, 1.0)) AS w, sum(least(dc, 1.0)) AS c, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS stray FROM w),
    f AS (SELECT *, 2 * found / (2 * found + stray + w + gold - found + w) AS wf, 2 * found / (2 * found + stray + c + gold - found + c) AS cf FROM s)
    SELECT total, CAST(invalid AS BIGINT) AS invalid, round(scenario, 6)::DOUBLE AS scenario, round(action, 6)::DOUBLE AS action, round(intent, 6)::DOUBLE AS intent, round(2 * hit / (gold + pred), 6)::DOUBLE AS entity,
    round(wf, 6)::DOUBLE AS word_dist, round(cf, 6)::DOUBLE AS char_dist, round(2 * wf * cf / (wf + cf), 6)::DOUBLE AS slu FROM f""",
)
def _(t):
    ent = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("filler"))
    i = F.col("doc_id")
    src = F.col("source")
    gold = F.array(ent("place", src), ent("size", F.col("n_chars").cast("string")))
    near = ent("place", F.when(i % 3 == 0, F.concat(src, F.lit("z"))).otherwise(src))
    pred = F.when(i % 2 == 0, F.array(near, ent("date", F.lit("today")))).otherwise(F.array(near))
    rows = t.documents.select(
        F.col("lang").alias("scenario"), src.alias("action"), gold.alias("entities"),
        F.when(i % 4 == 0, "xx").otherwise(F.col("lang")).alias("pred_scenario"), F.when(i % 5 == 0, "none").otherwise(src).alias("pred_action"),
        pred.alias("pred_entities"), (i % 50 == 0).alias("invalid"),
    )
    return rounded(dg.understanding_report(rows), "scenario", "action", "intent", "entity", "word_dist", "char_dist", "slu")


@query(
    "sentence_accuracy",
    "F33",
    f"""WITH s AS (SELECT conv_id, turn, lower(text) AS ref, CASE WHEN turn % 3 = 0 THEN lower(text) || ' 7' WHEN turn % 3 = 1 THEN replace(lower(text), ' ', '  ') ELSE lower(text) || ' x' END AS pred FROM conversations WHERE role <> 'system'),
    j AS (SELECT *, regexp_replace(ref, '\\D', '', 'g') = regexp_replace(pred, '\\D', '', 'g') OR regexp_replace(ref || ' alt', '\\D', '', 'g') = regexp_replace(pred, '\\D', '', 'g') AS d,
      translate(ref, '_ ', '') = translate(pred, '_ ', '') OR translate(ref || ' alt', '_ ', '') = translate(pred, '_ ', '') AS same, len({ansi.words('ref')}) AS n, turn % 3 AS k FROM s)
    SELECT count(*) AS sentences, CAST(count(*) FILTER (WHERE d AND same) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE NOT d) AS BIGINT) AS digit_errors, CAST(count(*) FILTER (WHERE d AND NOT same) AS BIGINT) AS other_errors,
    round(sum(CASE WHEN k = 1 THEN 0 ELSE 1 END) / sum(n), 6) AS wer FROM j""",
)
def _(t):
    low = F.lower("text")
    k = F.col("turn") % 3
    pred = F.when(k == 0, F.concat(low, F.lit(" 7"))).when(k == 1, F.replace(low, F.lit(" "), F.lit("  "))).otherwise(F.concat(low, F.lit(" x")))
    rows = t.conversations.select("role", pred.alias("pred"), F.array(F.concat(low, F.lit(" alt")), low).alias("refs"))
    return rounded(dg.sentence_accuracy(rows, "pred", "refs", skip=F.col("role") == "system"), "wer")


@query(
    "class_accuracy",
    "F34 C20",
    f"""SELECT lang AS cls, count(*) AS spans, CAST(count(*) FILTER (WHERE len({ansi.words('text')}) < 100) AS BIGINT) AS correct,
    round(avg(CASE WHEN len({ansi.words('text')}) < 100 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM documents GROUP BY 1""",
)
def _(t):
    toks = words("text")
    rows = t.documents.select("lang", toks.alias("tokens"))
    tags = F.transform("tokens", lambda w, i: F.when(i == 99, F.lit("<DELETE>")).otherwise(F.lit("<SELF>")))
    rows = rows.select("lang", "tokens", tags.alias("tags"), F.array_join("tokens", " ").alias("ref"))
    return rounded(dg.class_accuracy(rows, "lang", "tokens", "tags", "ref"), "accuracy")


@query(
    "average_lagging",
    "F35",
    with_views(ansi.LINES)
    + f""", w AS (SELECT doc_id, pos, len({ansi.words('utt')}) AS n FROM utterances), x AS (SELECT *, n * 0.4::DOUBLE AS dur FROM w WHERE n > 0),
    e AS (SELECT doc_id, pos, n, dur, i, least((i + 1) * 0.5::DOUBLE, dur) AS d FROM (SELECT *, unnest(range(n)) AS i FROM x)),
    c AS (SELECT *, count(*) FILTER (WHERE d < dur) OVER (PARTITION BY doc_id, pos) + 1 AS tau FROM e)
    SELECT doc_id, pos, round(avg(d - i * dur / (n + 1)), 6) AS lag FROM c WHERE i < tau GROUP BY 1, 2""",
)
def _(t):
    rows = views.utterances(t.documents).filter(~is_blank("utt")).select("doc_id", "pos", words("utt").alias("w"))
    delays = F.transform("w", lambda w, i: (i + 1) * F.lit(0.5))
    lag = dg.average_lagging(delays, F.size("w") * F.lit(0.4), F.size("w") + 1)
    return rounded(rows.select("doc_id", "pos", lag.alias("lag")), "lag")


def punctuated(t):
    """Hypotheses with other marks: no commas in even turns, exclamation marks for stops in odd ones."""
    h = F.when(F.col("turn") % 2 == 0, F.translate("text", ",", "")).otherwise(F.translate("text", ".", "!"))
    return t.conversations.select("text", h.alias("hyp"))


MARKS = (
    f"w AS (SELECT turn, unnest({ansi.words('text')}) AS w FROM conversations), "
    "m AS (SELECT turn, regexp_extract(w, '([.,!?])[.,!?]*$', 1) AS r, regexp_extract(CASE WHEN turn % 2 = 0 THEN replace(w, ',', '') ELSE replace(w, '.', '!') END, '([.,!?])[.,!?]*$', 1) AS h FROM w), "
    "o AS (SELECT CASE WHEN r = '' THEN h ELSE r END AS mark, CASE WHEN r = h THEN 'c' WHEN h = '' THEN 'd' WHEN r = '' THEN 'i' ELSE 's' END AS op FROM m WHERE r <> '' OR h <> ''), "
    "t AS (SELECT mark, CAST(count(*) FILTER (WHERE op = 'c') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE op = 'd') AS BIGINT) AS deletions, CAST(count(*) FILTER (WHERE op = 'i') AS BIGINT) AS insertions, CAST(count(*) FILTER (WHERE op = 's') AS BIGINT) AS substitutions FROM o GROUP BY 1)"
)


@query("punctuation_operations", "F36", f"WITH {MARKS} SELECT * FROM t")
def _(t):
    return dg.punctuation_operations(punctuated(t), "text", "hyp")


@query(
    "punctuation_error_rate",
    "F36",
    f"""WITH {MARKS}, s AS (SELECT sum(correct) AS c, sum(deletions) AS d, sum(insertions) AS i, sum(substitutions) AS s FROM t)
    SELECT round(c / (c + d + i + s), 6) AS correct_rate, round(d / (c + d + i + s), 6) AS deletions_rate, round(i / (c + d + i + s), 6) AS insertions_rate, round(s / (c + d + i + s), 6) AS substitutions_rate,
    round((d + i + s) / (c + d + i + s), 6) AS punct_er FROM s""",
)
def _(t):
    out = dg.punctuation_error_rate(dg.punctuation_operations(punctuated(t), "text", "hyp"))
    return rounded(out, *out.columns)
