"""Score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import clean_label, is_blank, words
from weftline.metrics import calibration as cal
from weftline.metrics import classify as cl
from weftline.metrics import errors as er
from weftline.metrics import overlap as ov
from weftline.operators import filters as fl
from weftline.plans import ansi
from weftline.plans.ansi import PAIR_ERRORS, PAIRS, PRED, with_views
from weftline.plans.catalog import query
from weftline.sources import views


def rounded(df, *cols, digits: int = 6):
    """Fixed digits for comparison; infinities become null."""
    return df.withColumns(
        {c: F.when(F.abs(F.col(c)) < float("inf"), F.round(F.col(c), digits)) for c in cols}
    )


SLOTS = [(0, 5), (5, 15), (15, None)]
SLOT_SQL = "CASE WHEN len(r) < 5 THEN '[0,5)' WHEN len(r) < 15 THEN '[5,15)' ELSE '[15,inf)' END"


@query(
    "scored_evaluation",
    "F2 F6 F7",
    with_views(PAIRS, f"s AS (SELECT lang, {SLOT_SQL} AS slot, {PAIR_ERRORS} AS e, len(r) AS n FROM pairs)")
    + """SELECT CASE WHEN grouping(lang) = 0 THEN 'target' WHEN grouping(slot) = 0 THEN 'slot' ELSE 'all' END AS level,
    coalesce(lang, slot) AS value, count(*) AS rows, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS tokens,
    round(sum(e) / sum(n), 6) AS wer FROM s GROUP BY GROUPING SETS ((lang), (slot), ())""",
)
def _(t):
    scored = er.score_words(views.pairs_view(t.documents))
    slot = er.slot_label(F.size("r"), SLOTS)
    return rounded(er.grouped_error_rate(scored, "lang", slot), "wer")


@query(
    "word_errors",
    "F1 F4",
    with_views(PAIRS)
    + f"SELECT doc_id, pos, CAST({PAIR_ERRORS} AS BIGINT) AS errors, CAST(len(r) AS BIGINT) AS tokens, round({PAIR_ERRORS} / len(r), 6) AS wer FROM pairs",
)
def _(t):
    out = er.row_error_rate(views.pairs_view(t.documents))
    return rounded(out.select("doc_id", "pos", "errors", "tokens", "wer"), "wer")


@query(
    "char_errors",
    "F1",
    with_views(PAIRS)
    + "SELECT doc_id, pos, levenshtein(array_to_string(r, ' '), array_to_string(h, ' ')) AS char_errors, length(array_to_string(r, ' ')) AS chars FROM pairs",
)
def _(t):
    return er.score_chars(views.pairs_view(t.documents)).select("doc_id", "pos", "char_errors", "chars")


@query(
    "error_detail",
    "F3",
    with_views(PAIRS, f"s AS (SELECT source, len(r) AS n, {ansi.MISSING} AS d, {ansi.EXTRA} AS i, {ansi.UNKNOWN_WORDS} AS s FROM pairs)")
    + """SELECT source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(d + i + s) AS BIGINT) AS errors, CAST(sum(i) AS BIGINT) AS insertions,
    CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(s) AS BIGINT) AS substitutions, round(sum(d + i + s) / sum(n), 6) AS wer,
    round(sum(i) / sum(n), 6) AS ins_rate, round(sum(d) / sum(n), 6) AS del_rate, round(sum(s) / sum(n), 6) AS sub_rate FROM s GROUP BY 1""",
)
def _(t):
    out = er.detail_totals(er.error_detail(views.pairs_view(t.documents)), ["source"])
    return rounded(out, "wer", "ins_rate", "del_rate", "sub_rate")


def _normal_pairs() -> str:
    plain = "lower(regexp_replace(utt, '[^ -~]', '', 'g'))"
    return PAIRS.replace(ansi.words(plain), ansi.words(ansi.clean_label_sql(plain)))


@query(
    "scored_manifest",
    "F5",
    with_views(_normal_pairs(), f"s AS (SELECT doc_id, pos, len(r) AS n, {ansi.MISSING} AS d, {ansi.EXTRA} AS i, {ansi.UNKNOWN_WORDS} AS s FROM pairs)")
    + """SELECT doc_id, pos, CAST(n AS BIGINT) AS tokens, CAST(d + i + s AS BIGINT) AS errors, round((d + i + s) / n, 6) AS wer, round(i / n, 6) AS ins_rate,
    round(d / n, 6) AS del_rate, round(s / n, 6) AS sub_rate FROM s""",
)
def _(t):
    pairs = views.pairs_view(t.documents, clean_label)
    clean = pairs.withColumns({c: words(clean_label(F.array_join(c, " "))) for c in ("r", "h")})
    out = er.error_detail(clean).select("doc_id", "pos", "tokens", "errors", "wer", "ins_rate", "del_rate", "sub_rate")
    return rounded(out, "wer", "ins_rate", "del_rate", "sub_rate")


SEGMENTS = (
    "t AS (SELECT doc_id, pos, r, h, array_to_string(r, ' ') AS a, array_to_string(h, ' ') AS b FROM pairs), "
    f"seg AS (SELECT doc_id, pos, {PAIR_ERRORS} / len(r) * 100 AS wer, levenshtein(a, b) / length(a) * 100 AS cer, "
    "levenshtein(a[1:5], b[1:5]) / 5 * 100 AS start_cer, levenshtein(right(a, 5), right(b, 5)) / 5 * 100 AS end_cer, "
    "abs(len(r) - len(h)) / len(r) AS len_diff_ratio, length(a) / 15.0 AS duration FROM t)"
)


@query(
    "segment_metrics",
    "F8",
    with_views(PAIRS, SEGMENTS)
    + "SELECT doc_id, pos, round(wer, 6) AS wer, round(cer, 6) AS cer, start_cer, end_cer, round(len_diff_ratio, 6) AS len_diff_ratio FROM seg",
)
def _(t):
    out = er.segment_metrics(views.pairs_view(t.documents)).drop("lang", "source", "r", "h")
    return rounded(out, "wer", "cer", "len_diff_ratio")


@query(
    "filter_segments",
    "B9",
    with_views(PAIRS, SEGMENTS)
    + """SELECT count(*) AS segments, round(sum(duration) / 3600, 6) AS hours FROM seg WHERE cer <= 30 AND wer <= 75
    AND start_cer <= 60 AND end_cer <= 60 AND len_diff_ratio <= 0.3 AND duration > 1 AND duration < 20""",
)
def _(t):
    seg = er.segment_metrics(views.pairs_view(t.documents)).withColumn(
        "duration", F.length(F.array_join("r", " ")) / 15.0
    )
    return fl.filter_segments(seg).agg(
        F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration") / 3600, 6).alias("hours")
    )


@query(
    "dataset_error_rates",
    "F10 F37",
    with_views(
        PAIRS,
        f"s AS (SELECT lang AS name, sum({PAIR_ERRORS}) / sum(len(r)) AS wer, sum(levenshtein(array_to_string(r, ' '), array_to_string(h, ' '))) / sum(length(array_to_string(r, ' '))) AS cer FROM pairs GROUP BY 1)",
    )
    + "SELECT name, round(wer, 6) AS wer, round(cer, 6) AS cer FROM s UNION ALL SELECT 'mean', round(avg(wer), 6), round(avg(cer), 6) FROM s",
)
def _(t):
    scored = er.score_chars(er.score_words(views.pairs_view(t.documents)))
    return rounded(er.dataset_error_rates(scored, "lang"), "wer", "cer")


def _bleu_sql() -> str:
    grams = ", ".join(
        f"""m{n} AS (SELECT lang, doc_id, pos, g, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1 FROM (
        SELECT lang, doc_id, pos, 0 AS side, unnest(list_transform(range(1, len(r) - {n - 1} + 1), lambda i_: array_to_string(r[i_:i_ + {n - 1}], ' '))) AS g FROM pairs
        UNION ALL SELECT lang, doc_id, pos, 1, unnest(list_transform(range(1, len(h) - {n - 1} + 1), lambda i_: array_to_string(h[i_:i_ + {n - 1}], ' '))) FROM pairs) GROUP BY ALL),
        s{n} AS (SELECT lang, sum(least(c0, c1)) AS m, sum(c1) AS t FROM m{n} GROUP BY 1)"""
        for n in range(1, 5)
    )
    logs = " + ".join(f"ln(s{n}.m / s{n}.t)" for n in range(1, 5))
    joins = " ".join(f"JOIN s{n} ON s{n}.lang = l.lang" for n in range(1, 5))
    return with_views(
        PAIRS,
        grams,
        "l AS (SELECT lang, sum(len(r)) AS rl, sum(len(h)) AS hl FROM pairs GROUP BY 1)",
        f"b AS (SELECT l.lang AS name, 100 * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * exp(({logs}) / 4) AS bleu FROM l {joins})",
    ) + "SELECT name, round(bleu, 6) AS bleu FROM b UNION ALL SELECT 'mean', round(avg(bleu), 6) FROM b"


@query("corpus_bleu", "F9", _bleu_sql())
def _(t):
    return rounded(ov.corpus_bleu(views.pairs_view(t.documents), F.col("r"), F.col("h"), "lang"), "bleu")


def _grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({x}) - {n - 1} + 1, 1)), lambda i_: array_to_string({x}[i_:i_ + {n - 1}], ' '))"


@query(
    "rouge",
    "F11",
    with_views(
        PAIRS,
        f"g AS (SELECT doc_id, pos, lang, 1 AS n, 0 AS side, unnest({_grams('r', 1)}) AS g FROM pairs UNION ALL SELECT doc_id, pos, lang, 1, 1, unnest({_grams('h', 1)}) FROM pairs "
        f"UNION ALL SELECT doc_id, pos, lang, 2, 0, unnest({_grams('r', 2)}) FROM pairs UNION ALL SELECT doc_id, pos, lang, 2, 1, unnest({_grams('h', 2)}) FROM pairs)",
        "c AS (SELECT doc_id, pos, lang, n, g, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM g GROUP BY ALL)",
        "f AS (SELECT doc_id, pos, lang, n, CASE WHEN sum(least(a, b)) > 0 THEN 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) ELSE 0 END AS f FROM c GROUP BY 1, 2, 3, 4)",
        # the hypothesis is a subsequence of the reference but for the unknown and added words
        f"l AS (SELECT doc_id, pos, lang, CASE WHEN len(h) = 0 THEN 0.0 ELSE 2.0 * {ansi.HEARD} / (len(r) + len(h)) END AS f FROM pairs)",
        "p AS (SELECT q.lang, 100 * avg(coalesce(f1.f, 0)) AS rouge1, 100 * avg(coalesce(f2.f, 0)) AS rouge2, 100 * avg(l.f) AS rougeL FROM pairs q "
        "LEFT JOIN f f1 ON f1.doc_id = q.doc_id AND f1.pos = q.pos AND f1.n = 1 LEFT JOIN f f2 ON f2.doc_id = q.doc_id AND f2.pos = q.pos AND f2.n = 2 "
        "JOIN l ON l.doc_id = q.doc_id AND l.pos = q.pos GROUP BY 1)",
    )
    + 'SELECT lang, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS "rougeL" FROM p',
)
def _(t):
    pairs = views.pairs_view(t.documents)
    # the second reference shares no word with the hypothesis, so the first is the best
    scored = ov.rouge(pairs, F.array(F.col("r"), F.array(F.lit("\u0002"))), F.col("h"))
    out = scored.groupBy("lang").agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])
    return rounded(out, "rouge1", "rouge2", "rougeL")


ANSWERS = (
    "ans AS (SELECT conv_id, turn, " + ansi.normal_answer("src") + " AS a, " + ansi.normal_answer("tgt") + " AS b FROM turns), "
    "tok AS (SELECT conv_id, turn, 0 AS side, unnest(" + ansi.words("a") + ") AS w FROM ans UNION ALL "
    "SELECT conv_id, turn, 1, unnest(" + ansi.words("b") + ") FROM ans), "
    "cnt AS (SELECT conv_id, turn, w, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM tok GROUP BY ALL), "
    "sc AS (SELECT conv_id, turn, CASE WHEN sum(least(x, y)) > 0 THEN 2.0 * sum(least(x, y)) / (sum(x) + sum(y)) ELSE 0 END AS f FROM cnt GROUP BY 1, 2)"
)


@query(
    "answer_scores",
    "F12 S3",
    with_views(ansi.TURNS, ANSWERS)
    + "SELECT a.conv_id, a.turn, CASE WHEN a.a = a.b THEN 1.0::DOUBLE ELSE 0.0 END AS exact, round(f, 6)::DOUBLE AS f1 FROM ans a JOIN sc USING (conv_id, turn)",
)
def _(t):
    exact, f1 = ov.answer_scores(F.col("tgt"), F.array("src"))
    out = views.turn_pairs(t.conversations).select("conv_id", "turn", exact.alias("exact"), f1.alias("f1"))
    return rounded(out, "f1")


@query(
    "qa_report",
    "F13",
    with_views(
        "j AS (SELECT conv_id, turn, " + ansi.normal_answer("text") + " AS b, CASE WHEN turn % 3 = 0 THEN '' ELSE " + ansi.normal_answer("lag_text") + " END AS a, turn % 3 <> 0 AS has FROM "
        "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_text FROM conversations) WHERE lag_text IS NOT NULL)",
        "tok AS (SELECT conv_id, turn, 0 AS side, unnest(" + ansi.words("a") + ") AS w FROM j UNION ALL SELECT conv_id, turn, 1, unnest(" + ansi.words("b") + ") FROM j)",
        "cnt AS (SELECT conv_id, turn, w, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM tok GROUP BY ALL)",
        "sc AS (SELECT conv_id, turn, CASE WHEN sum(least(x, y)) > 0 THEN 2.0 * sum(least(x, y)) / (sum(x) + sum(y)) ELSE 0 END AS f FROM cnt GROUP BY 1, 2)",
        "r AS (SELECT has, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN a = '' OR b = '' THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END ELSE f END AS f1 FROM j LEFT JOIN sc USING (conv_id, turn))",
    )
    + """SELECT CASE WHEN grouping(has) = 1 THEN 'all' WHEN has THEN 'has_answer' ELSE 'no_answer' END AS subset, count(*) AS questions,
    round(100 * avg(exact), 6)::DOUBLE AS exact, round(100 * avg(f1), 6)::DOUBLE AS f1 FROM r GROUP BY GROUPING SETS ((has), ())""",
)
def _(t):
    from pyspark.sql import Window

    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("prev", prev).filter(F.col("prev").isNotNull())
    has = F.col("turn") % 3 != 0
    golds = F.when(has, F.array("prev")).otherwise(F.array().cast("array<string>"))
    exact, f1 = ov.answer_scores(F.col("text"), golds)
    out = ov.qa_report(rows.select(has.alias("has"), exact.alias("exact"), f1.alias("f1")), "has")
    return rounded(out, "exact", "f1")


@query(
    "exact_match",
    "F14",
    with_views(PRED)
    + "SELECT coalesce(lang, 'all') AS category, count(*) AS rows, round(100 * avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS exact_match FROM pred GROUP BY GROUPING SETS ((lang), ())",
)
def _(t):
    out = cl.exact_match(views.prediction_view(t.labels, t.documents), F.col("truth") == F.col("pred"), "lang")
    return rounded(out, "exact_match")


def _report_sql(cells: str) -> str:
    return (
        cells
        + """, labels_ AS (SELECT t AS label FROM cells UNION SELECT p FROM cells),
    per AS (SELECT CAST(label AS VARCHAR) AS label, coalesce((SELECT sum(n) FROM cells WHERE t = label AND p = label), 0) AS tp,
      coalesce((SELECT sum(n) FROM cells WHERE t = label AND p <> label), 0) AS fn,
      coalesce((SELECT sum(n) FROM cells WHERE t <> label AND p = label), 0) AS fp FROM labels_),
    prf AS (SELECT *, tp * 100.0 / (tp + fp + 1e-8) AS pr, tp * 100.0 / (tp + fn + 1e-8) AS re, tp + fn AS sup FROM per),
    cls AS (SELECT label, pr, re, 2 * pr * re / (pr + re + 1e-8) AS f1, sup, tp, fp, fn FROM prf),
    tot AS (SELECT sum(tp) * 100.0 / (sum(tp) + sum(fp) + 1e-8) AS pr, sum(tp) * 100.0 / (sum(tp) + sum(fn) + 1e-8) AS re, sum(sup) AS sup FROM cls),
    u AS (SELECT label, pr, re, f1, sup FROM cls UNION ALL SELECT 'micro', pr, re, 2 * pr * re / (pr + re + 1e-8), sup FROM tot
      UNION ALL SELECT 'macro', sum(pr) / count(*) FILTER (WHERE sup > 0), sum(re) / count(*) FILTER (WHERE sup > 0), sum(f1) / count(*) FILTER (WHERE sup > 0), sum(sup) FROM cls
      UNION ALL SELECT 'weighted', sum(pr * sup) / sum(sup), sum(re * sup) / sum(sup), sum(f1 * sup) / sum(sup), sum(sup) FROM cls)
    SELECT label, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, CAST(sup AS BIGINT) AS support FROM u"""
    )


@query(
    "classification_report",
    "F16",
    _report_sql(with_views(PRED, "cells AS (SELECT truth AS t, pred AS p, count(*) AS n FROM pred GROUP BY 1, 2)")),
)
def _(t):
    out = cl.classification_report(views.prediction_view(t.labels, t.documents), "truth", "pred")
    return rounded(out, "precision", "recall", "f1")


def _detect_sql() -> str:
    from weftline.plans.filtering import _language_sql

    return _language_sql("text")


@query(
    "language_report",
    "F16 B8",
    _report_sql(
        f"WITH cells AS (SELECT lang AS t, coalesce(detected, 'none') AS p, count(*) AS n FROM ({_detect_sql()}) GROUP BY 1, 2)"
    ),
)
def _(t):
    docs = t.documents.select("lang", F.coalesce(fl.detect_language("text"), F.lit("none")).alias("found"))
    return rounded(cl.classification_report(docs, "lang", "found"), "precision", "recall", "f1")


@query(
    "multi_label_report",
    "F16",
    with_views(
        PRED,
        "x AS (SELECT 'quality' AS label, truth AS t, pred AS p FROM pred UNION ALL SELECT 'toxic', toxic, 1 - pred FROM pred)",
        "s AS (SELECT label, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM x GROUP BY 1)",
        "q AS (SELECT label, tp * 100.0 / (tp + fp + 1e-8) AS pr, tp * 100.0 / (tp + fn + 1e-8) AS re FROM s)",
    )
    + "SELECT label, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(2 * pr * re / (pr + re + 1e-8), 6)::DOUBLE AS f1 FROM q",
)
def _(t):
    pred = views.prediction_view(t.labels, t.documents)
    out = cl.multi_label_report(
        pred, {"quality": (F.col("truth"), F.col("pred")), "toxic": (F.col("toxic"), 1 - F.col("pred"))}
    )
    return rounded(out, "precision", "recall", "f1")


@query(
    "binary_f1",
    "F17",
    with_views(PRED, "s AS (SELECT sum(CASE WHEN score >= 0.5 THEN truth ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN 1 - truth ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 THEN truth ELSE 0 END) AS fn FROM pred)")
    + "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM s",
)
def _(t):
    return rounded(cl.binary_f1(views.prediction_view(t.labels, t.documents), F.col("truth"), F.col("score")), "f1")


@query(
    "unigram_perplexity",
    "F18",
    f"""WITH w AS (SELECT source, unnest({ansi.words('lower(text)')}) AS w FROM documents),
    g AS (SELECT w, count(*) AS c FROM w GROUP BY 1), tot AS (SELECT sum(c) AS n FROM g),
    d AS (SELECT source, w, count(*) AS k FROM w GROUP BY 1, 2)
    SELECT source, CAST(sum(k) AS BIGINT) AS tokens, round(exp(sum(k * -ln(c / n)) / sum(k)), 4) AS perplexity
    FROM d JOIN g USING (w), tot GROUP BY 1""",
)
def _(t):
    per = (
        t.documents.select("source", F.explode(words(F.lower("text"))).alias("w"))
        .groupBy("source", "w")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    vocab = per.groupBy("w").agg(F.sum("k").alias("c"))
    total = vocab.agg(F.sum("c")).first()[0]
    model = vocab.select("w", (-F.log(F.col("c") / total)).alias("nll"))
    scored = per.join(model, "w")
    return rounded(cl.perplexity(scored, F.col("k") * F.col("nll"), F.col("k"), ["source"]), "perplexity", digits=4)


@query(
    "weighted_loss",
    "F19",
    with_views(ansi.UTT) + "SELECT cls, round(sum(duration * num_tokens) / sum(num_tokens), 6) AS loss FROM utt GROUP BY 1",
)
def _(t):
    return rounded(cl.weighted_loss(views.manifest_view(t.events), F.col("duration"), F.col("num_tokens"), ["cls"]), "loss")


@query(
    "empty_rate",
    "F20",
    with_views(ansi.LINES, "p AS (SELECT lang AS name, count(*) AS rows, CAST(count(*) FILTER (WHERE trim(utt) = '') AS BIGINT) AS empty, avg(CASE WHEN trim(utt) = '' THEN 1.0 ELSE 0.0 END) AS rate FROM utterances GROUP BY 1)")
    + "SELECT name, rows, empty, round(rate, 6)::DOUBLE AS rate FROM p UNION ALL SELECT 'mean', CAST(sum(rows) AS BIGINT), CAST(sum(empty) AS BIGINT), round(avg(rate), 6)::DOUBLE FROM p",
)
def _(t):
    return rounded(cl.empty_rate(views.utterances(t.documents), "lang", is_blank("utt")), "rate")


@query(
    "mean_reciprocal_rank",
    "F23",
    """WITH b AS (SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS best FROM lineitem GROUP BY 1),
    r AS (SELECT l.l_orderkey, CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 / (1 + count(*) FILTER (WHERE l_extendedprice > best)) END AS rr
      FROM lineitem l JOIN b ON l.l_orderkey = b.l_orderkey GROUP BY l.l_orderkey, best)
    SELECT count(*) AS queries, round(avg(rr), 6)::DOUBLE AS mrr FROM r""",
)
def _(t):
    cand = t.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag")
    rr = cl.reciprocal_rank(cand, "l_orderkey", "l_extendedprice", F.col("l_returnflag") == "R")
    return rr.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(
    "ranking_areas",
    "F24",
    with_views(
        PRED,
        "s AS (SELECT score, sum(truth) AS pos, sum(1 - truth) AS neg FROM pred GROUP BY 1)",
        "c AS (SELECT *, sum(pos) OVER (ORDER BY score) AS pu, sum(neg) OVER (ORDER BY score) AS nu, sum(pos) OVER (ORDER BY score DESC) AS pd, sum(neg) OVER (ORDER BY score DESC) AS nd FROM s)",
    )
    + """SELECT round(sum(pos * (nu - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc_roc, round(sum(pos * pd / (pd + nd)) / sum(pos), 6) AS auc_pr,
    round(sum(neg * nu / (pu + nu)) / sum(neg), 6) AS auc_nt FROM c""",
)
def _(t):
    return rounded(cal.ranking_areas(views.prediction_view(t.labels, t.documents), "truth", "score"), "auc_roc", "auc_pr", "auc_nt")


@query(
    "normalized_cross_entropy",
    "F25",
    with_views(PRED, "c AS (SELECT truth, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS s FROM pred)",
    "m AS (SELECT avg(truth) AS p, -avg(truth * ln(s) + (1 - truth) * ln(1 - s)) AS loss FROM c)",
    "e AS (SELECT loss, -(ln(p + 1e-15) * p + ln(1 - p + 1e-15) * (1 - p)) AS h FROM m)")
    + "SELECT round((h - loss) / h, 6) AS nce FROM e",
)
def _(t):
    return rounded(cal.normalized_cross_entropy(views.prediction_view(t.labels, t.documents), "truth", "score"), "nce")


@query(
    "calibration_error",
    "F26",
    with_views(
        PRED,
        "bins AS (SELECT range AS m, range / 100.0::DOUBLE AS a, (range + 1) / 100.0::DOUBLE AS b FROM range(100))",
        "x AS (SELECT m, truth, CASE WHEN score >= (a + b) / 2 THEN 1 ELSE 0 END AS y, CASE WHEN score >= (a + b) / 2 THEN score ELSE 1 - score END AS v, a, b FROM pred, bins)",
        "g AS (SELECT m, count(*) AS n, sum(CASE WHEN y = truth THEN 1 ELSE 0 END) AS hit, sum(v) AS conf FROM x WHERE v > a AND v <= b GROUP BY 1)",
    )
    + "SELECT round(sum(abs(hit - conf)) / sum(n), 6) AS ece FROM g",
)
def _(t):
    return rounded(cal.calibration_error(views.prediction_view(t.labels, t.documents), "truth", "score"), "ece")


@query(
    "youden_curve",
    "F27",
    with_views(
        PRED,
        "th AS (SELECT range / 100.0::DOUBLE AS x FROM range(101))",
        "y AS (SELECT x, abs(sum(CASE WHEN truth = 0 AND score < x THEN 1 ELSE 0 END) / sum(1 - truth) - sum(CASE WHEN truth = 1 AND score < x THEN 1 ELSE 0 END) / sum(truth)) AS yc FROM pred, th GROUP BY 1)",
    )
    + "SELECT round(avg(yc), 6) AS auc_yc, round(stddev_pop(yc), 6) AS std_yc, round(max(yc), 6) AS max_yc FROM y",
)
def _(t):
    return rounded(cal.youden_curve(views.prediction_view(t.labels, t.documents), "truth", "score"), "auc_yc", "std_yc", "max_yc")


@query(
    "slot_scores",
    "F29",
    with_views(
        PAIRS,
        "d AS (SELECT lang, list_distinct(r) AS a, list_distinct(h) AS b FROM pairs)",
        "s AS (SELECT lang, len(list_intersect(a, b)) AS i, len(a) AS x, len(b) AS y FROM d)",
    )
    + """SELECT lang, round(100 * avg(CASE WHEN y > 0 THEN i / y ELSE 0 END), 6) AS precision, round(100 * avg(CASE WHEN x > 0 THEN i / x ELSE 0 END), 6) AS recall,
    round(100 * avg(CASE WHEN i > 0 THEN 2.0 * i / (x + y) ELSE 0 END), 6)::DOUBLE AS f1, round(100 * avg(CASE WHEN i = x AND i = y THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS joint FROM s GROUP BY 1""",
)
def _(t):
    s = ov.set_scores(F.col("r"), F.col("h"))
    out = views.pairs_view(t.documents).groupBy("lang").agg(*[(100 * F.avg(c)).alias(k) for k, c in s.items()])
    return rounded(out, *s)
