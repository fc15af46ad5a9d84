"""Dialogue, multiple-choice, spoken-language-understanding and normalisation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.bags import bag_overlap
from weftline.functions.edit import align_words, filler_distance, lcs_length, word_distance
from weftline.functions.seeded import seeded_int
from weftline.functions.text import apply_tags, extract_choice, words


def choice_report(df: DataFrame, pred: str, truth: Column, id_cols: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """Multiple-choice accuracy. Empty answers are wrong, failed extractions guess by seed, rows
    without truth are skipped (and wrong); all count in the denominator."""
    guess = F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (seeded_int(seed, *id_cols) % 4 + 1).cast("int"))
    rows = df.withColumn("_t", truth).withColumn("_empty", F.trim(pred) == "").withColumn("_c", extract_choice(F.trim(pred)))
    failed = ~F.col("_empty") & F.col("_c").isNull()
    right = ~F.col("_empty") & (F.coalesce("_c", guess) == F.col("_t"))
    total = F.count(F.lit(1))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy(*(by or [])).agg(
        total.alias("num_samples"),
        count(right).alias("num_correct"),
        count(F.col("_empty")).alias("num_empty"),
        count(failed).alias("num_failed"),
        count(~F.col("_empty") & F.col("_t").isNull()).alias("num_skipped"),
        (count(right) / total).alias("acc"),
    )


def turn_taking(steps: DataFrame, keys: list[str], step: str, is_end: Column, is_start: Column, by: list[str], tolerance: int = 13, seconds: float = 0.08) -> DataFrame:
    """First end-of-speech step against first start-of-speech step per sequence.

    No end: the sequence is skipped; no start: it fails; within ``tolerance`` steps: it succeeds and
    its latency counts. Rows are aggregated directly, not batch means.
    """
    seq = steps.groupBy(*keys).agg(F.min(F.when(is_end, F.col(step))).alias("_e"), F.min(F.when(is_start, F.col(step))).alias("_s"))
    gap = F.col("_s") - F.col("_e")
    ok = F.coalesce(F.abs(gap) <= tolerance, F.lit(False))
    return seq.filter(F.col("_e").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("turns"),
        F.avg(ok.cast("double")).alias("accuracy"),
        F.coalesce(F.avg(F.when(ok, gap * seconds)), F.lit(0.0)).alias("latency"),
    )


# ---------------------------------------------------------------- dialogue state

def fuzzy_ratio(df: DataFrame, ref: str, hyp: str, out: str) -> DataFrame:
    """Token-sort similarity in [0, 1]: twice the common subsequence over the summed lengths."""
    chars = lambda c: F.filter(F.split(F.array_join(F.array_sort(words(F.lower(c))), " "), ""), lambda x: x != "")
    rows = df.withColumn("_a", chars(ref)).withColumn("_b", chars(hyp))
    total = F.size("_a") + F.size("_b")
    return rows.withColumn(out, F.when(total > 0, F.round(200.0 * lcs_length("_a", "_b") / total) / 100).otherwise(F.lit(1.0))).drop("_a", "_b")


def slot_correctness(slots: DataFrame, score: Column | None = None) -> DataFrame:
    """Per slot (ref array or null, hyp or null, categorical): correctness, status and value scores.

    ``score`` replaces exact match for non-categorical slots (best over the references).
    """
    active, answered = F.col("ref").isNotNull(), F.col("hyp").isNotNull()
    exact = F.when(F.col("categorical"), F.get("ref", F.lit(0)) == F.col("hyp")).otherwise(F.array_contains("ref", F.col("hyp"))).cast("double")
    match = exact if score is None else F.when(F.col("categorical"), exact).otherwise(score)
    return slots.withColumns(
        {
            "active": active,
            "cor": F.when(active & answered, match).when(active | answered, F.lit(0.0)).otherwise(F.lit(1.0)),
            "status": F.when(active == answered, F.lit(1.0)).otherwise(F.lit(0.0)),
            "value": F.when(active & answered, match),
        }
    )


def goal_accuracy(scored: DataFrame, frame: list[str]) -> DataFrame:
    """Average and joint goal accuracy per frame over all, categorical and other slots, with the
    status and value variants. Undefined cells are null and drop out of later means."""
    kinds = {"all": F.lit(True), "cat": F.col("categorical"), "noncat": ~F.col("categorical")}
    aggs = []
    for k, hit in kinds.items():
        aggs.append(F.avg(F.when(hit & F.col("active"), F.col("cor"))).alias(f"average_{k}"))
        aggs.append(F.product(F.when(hit, F.col("cor"))).alias(f"joint_{k}"))
        if k != "all":
            aggs.append(F.avg(F.when(hit & F.col("active"), F.col("status"))).alias(f"average_{k}_status"))
            aggs.append(F.product(F.when(hit, F.col("status"))).alias(f"joint_{k}_status"))
            aggs.append(F.avg(F.when(hit, F.col("value"))).alias(f"average_{k}_value"))
            aggs.append(F.product(F.when(hit, F.col("value"))).alias(f"joint_{k}_value"))
    return scored.groupBy(*frame).agg(*aggs)


def list_f1(ref: Column, hyp: Column) -> dict[str, Column]:
    """Multiset precision, recall and F1; an empty side has precision or recall 1."""
    both = bag_overlap(ref, hyp)
    p = F.when(F.size(hyp) > 0, both / F.size(hyp)).otherwise(F.lit(1.0))
    r = F.when(F.size(ref) > 0, both / F.size(ref)).otherwise(F.lit(1.0))
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


# ---------------------------------------------------------------- spoken language understanding

def understanding_report(df: DataFrame) -> DataFrame:
    """Scenario, action and intent F1, entity span F1, word and character distance F1, and the
    harmonic mean of the last two.

    Columns: ``scenario``/``action``/``entities`` and ``pred_*`` twins; entities are arrays of
    (type, filler); ``invalid`` marks predictions that did not parse. A gold entity meets the nearest
    predicted filler of its type: one true positive, its distance (at most 1) in both error counts.
    """
    tagged = lambda c: F.transform(c, lambda e: F.concat_ws("\u0001", e["type"], e["filler"]))

    def distances(kind: str) -> Column:
        def of(g: Column, p: Column) -> Column:
            if kind == "word":
                a, b = words(g["filler"]), words(p["filler"])
                return F.least(filler_distance(a, b) / F.greatest(F.size(a), F.lit(1)), F.lit(1.0))
            return F.least(F.levenshtein(g["filler"], p["filler"]) / F.greatest(F.length(g["filler"]), F.lit(1)), F.lit(1.0))

        return F.transform(
            "entities",
            lambda g: F.array_min(F.transform(F.filter("pred_entities", lambda p: p["type"] == g["type"]), lambda p: of(g, p))),
        )

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    stray = F.size(F.filter("pred_entities", lambda p: ~F.exists("entities", lambda g: g["type"] == p["type"])))
    rows = df.select(
        F.col("invalid").cast("long").alias("invalid"),
        (F.col("scenario") == F.col("pred_scenario")).cast("double").alias("scenario"),
        (F.col("action") == F.col("pred_action")).cast("double").alias("action"),
        ((F.col("scenario") == F.col("pred_scenario")) & (F.col("action") == F.col("pred_action"))).cast("double").alias("intent"),
        bag_overlap(tagged("entities"), tagged("pred_entities")).alias("hit"),
        F.size("entities").alias("gold"),
        F.size("pred_entities").alias("pred"),
        distances("word").alias("dw"),
        distances("char").alias("dc"),
        stray.alias("stray"),
    )
    found = F.size(F.filter("dw", lambda x: x.isNotNull()))
    rows = rows.select("*", found.alias("found"), total("dw").alias("w"), total("dc").alias("c"))
    s = rows.agg(
        F.count(F.lit(1)).alias("total"), F.sum("invalid").alias("invalid"),
        *[F.avg(x).alias(x) for x in ("scenario", "action", "intent")],
        *[F.sum(x).alias(x) for x in ("hit", "gold", "pred", "found", "w", "c", "stray")],
    )

    def dist_f1(err: str) -> Column:
        fp, fn = F.col("stray") + F.col(err), F.col("gold") - F.col("found") + F.col(err)
        return 2 * F.col("found") / (2 * F.col("found") + fp + fn)

    wf, cf = dist_f1("w"), dist_f1("c")
    return s.select(
        "total", "invalid", "scenario", "action", "intent",
        (2 * F.col("hit") / (F.col("gold") + F.col("pred"))).alias("entity"),
        wf.alias("word_dist"), cf.alias("char_dist"), (2 * wf * cf / (wf + cf)).alias("slu"),
    )


# ---------------------------------------------------------------- text normalisation

def sentence_accuracy(df: DataFrame, pred: str, refs: str, skip: Column | None = None) -> DataFrame:
    """Sentence accuracy against several references, digit errors and other errors, plus WER
    against the last reference. ``skip`` excludes sentences with unwanted classes."""
    if skip is not None:
        df = df.filter(~skip)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    dense = lambda c: F.translate(c, "_ ", "")
    p = F.lower(pred)
    digit_ok = F.exists(refs, lambda r: digits(r) == digits(p))
    same = F.exists(refs, lambda r: dense(r) == dense(p))
    last = words(F.element_at(refs, -1))
    rows = df.select(
        digit_ok.alias("d"), same.alias("s"), word_distance(last, words(p)).alias("e"), F.size(last).alias("n")
    )
    n = F.count(F.lit(1))
    part = lambda c: F.sum(c.cast("long"))
    right, wrong = part(F.col("d") & F.col("s")), part(~F.col("d"))
    return rows.agg(
        n.alias("sentences"), right.alias("correct"), wrong.alias("digit_errors"), (n - right - wrong).alias("other_errors"),
        (F.sum("e") / F.sum("n")).alias("wer"),
    )


def class_accuracy(df: DataFrame, cls: str, tokens: str, tags: str, ref: str) -> DataFrame:
    """Spans per class whose applied tags give the reference."""
    ok = (apply_tags(F.col(tokens), F.col(tags)) == F.col(ref)).cast("long")
    return df.groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("spans"), F.sum(ok).alias("correct"), F.avg(ok.cast("double")).alias("accuracy"))


def average_lagging(delays: Column, duration: Column, n_ref: Column) -> Column:
    """Length-adaptive average lagging of one sample.

    ``delays``: seconds after which each word was out, capped at the duration. The mean runs over the
    words up to the first one that came out at the end; the ideal pace is duration / max(ref, hyp).
    """
    capped = F.transform(delays, lambda d: F.least(d, duration))
    at_end = F.size(F.filter(capped, lambda d: d < duration)) + 1
    used = F.slice(capped, F.lit(1), F.least(at_end, F.size(capped)))
    pace = duration / F.greatest(F.size(delays), n_ref)
    lag = F.transform(used, lambda d, i: d - i * pace)
    return F.when(F.size(delays) > 0, F.aggregate(lag, F.lit(0.0), lambda a, x: a + x) / F.size(used))


# ---------------------------------------------------------------- punctuation

def punctuation_operations(df: DataFrame, ref: str, hyp: str, marks: str = ".,!?") -> DataFrame:
    """Correct, deleted, inserted and substituted marks, per mark.

    Words without their trailing mark are aligned; the marks of aligned words are compared.
    Substitutions count for the reference mark.
    """
    cls = "[" + "".join("\\" + m for m in marks) + "]"
    bare = lambda c: F.transform(words(c), lambda w: F.lower(F.regexp_replace(w, f"{cls}+$", "")))
    mark = lambda c: F.transform(words(c), lambda w: F.regexp_extract(w, f"({cls}){cls}*$", 1))
    rows = df.select(bare(ref).alias("a"), bare(hyp).alias("b"), mark(ref).alias("ma"), mark(hyp).alias("mb"))
    pairs = rows.select("ma", "mb", F.explode(align_words("a", "b")).alias("p"))
    of = lambda m, k: F.when(F.col(f"p.{k}") >= 0, F.get(m, F.col(f"p.{k}"))).otherwise(F.lit(""))
    seen = pairs.select(of("ma", "i").alias("r"), of("mb", "j").alias("h")).filter((F.col("r") != "") | (F.col("h") != ""))
    op = F.when(F.col("r") == F.col("h"), "correct").when(F.col("h") == "", "deletions").when(F.col("r") == "", "insertions").otherwise("substitutions")
    return (
        seen.select(F.when(F.col("r") == "", F.col("h")).otherwise(F.col("r")).alias("mark"), op.alias("op"))
        .groupBy("mark")
        .agg(*[F.sum((F.col("op") == o).cast("long")).alias(o) for o in ("correct", "deletions", "insertions", "substitutions")])
    )


def punctuation_error_rate(operations: DataFrame) -> DataFrame:
    """Overall rates: every operation over all of them."""
    names = ("correct", "deletions", "insertions", "substitutions")
    total = sum((F.sum(n) for n in names), F.lit(0))
    rates = operations.agg(*[(F.sum(n) / total).alias(f"{n}_rate") for n in names])
    return rates.withColumn("punct_er", F.col("deletions_rate") + F.col("insertions_rate") + F.col("substitutions_rate"))
