"""Word and character error rates.

Two layers: a per-row score made of integer counts, and a ratio of sums. The counts merge, so every
aggregate below has a map-side part; nothing is averaged over ratios unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.edit import char_distance, edit_parts, word_distance

EPS = 1e-9


def _n(c: Column) -> Column:
    return F.size(c).cast("long")


def score_words(df: DataFrame, ref: str = "r", hyp: str = "h") -> DataFrame:
    """Add ``errors`` and ``tokens`` (reference words) per row."""
    return df.withColumn("errors", word_distance(F.col(ref), F.col(hyp))).withColumn("tokens", _n(F.col(ref)))


def score_chars(df: DataFrame, ref: str = "r", hyp: str = "h") -> DataFrame:
    """Character errors of the space-joined texts."""
    a, b = F.array_join(ref, " "), F.array_join(hyp, " ")
    return df.withColumn("char_errors", char_distance(a, b)).withColumn("chars", F.length(a).cast("long"))


def rate(errors: Column, tokens: Column) -> Column:
    """errors / tokens; infinite when errors exist without reference tokens."""
    return F.when(tokens > 0, errors / tokens).when(errors > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def error_rate(df: DataFrame, by: list[str] | None = None, errors: str = "errors", tokens: str = "tokens") -> DataFrame:
    """Corpus rate: sum of distances over sum of reference lengths; infinite without references."""
    grouped = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(errors).cast("long").alias("errors"), F.sum(tokens).cast("long").alias("tokens")
    )
    wer = F.when(F.col("tokens") > 0, F.col("errors") / F.col("tokens")).otherwise(F.lit(float("inf")))
    return grouped.withColumn("wer", wer)


def row_error_rate(df: DataFrame, ref: str = "r", hyp: str = "h") -> DataFrame:
    """Per-row rate; an empty pair scores 0 and a hypothesis without reference scores infinity."""
    return score_words(df, ref, hyp).withColumn("wer", rate(F.col("errors"), F.col("tokens")))


def error_detail(df: DataFrame, ref: str = "r", hyp: str = "h") -> DataFrame:
    """Add tokens, errors and the insertion, deletion and substitution rates per row."""
    parts = df.withColumn("_p", edit_parts(ref, hyp)).withColumn("tokens", _n(F.col(ref)))
    out = parts.select("*", "_p.errors", "_p.insertions", "_p.deletions", "_p.substitutions").drop("_p")
    return out.withColumns(
        {
            "wer": rate(F.col("errors"), F.col("tokens")),
            "ins_rate": rate(F.col("insertions"), F.col("tokens")),
            "del_rate": rate(F.col("deletions"), F.col("tokens")),
            "sub_rate": rate(F.col("substitutions"), F.col("tokens")),
        }
    )


def detail_totals(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = scored.groupBy(*(by or [])).agg(
        *[
            F.sum(c).cast("long").alias(c)
            for c in ("tokens", "errors", "insertions", "deletions", "substitutions")
        ]
    )
    t = F.col("tokens")
    return total.withColumns(
        {
            "wer": rate(F.col("errors"), t),
            "ins_rate": rate(F.col("insertions"), t),
            "del_rate": rate(F.col("deletions"), t),
            "sub_rate": rate(F.col("substitutions"), t),
        }
    )


def slot_label(value: Column, slots: list) -> Column:
    """Name of the first slot a value falls into: ``(a, b)`` is ``[a, b)``, without a bound if b is None; a list is a set of values."""
    out = None
    for s in slots:
        if isinstance(s, tuple):
            lo, hi = s
            name, hit = f"[{lo},{'inf' if hi is None else hi})", (value >= lo) if hi is None else (value >= lo) & (value < hi)
        else:
            name, hit = "|".join(map(str, s)), value.isin(list(s))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def grouped_error_rate(scored: DataFrame, target: str, slot: Column | None = None) -> DataFrame:
    """Overall, per target value and per slot in one pass with grouping sets."""
    work = scored.select(F.col(target).alias("target"), (slot if slot is not None else F.lit(None)).alias("slot"), "errors", "tokens")
    sets = [["target"], []] + ([["slot"]] if slot is not None else [])
    out = work.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("target"), F.col("slot")
    ).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("errors").cast("long").alias("errors"),
        F.sum("tokens").cast("long").alias("tokens"),
    )
    # grouping_id bits: target, slot; 3 = overall, 1 = by target, 2 = by slot
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "target").otherwise("slot")
    return out.select(
        level.alias("level"), F.coalesce("target", "slot").alias("value"), "rows", "errors", "tokens",
        F.when(F.col("tokens") > 0, F.col("errors") / F.col("tokens")).otherwise(F.lit(float("inf"))).alias("wer"),
    )


def segment_metrics(df: DataFrame, ref: str = "r", hyp: str = "h", edge: int = 5) -> DataFrame:
    """WER, CER, CER of the first and last ``edge`` characters and length difference, in percent.

    The length difference is taken on words.
    """
    a, b = F.array_join(ref, " "), F.array_join(hyp, " ")
    n_ref = F.greatest(_n(F.col(ref)).cast("double"), F.lit(EPS))
    n_chars = F.greatest(F.length(a).cast("double"), F.lit(EPS))
    head = lambda s: F.substr(s, F.lit(1), F.lit(edge))
    tail = lambda s: F.right(s, F.lit(edge))
    return df.withColumns(
        {
            "wer": word_distance(F.col(ref), F.col(hyp)) / n_ref * 100,
            "cer": char_distance(a, b) / n_chars * 100,
            "start_cer": F.levenshtein(head(a), head(b)) / edge * 100,
            "end_cer": F.levenshtein(tail(a), tail(b)) / edge * 100,
            "len_diff_ratio": F.abs(_n(F.col(ref)) - _n(F.col(hyp))) / n_ref,
        }
    )


def dataset_error_rates(scored: DataFrame, name: str) -> DataFrame:
    """WER and CER per dataset and their unweighted means (0 where a dataset has no reference)."""
    per = scored.groupBy(F.col(name).alias("name")).agg(
        *[F.sum(c).alias(c) for c in ("errors", "tokens", "char_errors", "chars")]
    )
    zero = lambda e, t: F.when(F.col(t) > 0, F.col(e) / F.col(t)).otherwise(F.lit(0.0))
    per = per.select("name", zero("errors", "tokens").alias("wer"), zero("char_errors", "chars").alias("cer"))
    mean = per.agg(F.lit("mean").alias("name"), F.avg("wer").alias("wer"), F.avg("cer").alias("cer"))
    return per.unionByName(mean)
