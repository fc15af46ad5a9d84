"""Classification, ranking and loss averages, all from mergeable counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def exact_match(df: DataFrame, correct: Column, category: str) -> DataFrame:
    """Percent correct overall and per category."""
    return (
        df.withColumn("_c", correct.cast("double"))
        .rollup(F.col(category).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("rows"), (100 * F.avg("_c")).alias("exact_match"))
        .withColumn("category", F.coalesce("category", F.lit("all")))
    )


def top_k_accuracy(df: DataFrame, ranked: Column, label: Column, ks: list[int]) -> DataFrame:
    """Share of rows whose label is among the first k of ``ranked``, for every k."""
    at = F.array_position(ranked, label)
    return df.agg(*[F.avg(((at > 0) & (at <= k)).cast("double")).alias(f"top_{k}") for k in ks])


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus micro, macro and weighted rows (percent).

    One aggregation to (truth, pred) counts; the rest works on that small table. Macro divides by
    the number of classes with support.
    """
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("n")).alias("fn"), F.lit(0).cast("long").alias("fp")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("n")).alias("fp")),
            )
        ).alias("x")
    ).select("x.*")
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    prf = lambda tp, fp, fn: (tp * 100.0 / (tp + fp + EPS), tp * 100.0 / (tp + fn + EPS))
    p, r = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    classes = per.select(
        F.col("label").cast("string").alias("label"), p.alias("precision"), r.alias("recall"),
        (2 * p * r / (p + r + EPS)).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn",
    )
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    mp, mr = prf(tp, fp, fn)
    n, k = F.sum("support"), F.sum((F.col("support") > 0).cast("int"))
    cols = ("precision", "recall", "f1")
    micro = classes.agg(F.lit("micro").alias("label"), mp.alias("precision"), mr.alias("recall"), (2 * mp * mr / (mp + mr + EPS)).alias("f1"), n.alias("support"))
    macro = classes.agg(F.lit("macro").alias("label"), *[(F.sum(c) / k).alias(c) for c in cols], n.alias("support"))
    weighted = classes.agg(F.lit("weighted").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in cols], n.alias("support"))
    return classes.drop("tp", "fp", "fn").unionByName(micro).unionByName(macro).unionByName(weighted)


def multi_label_report(df: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per label: precision, recall, F1 (percent) of 0/1 truth and prediction columns."""
    flat = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("label"), t.cast("int").alias("t"), p.cast("int").alias("p")) for k, (t, p) in columns.items()])
        ).alias("x")
    ).select("x.*")
    sums = flat.groupBy("label").agg(
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn")
    )
    p = F.col("tp") * 100.0 / (F.col("tp") + F.col("fp") + EPS)
    r = F.col("tp") * 100.0 / (F.col("tp") + F.col("fn") + EPS)
    return sums.select("label", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + EPS)).alias("f1"))


def binary_f1(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """F1 of scores rounded at 0.5; -1 where it is undefined."""
    p, t = (score >= 0.5).cast("long"), (truth >= 0.5).cast("long")
    sums = df.agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return sums.select("tp", "fp", "fn", F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(-1.0)).alias("f1"))


def perplexity(df: DataFrame, nll: Column, n_valid: Column, by: list[str] | None = None) -> DataFrame:
    """exp(sum of token losses / valid tokens); infinite without valid tokens."""
    sums = df.groupBy(*(by or [])).agg(F.sum(nll).alias("_l"), F.sum(n_valid).alias("_n"))
    value = F.when(F.col("_n") > 0, F.exp(F.col("_l") / F.col("_n"))).otherwise(F.lit(float("inf")))
    return sums.select(*(by or []), F.col("_n").cast("long").alias("tokens"), value.alias("perplexity"))


def weighted_loss(df: DataFrame, loss: Column, n: Column, by: list[str] | None = None) -> DataFrame:
    """Average loss over all elements, batches weighted by their size."""
    return df.groupBy(*(by or [])).agg((F.sum(loss * n) / F.sum(n)).alias("loss"))


def empty_rate(df: DataFrame, name: str, empty: Column) -> DataFrame:
    """Share of empty texts per dataset, plus totals and the unweighted mean."""
    per = df.groupBy(F.col(name).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(empty.cast("long")).alias("empty"), F.avg(empty.cast("double")).alias("rate")
    )
    mean = per.agg(F.lit("mean").alias("name"), F.sum("rows").alias("rows"), F.sum("empty").alias("empty"), F.avg("rate").alias("rate"))
    return per.unionByName(mean)


def reciprocal_rank(df: DataFrame, query: str, score: str, relevant: Column) -> DataFrame:
    """Reciprocal rank per query: items scored above the best relevant one come first; 0 if none.

    Two aggregations and a join instead of a sort per query, so a hot query stays spread.
    """
    best = df.groupBy(query).agg(F.max(F.when(relevant, F.col(score))).alias("_best"))
    ranked = df.join(best, query)
    return ranked.groupBy(query).agg(
        F.when(F.first("_best").isNotNull(), 1.0 / (1 + F.sum((F.col(score) > F.col("_best")).cast("long")))).otherwise(F.lit(0.0)).alias("rr")
    )
