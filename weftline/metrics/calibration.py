"""Confidence scores against 0/1 truth: ranking areas, cross entropy, calibration error, Youden curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import running
from weftline.session import cut_lineage


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all that the ranking areas need."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(truth)).cast("long").alias("pos"), F.sum(1 - F.col(truth)).cast("long").alias("neg")
    )


def ranking_areas(df: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC area, average precision, and average precision of the errors, in one row.

    ROC area is 0.5 with a single class, the precision areas are 0 without their class.
    """
    table = cut_lineage(_by_score(df, truth, score).withColumn("fall", -F.col("score")))
    up = running(table, ["score"], sums={"pos_up": F.col("pos"), "neg_up": F.col("neg")})
    both = running(up, ["fall"], sums={"pos_down": F.col("pos"), "neg_down": F.col("neg")})
    roc = F.sum(F.col("pos") * (F.col("neg_up") - F.col("neg") / 2))
    ap = F.sum(F.col("pos") * F.col("pos_down") / (F.col("pos_down") + F.col("neg_down")))
    err = F.sum(F.col("neg") * F.col("neg_up") / (F.col("pos_up") + F.col("neg_up")))
    p, n = F.sum("pos"), F.sum("neg")
    return both.agg(
        F.when((p > 0) & (n > 0), roc / (p * n)).otherwise(F.lit(0.5)).alias("auc_roc"),
        F.when(p > 0, ap / p).otherwise(F.lit(0.0)).alias("auc_pr"),
        F.when(n > 0, err / n).otherwise(F.lit(0.0)).alias("auc_nt"),
    )


def normalized_cross_entropy(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(H(p) - logloss) / H(p); minus infinity with a single class."""
    eps = 2.220446049250313e-16
    s = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    t = F.col(truth)
    loss = -F.avg(t * F.log(s) + (1 - t) * F.log(1 - s))
    sums = df.agg(F.avg(t.cast("double")).alias("p"), loss.alias("loss"))
    p, tiny = F.col("p"), 1e-15
    h = -(F.log(p + tiny) * p + F.log(1 - p + tiny) * (1 - p))
    return sums.select(
        F.when((p > 0) & (p < 1), (h - F.col("loss")) / h).otherwise(F.lit(float("-inf"))).alias("nce")
    )


def calibration_error(df: DataFrame, truth: str, score: str, n_bins: int = 100) -> DataFrame:
    """Expected calibration error whose decision threshold moves with the bin centre.

    In bin (a, b] a row counts with value s if s >= centre, else with 1-s. A value can only fall in
    its own bin, so a row meets at most two bins; no join with the bin table is needed. The three
    neighbouring bins are tried to be exact at the edges.
    """
    s = F.col(score)

    def near(v):
        m = F.ceil(v * n_bins).cast("int") - 1
        return F.array(m - 1, m, m + 1)

    rows = df.select(F.col(truth).alias("t"), s.alias("s"), F.explode(F.array_distinct(F.concat(near(s), near(1 - s)))).alias("m"))
    rows = rows.filter((F.col("m") >= 0) & (F.col("m") < n_bins))
    a, b = F.col("m") / n_bins, (F.col("m") + 1) / n_bins
    yes = F.col("s") >= (a + b) / 2
    value = F.when(yes, F.col("s")).otherwise(1 - F.col("s"))
    inside = rows.withColumn("yes", yes.cast("int")).withColumn("v", value).filter((F.col("v") > a) & (F.col("v") <= b))
    bins = inside.groupBy("m").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("yes") == F.col("t")).cast("long")).alias("hit"), F.sum("v").alias("conf")
    )
    return bins.agg((F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("ece"))


def youden_curve(df: DataFrame, truth: str, score: str, n_bins: int = 100) -> DataFrame:
    """Mean, deviation and maximum of |TNR - FNR| over the thresholds i/n_bins; zeros for one class."""
    s = F.col(score)
    k = F.floor(s * n_bins).cast("int")
    first = F.when(s < k / n_bins, k).when(s < (k + 1) / n_bins, k + 1).otherwise(k + 2)
    hist = df.groupBy(F.least(F.greatest(first, F.lit(0)), F.lit(n_bins + 1)).alias("i")).agg(
        F.sum(F.col(truth)).alias("pos"), F.sum(1 - F.col(truth)).alias("neg")
    )
    grid = df.sparkSession.range(n_bins + 2).select(F.col("id").cast("int").alias("i"))
    # n_bins + 2 rows at most, whatever the data size
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    curve = (
        grid.join(F.broadcast(hist), "i", "left")
        .fillna(0, ["pos", "neg"])
        .select(
            "i",
            F.sum("pos").over(w).alias("fn"), F.sum("neg").over(w).alias("tn"),
            F.sum("pos").over(everything).alias("P"), F.sum("neg").over(everything).alias("N"),
        )
        .filter(F.col("i") <= n_bins)
        .withColumn("yc", F.when((F.col("P") > 0) & (F.col("N") > 0), F.abs(F.col("tn") / F.col("N") - F.col("fn") / F.col("P"))).otherwise(F.lit(0.0)))
    )
    return curve.agg(F.avg("yc").alias("auc_yc"), F.stddev_pop("yc").alias("std_yc"), F.max("yc").alias("max_yc"))
