"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scoped import let
from weftline.operators.ordered import number_rows, running


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """Count, share (5 digits) and rank per label; the highest label is flagged. One row per label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()
    return counts.select(
        "label",
        "rows",
        F.round(F.col("rows") / F.sum("rows").over(every), 5).alias("share"),
        F.row_number().over(Window.orderBy(F.desc("rows"), "label")).cast("long").alias("rank"),
        (F.col("label") == F.max("label").over(every)).alias("is_max_label"),
    )


def multi_label_stats(df: DataFrame, labels: Column) -> DataFrame:
    """Positives and negatives per position of a 0/1 array."""
    flat = df.select(F.posexplode(labels).alias("index", "v"))
    return flat.groupBy(F.col("index").cast("long").alias("index")).agg(
        F.sum((F.col("v") == 1).cast("long")).alias("positive"), F.sum((F.col("v") == 0).cast("long")).alias("negative")
    )


def class_weights(df: DataFrame, label: str, n_classes: int | None = None) -> DataFrame:
    """total / (k * count) per class; with ``n_classes`` absent integer classes get 1.0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()
    weights = counts.select(
        "label", (F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows"))).alias("weight")
    )
    if n_classes is None:
        return weights
    dense = df.sparkSession.range(n_classes).select(F.col("id").alias("label"))
    return dense.join(weights.withColumn("label", F.col("label").cast("long")), "label", "left").fillna(1.0, ["weight"])


def bce_weights(df: DataFrame, labels: Column) -> DataFrame:
    """negatives / positives per position, 0 without positives."""
    s = multi_label_stats(df, labels)
    return s.select("index", F.when(F.col("positive") > 0, F.col("negative") / F.col("positive")).otherwise(F.lit(0.0)).alias("weight"))


def leaf_weights(df: DataFrame, path: list[str], duration: str) -> DataFrame:
    """Rows and hours per leaf dataset."""
    return df.groupBy(*path).agg(F.count(F.lit(1)).alias("rows"), (F.sum(duration) / 3600).alias("hours"))


def group_weights(leaves: DataFrame, path: list[str], weight: str, temperatures: list[float]) -> DataFrame:
    """Sum weights up a group path and re-weight every level: w**t / sum(w**t) among siblings.

    Adds ``share_0 .. share_k``, one per path level. The input is one row per dataset.
    """
    out = leaves
    for level in range(len(path)):
        node, parent = path[: level + 1], path[:level]
        total = F.sum(weight).over(Window.partitionBy(*node))
        powered = F.pow(total, F.lit(float(temperatures[level])))
        # every sibling counts once, however many leaves it has
        once = powered / F.count(F.lit(1)).over(Window.partitionBy(*node))
        out = out.withColumn(f"_p{level}", powered).withColumn(f"_o{level}", once)
        out = out.withColumn(f"share_{level}", F.col(f"_p{level}") / F.sum(f"_o{level}").over(Window.partitionBy(*parent)))
    return out.drop(*[f"_{x}{i}" for i in range(len(path)) for x in "po"])


def feature_stats(df: DataFrame, speaker: str, values: Column, skip_zero: bool = False) -> DataFrame:
    """Mean and sample deviation per speaker and over everything (``default``) in one pass."""
    flat = df.select(F.col(speaker).cast("string").alias("speaker"), F.explode(values).alias("v"))
    if skip_zero:
        flat = flat.filter(F.col("v") != 0)
    out = flat.rollup("speaker").agg(
        F.grouping("speaker").alias("_g"), F.count("v").alias("frames"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    return out.select(F.when(F.col("_g") == 1, "default").otherwise(F.col("speaker")).alias("speaker"), "frames", "mean", "std")


def length_histogram(df: DataFrame, length: Column, max_len: int | None = None) -> DataFrame:
    """Rows per length - 1, zero-filled up to the longest row.

    With ``max_len`` longer rows are counted together in one more row, ``max_len + 1``.
    """
    n = (length - 1).cast("long")
    counts = df.groupBy((n if max_len is None else F.least(n, F.lit(max_len + 1))).alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.agg(F.max("length")).first()[0] if max_len is None else max_len + 1
    grid = df.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("length"))
    return grid.join(counts, "length", "left").fillna(0, ["rows"])


def session_sweep(segments: DataFrame, session: str) -> DataFrame:
    """Speech, silence and overlap seconds per session (start, end in seconds).

    A sweep over start and end marks: the depth after a mark holds until the next one. Marks are
    ordered in value buckets, so one long session is spread over many tasks.
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    marks = segments.select(
        session,
        "id",
        F.explode(
            F.array(
                F.struct(ms("start").alias("t"), F.lit(1).alias("step")), F.struct(ms("end").alias("t"), F.lit(-1).alias("step"))
            )
        ).alias("m"),
    ).select(session, "id", F.col("m.t").alias("t"), F.col("m.step").alias("step"))
    swept = running(marks, ["t", "step", "id"], [session], sums={"depth": F.col("step")}, lead={"nxt": F.col("t")})
    width = F.coalesce(F.col("nxt") - F.col("t"), F.lit(0))
    return swept.groupBy(session).agg(
        (F.sum(width) / 1000).alias("session_dur"),
        (F.sum(F.when(F.col("depth") >= 1, width).otherwise(0)) / 1000).alias("speech"),
        (F.sum(F.when(F.col("depth") == 0, width).otherwise(0)) / 1000).alias("silence"),
        (F.sum(F.when(F.col("depth") >= 2, width).otherwise(0)) / 1000).alias("overlap"),
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    """Means over all time and population variances of the session ratios."""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        (F.sum("session_dur") / 3600).alias("hours"),
        (F.sum("silence") / F.sum("session_dur")).alias("silence_mean"),
        F.var_pop(F.col("silence") / F.col("session_dur")).alias("silence_var"),
        (F.sum("overlap") / F.sum("speech")).alias("overlap_mean"),
        F.var_pop(F.col("overlap") / F.col("speech")).alias("overlap_var"),
    )


def imbalance_report(df: DataFrame, col: str, top: int = 5) -> DataFrame:
    """The ``top`` commonest values with their percentage, if distinct values are under a third of the rows."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not total["n"] or total["k"] >= total["n"] / 3:
        return counts.limit(0).withColumn("percent", F.lit(0.0))
    return counts.orderBy(F.desc("rows"), "value").limit(top).withColumn("percent", F.bround(100 * F.col("rows") / total["n"], 0))


def quality_issues(df: DataFrame, order: str, cols: list[str], required: str) -> DataFrame:
    """Row numbers (from 0) of empty values and of repeated rows, one row per issue."""
    # a digest of the values moves in their place
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    short = df.select(order, digest.alias("_d"), (F.coalesce(F.col(required), F.lit("")) == "").alias("_empty"))
    numbered = number_rows(short, [order]).withColumn("row", F.col("row_no") - 1)
    empty = numbered.filter("_empty").select("row", F.lit("empty").alias("issue"))
    first = numbered.groupBy("_d").agg(F.min("row").alias("row"))
    repeated = numbered.select("row").join(first.select("row"), "row", "left_anti").select("row", F.lit("duplicate").alias("issue"))
    return empty.unionByName(repeated)


def low_count(df: DataFrame, n: int = 64) -> DataFrame:
    """Row count and whether it is below the recommended minimum."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("too_few", F.col("rows") < n)


def common_suffix(df: DataFrame, col: str) -> DataFrame:
    """Longest common suffix: the common prefix of the smallest and largest reversed value."""
    ends = df.agg(F.min(F.reverse(col)).alias("a"), F.max(F.reverse(col)).alias("b"))

    def prefix(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.lit(0),
            lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k),
        )
        return F.reverse(F.substr(a, F.lit(1), same))

    return ends.select(let(F.col("a"), lambda a: let(F.col("b"), lambda b: prefix(a, b))).alias("suffix"))


def order_statistic(df: DataFrame, col: str, rank: int) -> float:
    """Value at a 1-based rank of the sorted column, from the histogram with running counts."""
    hist = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running(hist, ["v"], sums={"u": F.col("c")})
    return upto.filter(F.col("u") >= rank).agg(F.min("v")).first()[0]


def size_report(df: DataFrame, chars: Column) -> DataFrame:
    """Lengths behind the size advice: 99.5 % order statistic, mean + 2 deviations, resulting maximum."""
    import math

    rows = df.select(chars.cast("long").alias("n"))
    n = rows.count()
    high = order_statistic(rows, "n", math.ceil(n * 0.995))
    limit = F.greatest(F.least(F.col("mean") + 2 * F.col("std"), F.col("longest")), F.lit(high))
    tier = lambda a, b, c: F.when(F.col("rows") <= 100, a).when(F.col("rows") <= 1000, b).otherwise(c)
    batch = F.lit(2)
    for b in (4, 8, 12, 16, 32, 64, 128):
        batch = F.when(F.col("rows") * 0.9 > b, b).otherwise(batch)
    return (
        rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.max("n").alias("longest"))
        .withColumn("p995", F.lit(high).cast("long"))
        .withColumn("max_seq_length", (F.floor(limit / 4) + 100).cast("long"))
        .withColumn("hidden_size", tier(1024, 2048, 4096))
        .withColumn("max_batch", F.when(F.col("rows") < 128, batch).otherwise(128))
    )


def run_summary(df: DataFrame, domain: Column, reward: Column, ticks: Column, seconds: Column, reason: Column) -> DataFrame:
    """Per domain: episodes, null-safe mean reward, ticks, seconds, termination counts as sorted text."""
    per = df.groupBy(domain.alias("domain"), reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(reward).alias("r"), F.count(reward).alias("rn"), F.sum(ticks).alias("t"), F.sum(seconds).alias("s")
    )
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ", "
    )
    return per.groupBy("domain").agg(
        F.sum("n").alias("episodes"),
        (F.sum("r") / F.sum("rn")).alias("mean_reward"),
        F.sum("t").cast("long").alias("ticks"),
        F.sum("s").alias("seconds"),
        text.alias("terminations"),
    )


def tool_report(calls: DataFrame, name: str, error: Column, known: list[str], top: int = 20) -> DataFrame:
    """Calls and errors per tool, the commonest ``top``, with names outside the schema flagged."""
    per = calls.groupBy(F.col(name).alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum(error.cast("long")).alias("errors"))
    return per.withColumn("invented", ~F.col("tool").isin(known)).orderBy(F.desc("calls"), "tool").limit(top)


def invented_share(calls: DataFrame, name: str, known: list[str]) -> DataFrame:
    return calls.agg(F.avg((~F.col(name).isin(known)).cast("double")).alias("invented_share"))


def multi_reference_vocabulary(tokens: DataFrame, cls: str, spoken: str, written: str, min_count: int = 1) -> DataFrame:
    """(class, spoken) -> written with counts, plus the identity form of every spoken text,
    counted once. Unchanged tokens (``<self>``) and spoken texts of 100 words or more stay out."""
    rows = tokens.filter((F.col(spoken) != "") & (F.col(written) != "") & (F.col(spoken) != "<self>") & (F.size(F.split(spoken, " ")) < 100))
    seen = rows.groupBy(F.col(cls).alias("cls"), F.col(spoken).alias("spoken"), F.col(written).alias("written")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.filter(F.col("n") >= min_count)
    identity = seen.select("cls", "spoken").distinct().select("cls", "spoken", F.col("spoken").alias("written"), F.lit(1).cast("long").alias("n"))
    both = seen.unionByName(identity)
    return both.groupBy("cls", "spoken", "written").agg(F.max("n").alias("n"))


def episode_table(turns: DataFrame, conv: str, is_call: Column, is_result: Column) -> DataFrame:
    """Per conversation: turns, calls, results, characters and last role."""
    return turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(is_call.cast("long")).alias("calls"),
        F.sum(is_result.cast("long")).alias("results"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.max_by("role", "turn").alias("last_role"),
    )
