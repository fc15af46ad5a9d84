"""Length buckets: assignment to given buckets and estimation of bucket bounds."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import running
from weftline.session import cut_lineage


def bucket_of(buckets: list, length: Column, second: Column | None = None, strict: bool = True, max_ratio: list[float] | None = None) -> Column:
    """Index of the smallest bucket that fits, null if none does. ``buckets`` are sorted ascending.

    One length: first bound >= length. Two lengths, strict: the first bucket whose first bound fits
    decides the group of equal first bounds, and only that group is searched for the second; an
    optional ratio second/length is checked against the bucket found (a length of zero has none, so fits
    no bucket). Lenient: the first bucket that fits both. The buckets are a handful of literals, so this is a CASE expression.
    """
    out = None
    add = lambda acc, hit, value: F.when(hit, value) if acc is None else acc.when(hit, value)
    if second is None:
        for i, b in enumerate(buckets):
            out = add(out, length <= b, F.lit(i))
        return out
    if not strict:
        for i, (a, b) in enumerate(buckets):
            out = add(out, (length <= a) & (second <= b), F.lit(i))
        return out
    for dim0 in sorted({a for a, _ in buckets}):
        inner = None
        for i, (a, b) in enumerate(buckets):
            if a != dim0:
                continue
            value = F.lit(i)
            if max_ratio is not None:
                value = F.when(F.try_divide(second, length) <= max_ratio[i], value)
            inner = add(inner, second <= b, value)
        out = add(out, length <= dim0, inner)
    return out


def filter_bucketable(df: DataFrame, buckets: list, length: Column, second: Column | None = None, strict: bool = True, max_ratio: list[float] | None = None) -> DataFrame:
    """Drop rows that fit no bucket."""
    return df.filter(bucket_of(buckets, length, second, strict, max_ratio).isNotNull())


def _histogram(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with count and the sum of everything smaller."""
    hist = df.groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return running(hist, ["v"], sums={"_upto": F.col("v") * F.col("c")}).select("v", "c", (F.col("_upto") - F.col("v") * F.col("c")).alias("below"))


def equal_mass_bounds(df: DataFrame, value: str, n: int) -> list[int]:
    """Bounds of ``n`` buckets of equal total over the sorted integer values.

    When the sum before a value exceeds total/n, that value is a bound, the sum restarts there. Each
    bound is one small query over the value histogram with its running sums, which is computed once.
    """
    hist = cut_lineage(_histogram(df.filter(F.col(value).isNotNull()), value))
    total = hist.agg(F.sum(F.col("v") * F.col("c"))).first()[0] or 0
    share, base, bounds = total / n, 0, []
    while True:
        # copies of v before the sum passes the share
        j = F.when(F.col("below") - base > share, F.lit(0)).otherwise(F.floor((F.lit(share) + base - F.col("below")) / F.col("v")) + 1)
        hit = (
            hist.filter(F.col("v") > 0)
            .filter(F.col("below") + (F.col("c") - 1) * F.col("v") - base > share)
            .select("v", (F.col("below") + j * F.col("v")).alias("at"))
            .agg(F.min(F.struct("v", "at")).alias("x"))
            .first()["x"]
        )
        if hit is None:
            return bounds
        bounds.append(hit["v"])
        base = int(hit["at"])


def fold_bounds(hist: list[tuple[int, int]], n: int) -> list[int]:
    """:func:`equal_mass_bounds` of one group's histogram, for use inside a task."""
    total = sum(v * c for v, c in hist)
    share, tot, out = total / n, 0, []
    for v, c in sorted(hist):
        left = c
        while left:
            if tot > share:
                out.append(v)
                tot = 0
            take = left if v <= 0 else min(left, max(int((share - tot) // v) + 1, 1))
            tot += take * v
            left -= take
    return out


def merge_bounds(bounds: list[float], top: float) -> list[tuple[float, int]]:
    """(bound, how many equal bounds it stands for), closed by the overall maximum."""
    return sorted(Counter([*bounds, top]).items())


def buckets_2d(df: DataFrame, duration: str, tokens: str, n: int, n_sub: int, outlier: float = 4.0) -> DataFrame:
    """Duration buckets of equal mass, each cut into token sub-buckets of equal mass.

    Equal duration bounds merge and get proportionally more sub-buckets; rows whose tokens per second
    lie more than ``outlier`` deviations above their bucket's mean do not count. Rows are assigned by
    value (milliseconds), rows equal to a bound open the next bucket. Output: bucket bound, token
    bound, highest tokens per second of the bucket.
    """
    ms = df.select(F.round(F.col(duration) * 1000).cast("long").alias("ms"), F.col(tokens).cast("long").alias("n")).filter(F.col("ms") > 0)
    top = ms.agg(F.max("ms")).first()[0]
    if top is None:  # no rows with a duration
        return ms.limit(0).select(F.lit(0.0).alias("bound"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("max_tps"))
    plan = merge_bounds(equal_mass_bounds(ms, "ms", n), top)
    index = None
    for i, (b, _) in enumerate(plan[:-1]):
        index = F.when(F.col("ms") < b, i) if index is None else index.when(F.col("ms") < b, i)
    index = F.lit(0) if index is None else index.otherwise(len(plan) - 1)
    rows = ms.withColumn("bucket", index).withColumn("tps", F.col("n") / (F.col("ms") / 1000.0))
    stats = rows.groupBy("bucket").agg(F.avg("tps").alias("mu"), F.stddev_pop("tps").alias("sd"))
    # one row per bucket
    kept = rows.join(F.broadcast(stats), "bucket").filter((F.col("sd") == 0) | ((F.col("tps") - F.col("mu")) / F.col("sd") <= outlier))
    hist = kept.groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("c"), F.max("tps").alias("tps"))
    bounds = {i: (b / 1000.0, k * n_sub) for i, (b, k) in enumerate(plan)}
    return _sub_buckets(hist, bounds)


def _sub_buckets(hist: DataFrame, bounds: dict[int, tuple[float, int]]) -> DataFrame:
    """Token bounds per bucket from its histogram (as many rows as distinct token counts)."""

    def cut(pdf):
        import pandas as pd

        bucket = int(pdf["bucket"].iloc[0])
        top, parts = bounds[bucket]
        marks = fold_bounds([(int(v), int(c)) for v, c in zip(pdf["n"], pdf["c"])], parts)
        return pd.DataFrame({"bound": top, "tokens": [*marks, int(pdf["n"].max())], "max_tps": float(pdf["tps"].max())})

    return hist.groupBy("bucket").applyInPandas(cut, "bound double, tokens long, max_tps double")


def token_buckets(df: DataFrame, length: str, n: int) -> list[int]:
    """Bounds over token counts (input or total) of ``n`` buckets of equal token mass."""
    return equal_mass_bounds(df, length, n)


def token_buckets_2d(df: DataFrame, source: str, target: str, n: int, n_sub: int) -> DataFrame:
    """Input-token buckets cut by output tokens; each closes with ``ceil(bound * max ratio)``."""
    rows = df.select(F.col(source).cast("long").alias("i"), F.col(target).cast("long").alias("n")).filter(F.col("i") > 0)
    edge = rows.agg(F.max("i").alias("top"), F.max(F.col("n") / F.col("i")).alias("ratio")).first()
    if edge["top"] is None:
        return rows.limit(0).select(F.col("i").alias("source"), F.col("n").alias("target"))
    bounds = [*equal_mass_bounds(rows, "i", n), edge["top"]]
    index = None
    for i, b in enumerate(bounds[:-1]):
        index = F.when(F.col("i") < b, i) if index is None else index.when(F.col("i") < b, i)
    index = F.lit(0) if index is None else index.otherwise(len(bounds) - 1)
    hist = rows.withColumn("bucket", index).groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("c"))

    def cut(pdf):
        import pandas as pd

        top = bounds[int(pdf["bucket"].iloc[0])]
        marks = fold_bounds([(int(v), int(c)) for v, c in zip(pdf["n"], pdf["c"])], n_sub)
        return pd.DataFrame({"source": top, "target": [*marks, math.ceil(top * edge["ratio"])]})

    return hist.groupBy("bucket").applyInPandas(cut, "source long, target long")
