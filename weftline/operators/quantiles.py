"""Exact quantiles from a value histogram with running counts: no group is held in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import running
from weftline.session import cut_lineage


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (one row, or one per group) named by the keys of ``probs``."""
    by = by or []
    hist = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    hist = cut_lineage(hist)
    upto = running(hist, ["_v"], by, sums={"_u": F.col("_c")})
    if by:
        totals = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
        upto, n = upto.join(totals, by), F.col("_n")
    else:
        n = F.lit(hist.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0])
    aggs = []
    for name, p in probs.items():
        at = (n - 1) * p
        aggs.append(F.min(F.when(F.col("_u") > F.floor(at), F.col("_v"))).cast("double").alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("_u") > F.ceil(at), F.col("_v"))).cast("double").alias(f"_hi_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_w_{name}"))
    row = upto.groupBy(*by).agg(*aggs)
    mixed = [
        (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_w_{k}")).alias(k) for k in probs
    ]
    return row.select(*by, *mixed)
