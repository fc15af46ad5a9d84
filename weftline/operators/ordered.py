"""Running values over an order, without ever putting a whole group into one task.

A plain ``Window.orderBy`` (or a ``partitionBy`` on a key that holds a third of the rows) sorts
everything in one task. Here the order is cut into value buckets first:

1. every row gets a bucket number that is monotone in the order,
2. one partial aggregation per (group, bucket) gives the bucket totals,
3. a window over that small table turns totals into carries,
4. a window inside each bucket adds the local part.

Buckets come from row values alone (digest prefix, or literal quantile bounds), so a recomputed
partition lands in the same bucket. A value that is itself hot is cut again by the second order
column. Strings are cut at whole values of a sample, structs by their first field. Null groups are groups.
"""

from __future__ import annotations

import bisect
import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.seeded import seeded_key

_SUB = 1_000_000


#: sampled strings per bucket that the bounds of a string order are taken from
PER_BUCKET = 32


def _as_key(df: DataFrame, name: str) -> tuple[Column, bool]:
    """What rows are cut by: a double that never falls where the order of the column rises, or a string (True)."""
    return _key(F.col(name), df.schema[name].dataType)


def _key(c: Column, kind: T.DataType) -> tuple[Column, bool]:
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double"), False
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double"), False
    if isinstance(kind, T.StringType):
        return c, True
    if isinstance(kind, T.StructType):
        first = kind.fields[0]
        return _key(c[first.name], first.dataType)
    return c.cast("double"), False


def bucket_count(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(10_000, 2 * n))


def _quantiles(df: DataFrame, names: list[str], n: int) -> dict[str, list]:
    """Bounds as driver literals; at most ``n`` of each column, a value that is hot more than once."""
    probs = [i / n for i in range(1, n)]
    keys = {c: _as_key(df, c) for c in names}
    numeric = {c: k for c, (k, text) in keys.items() if not text}
    found: dict[str, list] = {}
    if numeric:
        row = df.agg(*[F.percentile_approx(k, probs, max(10000, 4 * n)).alias(c) for c, k in numeric.items()]).first()
        found = {c: list(row[c] or []) for c in numeric}
    rows = df.count() if len(numeric) < len(names) else 0
    for c in (c for c in names if c not in numeric):
        # which rows are drawn only decides how even the buckets are
        some = df.select(keys[c][0].alias("v")).filter("v is not null").sample(min(1.0, PER_BUCKET * n / max(rows, 1)), 1)
        found[c] = string_bounds(sorted(r["v"] for r in some.collect()), n)
    return found


def string_bounds(values: list[str], n: int) -> list[str]:
    """n - 1 evenly spaced ones of sorted values, each cut to the shortest beginning that still lies above the value before it.

    A value that is drawn more than once is kept whole.
    """
    picked = [values[i * len(values) // n] for i in range(1, n)] if values else []
    out = []
    for v in picked:
        at = bisect.bisect_left(values, v)
        if picked.count(v) == 1 and at:
            before = values[at - 1]
            v = next(v[:k] for k in range(1, len(v) + 1) if v[:k] > before)
        out.append(v)
    return out


def _below(bounds: list, value: Column) -> Column:
    """How many bounds are smaller than ``value``; two short scans in place of one long one."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(math.sqrt(len(bounds))))
    if len(bounds) <= 32:
        return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda x: x < value)).cast("long")
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    every = F.array(*[F.lit(b) for b in bounds])
    start = F.greatest(F.size(F.filter(heads, lambda x: x < value)) - 1, F.lit(0)) * step
    part = F.slice(every, start + 1, F.lit(step))
    return (start + F.size(F.filter(part, lambda x: x < value))).cast("long")


def order_bucket(df: DataFrame, order: list[str], hashed: bool = False, buckets: int | None = None) -> Column:
    """Bucket number of each row, monotone in ``order``."""
    if hashed:
        digits = 3 if bucket_count(df) <= 4096 else 4
        return F.conv(F.substring(F.col(order[0]), 1, digits), 16, 10).cast("long")
    n = buckets or bucket_count(df)
    numeric = order[:2]
    found = _quantiles(df, numeric, n)
    bounds = found[order[0]]
    hot = sorted({b for b in bounds if bounds.count(b) > 1})
    bounds = sorted(set(bounds))
    key, text = _as_key(df, order[0])
    value = F.coalesce(key, F.lit("" if text else float("-inf")))
    main = _below(bounds, value) * 2
    if not hot:
        return main * _SUB
    is_hot = value.isin(hot)
    sub = F.lit(0).cast("long")
    if len(numeric) > 1:
        sub = F.when(is_hot, _below(sorted(set(found[order[1]])), _as_key(df, order[1])[0])).otherwise(sub)
    return (main + F.when(is_hot, 1).otherwise(0)) * _SUB + sub


def running(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    *,
    row_no: str | None = None,
    sums: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    hashed: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add running columns to ``df``; ``order`` must be unique within a group.

    ``row_no`` counts from 1, ``sums`` include the row, ``max_before`` does not, ``lag``/``lead``
    are the neighbour's value, ``last`` is the latest non-null value up to and including the row.
    """
    by = list(by or [])
    sums, max_before, lag, lead, last = (x or {} for x in (sums, max_before, lag, lead, last))
    keys = [*by, "_b"]
    work = df.withColumn("_b", order_bucket(df, order, hashed, buckets))
    at = F.struct(*order)

    totals, carry = [], []
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy(*by).orderBy("_b")
    local = Window.partitionBy(*keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    outs: dict[str, Column] = {}

    if row_no:
        totals.append(F.count(F.lit(1)).alias("_n"))
        carry.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"))
        outs[row_no] = (F.row_number().over(local) + F.col("_cn")).cast("long")
    for name, expr in sums.items():
        totals.append(F.sum(expr).alias(f"_s_{name}"))
        carry.append(F.sum(f"_s_{name}").over(before).alias(f"_cs_{name}"))
        outs[name] = F.coalesce(F.sum(expr).over(upto), F.lit(0)) + F.coalesce(F.col(f"_cs_{name}"), F.lit(0))
    for name, expr in max_before.items():
        totals.append(F.max(expr).alias(f"_m_{name}"))
        carry.append(F.max(f"_m_{name}").over(before).alias(f"_cm_{name}"))
        outs[name] = F.greatest(F.max(expr).over(prior), F.col(f"_cm_{name}"))
    for name, expr in lag.items():
        totals.append(F.max_by(F.struct(expr.alias("v")), at).alias(f"_l_{name}"))
        carry.append(F.lag(f"_l_{name}").over(beside).alias(f"_cl_{name}"))
        outs[name] = F.when(F.row_number().over(local) == 1, F.col(f"_cl_{name}.v")).otherwise(F.lag(expr).over(local))
    for name, expr in lead.items():
        totals.append(F.min_by(F.struct(expr.alias("v")), at).alias(f"_f_{name}"))
        carry.append(F.lead(f"_f_{name}").over(beside).alias(f"_cf_{name}"))
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        outs[name] = F.when(F.row_number().over(back) == 1, F.col(f"_cf_{name}.v")).otherwise(F.lead(expr).over(local))
    for name, expr in last.items():
        totals.append(F.max_by(expr, F.when(expr.isNotNull(), at)).alias(f"_t_{name}"))
        carry.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_ct_{name}"))
        outs[name] = F.coalesce(F.last(expr, ignorenulls=True).over(upto), F.col(f"_ct_{name}"))

    summary = work.groupBy(*keys).agg(*totals).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *carry)
    if not by:
        # at most one row per bucket, whatever the data size
        summary = F.broadcast(summary)
    same = [work[k].eqNullSafe(summary[f"_key{i}"]) for i, k in enumerate(keys)]
    joined = work.join(summary, functools.reduce(operator.and_, same))
    return joined.select(*df.columns, *[c.alias(k) for k, c in outs.items()])


def seeded_rank(df: DataFrame, seed: int | str, id_col: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based position of each row in a seeded shuffle, per group if ``by`` is given."""
    keyed = df.withColumn("_k", seeded_key(seed, id_col))
    return running(keyed, ["_k", id_col], by, row_no=out, hashed=True).drop("_k")


def number_rows(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "row_no") -> DataFrame:
    """1-based row number over a numeric order."""
    return running(df, order, by, row_no=out)
