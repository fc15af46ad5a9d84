"""Multiset arithmetic on arrays, inside the row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.scoped import let


def numbered(bag: Column) -> Column:
    """Tag every element with its occurrence number, so equal multisets become equal sets."""
    return let(
        F.array_sort(bag),
        lambda s: F.transform(
            s, lambda x, i: F.concat_ws("\u0001", x, (i - F.array_position(s, x) + 1).cast("string"))
        ),
    )


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection; sets (no repeats on either side) skip the numbering."""
    plain = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    both = lambda x, y: F.when(plain(x) | plain(y), F.size(F.array_intersect(x, y))).otherwise(
        F.size(F.array_intersect(numbered(x), numbered(y)))
    )
    return let(a, lambda x: let(b, lambda y: both(x, y))).cast("long")


def f1(overlap: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of overlap/n_pred and overlap/n_ref; 0 without overlap."""
    return F.when(overlap > 0, 2.0 * overlap / (n_pred + n_ref)).otherwise(F.lit(0.0))
