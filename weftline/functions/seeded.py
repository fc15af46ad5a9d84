"""Order-free randomness: every draw is a function of a seed and row keys only.

``md5(seed|key...)`` gives the same value whatever the partitioning, the retry or the engine,
so a sample, split or shuffle can be repeated and checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *keys: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_int(seed: int | str, *keys: Column | str) -> Column:
    """Integer in [0, 2**32)."""
    return F.conv(F.substring(seeded_key(seed, *keys), 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Double in [0, 1)."""
    return seeded_int(seed, *keys) / F.lit(4294967296.0)


def seeded_mod(seed: int | str, n: Column | int, *keys: Column | str) -> Column:
    """Integer in [0, n)."""
    return seeded_int(seed, *keys) % (F.lit(n) if isinstance(n, int) else n)
