"""Evaluate a sub-expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An outer expression used inside a lambda is computed again for every element; bound to a lambda
    variable it is not.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def once(value: Column) -> Column:
    """``value`` as a column of its own: what explode gives isn't worked out again where it is used, nor moved into filters."""
    return F.explode(F.array(value))
