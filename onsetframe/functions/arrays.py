"""Array expressions that bind a value once.

The optimizer may inline a computed column into a lambda that uses it, where it would be
computed again for every element. A bound value is an element of a one-entry array and is
computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def total(array: Column) -> Column:
    """Sum in array order, 0 if empty."""
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation on an ascending array, NULL if empty."""
    position = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.get(ordered, F.floor(position).cast("int"))
    high = F.get(ordered, F.ceil(position).cast("int"))
    return low + (high - low) * (position - F.floor(position))
