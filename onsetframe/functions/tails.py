"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_BELOW = 3.0  # the series of erf up to here, the continued fraction of erfc beyond
_TERMS = 80


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number."""
    square = x * x

    def add(state: Column, n: Column) -> Column:
        term = state["term"] * 2 * square / (2 * n + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(x.alias("term"), x.alias("sum"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, add, lambda s: s["sum"]) * F.exp(-square) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), F.lit(1.0), lambda t, k: 1 + k / (2 * square) / t)
    return F.when(x < SERIES_BELOW, 1 - erf).otherwise(F.exp(-square) / (x * math.sqrt(math.pi)) / fraction)


def two_sided_normal(z: Column) -> Column:
    """Two-sided p-value of a normal statistic, 1 if it is NULL."""
    return F.coalesce(erfc(F.abs(z) / math.sqrt(2)), F.lit(1.0))


def kolmogorov(scaled: Column) -> Column:
    """Probability that the largest distance of two empirical distributions, times the root of the
    effective sample size, passes a value; the limit for many samples."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(_TERMS)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled)
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2 x 2 table: all tables with its margins that are no likelier than it.

    The tails are summed outward from where they begin until the terms vanish, so the work grows with the
    spread of the distribution, not with the counts.
    """
    first, second, column = a + b, c + d, a + c
    low, high = max(0, column - second), min(first, column)
    whole = _log_choose(first + second, column)

    def chance(k: int) -> float:
        return math.exp(_log_choose(first, k) + _log_choose(second, column - k) - whole)

    limit = chance(a) * (1 + 1e-7)
    mode = min(max((column + 1) * (first + 1) // (first + second + 2), low), high)

    def tail(inner: int, end: int, step: int) -> float:
        """Sum from the first place at or beyond ``inner`` within the limit, to ``end``."""
        if (end - inner) * step < 0 or chance(end) > limit:
            return 0.0
        near, far = inner, end  # chance falls from near to far
        while near != far:
            middle = near + (far - near) // 2 if step > 0 else near - (near - far) // 2
            if chance(middle) <= limit:
                far = middle
            else:
                near = middle + step
        total, k, term = 0.0, near, chance(near)
        while (end - k) * step >= 0 and term > total * 1e-17:
            total += term
            # ratio of neighbouring terms
            if step > 0:
                term *= (first - k) * (column - k) / ((k + 1) * (second - column + k + 1))
            else:
                term *= k * (second - column + k) / ((first - k + 1) * (column - k + 1))
            k += step
        return total

    if chance(mode) <= limit:
        return 1.0
    return min(1.0, tail(mode + 1, high, 1) + tail(mode - 1, low, -1))
