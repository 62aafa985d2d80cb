"""Features of window series, and their selection.

A sample's matrix is turned into one series per feature, and all statistics come from
native array functions on it, so nothing is exchanged and samples with equal keys stay
apart. Missing steps are left out of a series; the trend keeps the step numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.functions.arrays import quantile, total
from onsetframe.functions.ranking import grouped_quantile, with_rows_below
from onsetframe.functions.tails import two_sided_normal
from onsetframe.operators.windows import MATRIX
from onsetframe.schemas import KEYS

NAME, FEATURE, VALUE = "name", "feature", "value"

_RAW, _S, _STEPS, _ORDERED, _TOTAL = "_raw", "_s", "_steps", "_ordered", "_total"
_MEAN, _N, _MID = "_mean", "_n", "_mid"


@dataclass(frozen=True)
class Group:
    """A group of statistics: per-series values, sums of a term (value, place), final formulas."""

    scalars: dict[str, Column]
    sums: dict[str, Callable[[Column, Column], Column]]
    stats: dict[str, Column]


def series_table(windows: DataFrame, features: list[str]) -> DataFrame:
    """One row per sample and feature: the steps, the present values and their step numbers."""
    others = [c for c in windows.columns if c != MATRIX]

    def column(position: int) -> Column:
        return F.transform(MATRIX, lambda row: F.get(row, F.lit(position)))

    series = F.array(*[F.struct(F.lit(f).alias(FEATURE), column(j).alias("raw")) for j, f in enumerate(features)])
    table = windows.select(*others, F.explode(series).alias("_f")).select(*others, f"_f.{FEATURE}", F.col("_f.raw").alias(_RAW))
    numbers = F.sequence(F.lit(0), F.size(_RAW) - 1)
    return (
        table.withColumn(_S, F.array_compact(_RAW))
        .withColumn(_STEPS, F.filter(numbers, lambda i: F.get(F.col(_RAW), i).isNotNull()))
        .withColumn(_N, F.size(_S))
        .withColumn(_TOTAL, total(F.col(_S)))
        .withColumn(_MEAN, F.when(F.col(_N) > 0, F.col(_TOTAL) / F.col(_N)))
        .withColumn(_MID, F.when(F.col(_N) > 0, total(F.col(_STEPS)) / F.col(_N)))
        .withColumn(_ORDERED, F.sort_array(_S))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _present(value: Column) -> Column:
    return F.when(F.col(_N) > 0, value)


def _before(place: Column, lag: int) -> Column:
    """The present value ``lag`` places earlier; NULL before the first."""
    return F.get(F.col(_S), place - lag)


def _off(value: Column) -> Column:
    return value - F.col(_MEAN)


def _sum(term: Callable[[Column, Column], Column]) -> Column:
    """Sum of the terms that are not NULL; NULL without one."""
    terms = F.array_compact(F.transform(F.col(_S), term))
    return F.when(F.size(terms) > 0, total(terms))


def _count(name: str) -> Column:
    """A sum of ones as a count."""
    return F.coalesce(F.col(name), F.lit(0.0)).cast("int")


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0)


def basic_group() -> Group:
    n, ordered = F.col(_N), F.col(_ORDERED)
    m2 = _ratio(F.col("_d2"), n)
    return Group(
        {
            "median": quantile(ordered, 0.5),
            "min": F.get(ordered, F.lit(0)),
            "max": F.get(ordered, n - 1),
            "q10": quantile(ordered, 0.1),
            "q25": quantile(ordered, 0.25),
            "q75": quantile(ordered, 0.75),
            "q90": quantile(ordered, 0.9),
            "missing_share": F.lit(1.0) - n / F.size(_RAW),
        },
        {
            "_d2": lambda v, _: _off(v) * _off(v),
            "_d3": lambda v, _: _off(v) * _off(v) * _off(v),
            "_d4": lambda v, _: _off(v) * _off(v) * _off(v) * _off(v),
            "_energy": lambda v, _: v * v,
        },
        {
            "count": n,
            "sum": _present(F.col(_TOTAL)),
            "mean": F.col(_MEAN),
            "median": F.col("median"),
            "min": F.col("min"),
            "max": F.col("max"),
            "range": F.col("max") - F.col("min"),
            "stddev_pop": F.sqrt(m2),
            "var_pop": m2,
            "rms": F.sqrt(_ratio(F.col("_energy"), n)),
            "abs_energy": F.col("_energy"),
            "skew": _ratio(_ratio(F.col("_d3"), n), m2 * F.sqrt(m2)),
            "kurtosis": _ratio(_ratio(F.col("_d4"), n), m2 * m2) - 3,
            **{q: F.col(q) for q in ("q10", "q25", "q75", "q90", "missing_share")},
        },
    )


def change_group() -> Group:
    n, mean = F.col(_N), F.col(_MEAN)
    return Group(
        {"_ends": F.get(F.col(_S), n - 1) - F.get(F.col(_S), F.lit(0))},
        {
            "_abs": lambda v, p: F.abs(v - _before(p, 1)),
            "_squares": lambda v, p: (v - _before(p, 1)) * (v - _before(p, 1)),
            "zero_crossings": lambda v, p: _one((v > 0) != (_before(p, 1) > 0)),
            "mean_crossings": lambda v, p: _one((v > mean) != (_before(p, 1) > mean)),
        },
        {
            "mean_abs_change": _ratio(F.col("_abs"), n - 1),
            "mean_change": _ratio(F.col("_ends"), n - 1),
            "abs_sum_of_changes": _present(F.coalesce("_abs", F.lit(0.0))),
            "cid": _present(F.sqrt(F.coalesce("_squares", F.lit(0.0)))),
            "zero_crossings": _count("zero_crossings"),
            "mean_crossings": _count("mean_crossings"),
        },
    )


def location_group() -> Group:
    """Positions are shares of the series length, counted over the present values."""
    s, n, mean = F.col(_S), F.col(_N), F.col(_MEAN)
    low, top = F.get(F.col(_ORDERED), F.lit(0)), F.get(F.col(_ORDERED), n - 1)
    scalars = {
        "first": F.get(s, F.lit(0)),
        "last": F.get(s, n - 1),
        "first_location_max": _ratio(F.array_position(s, top) - 1, n),
        "last_location_max": _present(1 - (F.array_position(F.reverse(s), top) - 1) / n),
        "first_location_min": _ratio(F.array_position(s, low) - 1, n),
        "last_location_min": _present(1 - (F.array_position(F.reverse(s), low) - 1) / n),
    }
    sums = {"count_above_mean": lambda v, _: _one(v > mean), "count_below_mean": lambda v, _: _one(v < mean)}
    return Group(scalars, sums, {**{k: F.col(k) for k in scalars}, **{k: _count(k) for k in sums}})


def _step_off(place: Column) -> Column:
    return F.get(F.col(_STEPS), place) - F.col(_MID)


def trend_group() -> Group:
    """Least squares of the values on the step numbers."""
    sxx, sxy, syy = F.col("_sxx"), F.col("_sxy"), F.col("_syy")
    slope = _ratio(sxy, sxx)
    return Group(
        {},
        {
            "_sxx": lambda _, p: _step_off(p) * _step_off(p),
            "_sxy": lambda v, p: _step_off(p) * _off(v),
            "_syy": lambda v, _: _off(v) * _off(v),
        },
        {
            "slope": slope,
            "intercept": F.col(_MEAN) - slope * F.col(_MID),
            "r2": F.coalesce(_ratio(sxy * sxy, sxx * syy), F.when(sxx != 0, F.lit(1.0))),
        },
    )


def _lagged(lag: int) -> Callable[[Column, Column], Column]:
    return lambda v, p: _off(v) * _off(_before(p, lag))


def autocorr_group(lags: tuple[int, ...] = (1, 2, 3)) -> Group:
    """Mean product of centred values a lag apart, over the population variance."""
    n = F.col(_N)
    variance = _ratio(F.col("_var"), n)
    return Group(
        {},
        {
            "_var": lambda v, _: _off(v) * _off(v),
            **{f"_lag{k}": _lagged(k) for k in lags},
        },
        {f"autocorr_{k}": F.when(n > k, _ratio(F.col(f"_lag{k}") / (n - k), variance)) for k in lags},
    )


def _longest_run(series: Column, holds) -> Column:
    """Longest run of neighbours that meet a condition."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(holds(v), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(series, start, step, lambda acc: acc["best"])


def strike_group() -> Group:
    s = F.col(_S)
    scalars = {
        "longest_strike_above_mean": _longest_run(s, lambda v: v > F.col(_MEAN)),
        "longest_strike_below_mean": _longest_run(s, lambda v: v < F.col(_MEAN)),
    }
    return Group(scalars, {}, {k: F.col(k) for k in scalars})


GROUPS = {
    "basic": basic_group,
    "change": change_group,
    "location": location_group,
    "trend": trend_group,
    "autocorr": autocorr_group,
    "strike": strike_group,
}


def extract_features(
    windows: DataFrame, features: list[str], groups: list[str] | None = None, keys: list[str] | None = None
) -> DataFrame:
    """One row per sample and feature with a column per statistic.

    ``keys`` identify a sample (default: the two key columns); other columns but the matrix
    are dropped.
    """
    keys = keys or KEYS
    chosen = [GROUPS[g]() for g in groups or list(GROUPS)]
    table = series_table(windows.select(*keys, MATRIX), features)
    scalars = {k: v for g in chosen for k, v in g.scalars.items()}
    sums = {k: v for g in chosen for k, v in g.sums.items()}
    stats = {k: v for g in chosen for k, v in g.stats.items()}
    table = table.withColumns(scalars) if scalars else table
    table = table.withColumns({k: _sum(term) for k, term in sums.items()}) if sums else table
    return table.select(*keys, FEATURE, *[v.alias(k) for k, v in stats.items()])


def stat_names(groups: list[str] | None = None) -> list[str]:
    """Statistics of the groups, in column order."""
    return [n for g in groups or list(GROUPS) for n in GROUPS[g]().stats]


def long_feature_table(extracted: DataFrame, stats: list[str]) -> DataFrame:
    """One row per sample and named feature ``<feature>__<stat>``."""
    others = [c for c in extracted.columns if c not in (*stats, FEATURE)]
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias(VALUE)) for s in stats])
    return extracted.select(*others, FEATURE, F.explode(cells).alias("_c")).select(
        *others, F.concat_ws("__", F.col(FEATURE), F.col("_c.stat")).alias(NAME), F.col("_c.value").alias(VALUE)
    )


def wide_feature_table(table: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per sample, the named features as columns."""
    keys = keys or KEYS
    columns = [F.max(F.when(F.col(NAME) == n, F.col(VALUE))).alias(n) for n in names]
    return table.where(F.col(NAME).isin(names)).groupBy(*keys).agg(*columns)


def impute_feature_table(table: DataFrame) -> DataFrame:
    """NULL -> median, +inf -> maximum, -inf -> minimum of the feature's finite values; 0 if none."""
    infinite = F.abs(F.col(VALUE)) == float("inf")
    missing = F.col(VALUE).isNull() | F.isnan(VALUE)
    finite = table.where(~missing & ~infinite)
    medians = grouped_quantile(finite, [NAME], VALUE, 0.5, "_median")
    ends = finite.groupBy(NAME).agg(F.max(VALUE).alias("_max"), F.min(VALUE).alias("_min"))
    fills = ends.join(medians, NAME)
    zero = F.lit(0.0)
    value = (
        F.when(missing, F.coalesce("_median", zero))
        .when(F.col(VALUE) == float("inf"), F.coalesce("_max", zero))
        .when(F.col(VALUE) == float("-inf"), F.coalesce("_min", zero))
        .otherwise(F.col(VALUE))
    )
    return table.join(fills, NAME, "left").withColumn(VALUE, value).drop("_median", "_max", "_min")


# --- relevance -----------------------------------------------------------------------


def rank_sum_test(table: DataFrame, label: str = "label") -> DataFrame:
    """Rank-sum statistic of every feature against a 0/1 label.

    Output ``(name, n1, n0, u, z)``: U of the positive rows, and z with tie and continuity
    correction. Rows are reduced to counts per value first, ranks come from these counts.
    """
    counts = (
        table.where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))  # a missing value has no rank
        .groupBy(NAME, VALUE)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"),
        )
    )
    ranked = with_rows_below(counts, [NAME], VALUE)
    midrank = F.col("rows_below") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = ranked.groupBy(NAME).agg(
        F.sum("positives").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).alias("n0"),
        F.sum(F.col("positives") * midrank).alias("_ranks"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = n1 + n0
    u = F.col("_ranks") - n1 * (n1 + 1) / 2
    variance = n1 * n0 / 12 * (total + 1 - F.col("_ties") / (total * (total - 1)))
    off = F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0))
    z = F.when(variance > 0, F.signum(F.col("u") - n1 * n0 / 2) * off / F.sqrt(variance))
    return sums.withColumn("u", u).withColumn("z", z).select(NAME, "n1", "n0", "u", "z")


def false_discovery(tests: DataFrame, fdr: float = 0.05, independent: bool = False, within: list[str] = ()) -> DataFrame:
    """Add ``relevant``: kept at a false discovery rate (Yekutieli's bound, or Hochberg's if independent).

    ``tests`` has one row per feature (and ``within`` columns) with a ``p_value``, so its order is a small one.
    """
    family = Window.partitionBy(*within)
    placed = tests.withColumn("_k", F.row_number().over(family.orderBy("p_value", NAME)))
    placed = placed.withColumn("_m", F.count(F.lit(1)).over(family))
    harmonic = F.lit(1.0) if independent else F.sum(1 / F.col("_k")).over(family)
    judged = placed.withColumn("_passes", F.col("p_value") <= F.col("_k") / (F.col("_m") * harmonic) * F.lit(fdr))
    last = F.max(F.when(F.col("_passes"), F.col("_k"))).over(family)
    return judged.withColumn("relevant", F.coalesce(F.col("_k") <= last, F.lit(False))).drop("_m", "_k", "_passes")


def select_relevant(tests: DataFrame, fdr: float = 0.05, independent: bool = False) -> DataFrame:
    """Features of the rank-sum test kept at a false discovery rate, with their p-value."""
    return false_discovery(tests.withColumn("p_value", two_sided_normal(F.col("z"))), fdr, independent)


def relevant_names(selected: DataFrame) -> list[str]:
    """Kept feature names, sorted; bounded by the catalogue."""
    return sorted(r[0] for r in selected.where("relevant").select(NAME).collect())
