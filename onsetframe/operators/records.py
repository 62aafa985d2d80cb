"""From measurement events to a time grid and to calendar periods."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from onsetframe.functions.periods import needs_origin, period_end, period_index, time_bin
from onsetframe.functions.ranking import grouped_quantile, running_totals
from onsetframe.schemas import PATIENT
from onsetframe.session import checkpointed
from onsetframe.sources.tables import as_time

ID, TIME, VALUE, BIN = "analysis_id", "analysis_time", "analysis_value", "time_bin"
PERIOD, INDEX = "period_end", "period_index"

Aggregate = Callable[[Column, Column, Column], Column]


def _order(value: Column, time: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(time, value))


# Aggregates over the rows of one cell. ``here`` marks the rows of the cell's analysis,
# ``value`` is NULL elsewhere; a cell without rows stays NULL.
AGGREGATES: dict[str, Aggregate] = {
    "mean": lambda value, time, here: F.avg(value),
    "min": lambda value, time, here: F.min(value),
    "max": lambda value, time, here: F.max(value),
    "sum": lambda value, time, here: F.sum(F.when(here, F.coalesce(value, F.lit(0.0)))),
    "prod": lambda value, time, here: F.product(F.when(here, F.coalesce(value, F.lit(1.0)))),
    "count": lambda value, time, here: F.sum(F.when(here, value.isNotNull().cast("int"))).cast("double"),
    "size": lambda value, time, here: F.sum(F.when(here, F.lit(1))).cast("double"),
    "nunique": lambda value, time, here: F.when(
        F.max(here.cast("int")) == 1, F.count_distinct(value)
    ).cast("double"),
    "std": lambda value, time, here: F.stddev_samp(value),
    "var": lambda value, time, here: F.var_samp(value),
    "sem": lambda value, time, here: F.stddev_samp(value) / F.sqrt(F.count(value)),
    "first": lambda value, time, here: F.min_by(value, _order(value, time)),
    "last": lambda value, time, here: F.max_by(value, _order(value, time)),
}


def clean_events(events: DataFrame, ids: list | None = None) -> DataFrame:
    """Events with a patient and a time, of the selected analyses.

    The filters are plain predicates on stored columns and reach the Parquet scan.
    """
    kept = events.where(F.col(PATIENT).isNotNull() & F.col(TIME).isNotNull())
    if ids is not None:
        kept = kept.where(F.col(ID).isin(list(ids)))
    value = F.col(VALUE).cast("double")
    cleaned = kept.select(
        PATIENT, ID, as_time(kept, TIME).alias(TIME), F.when(~F.isnan(value), value).alias(VALUE)
    )
    return cleaned.where(F.col(TIME).isNotNull())


def analysis_ids(events: DataFrame) -> list:
    """All analysis ids of a table, sorted; their number is bounded by the analysis lookup."""
    return sorted(row[0] for row in events.select(ID).where(F.col(ID).isNotNull()).distinct().collect())


def _with_bin(events: DataFrame, freq: str) -> DataFrame:
    if needs_origin(freq):
        first = events.groupBy(PATIENT).agg(F.min(TIME).alias("_origin"))
        return events.join(first, PATIENT).withColumn(BIN, time_bin(TIME, freq, F.col("_origin"))).drop("_origin")
    return events.withColumn(BIN, time_bin(TIME, freq))


def long_records(events: DataFrame, freq: str = "h", aggfunc: str | Callable = "mean") -> DataFrame:
    """One row per ``(patient, bin, analysis)``: the sparse form for many analyses."""
    binned = _with_bin(events, freq)
    keys = [PATIENT, BIN, ID]
    if aggfunc == "median":
        return grouped_quantile(binned, keys, VALUE, 0.5, VALUE, refine=False)
    value = aggfunc(F.col(VALUE)) if callable(aggfunc) else AGGREGATES[aggfunc](F.col(VALUE), F.col(TIME), F.lit(True))
    return binned.groupBy(*keys).agg(value.alias(VALUE)).where(F.col(VALUE).isNotNull())


def plain_aggregate(function: Callable) -> Callable[[Column], Column]:
    """A plain Python function of a cell's present values (a pandas Series) as ``aggfunc``.

    It runs on Arrow batches of cells. A cell's values meet in one task, as the function can't be taken apart; the
    built-in names have no such limit.
    """

    @pandas_udf("double")
    def aggregate(values: pd.Series) -> float:
        present = values.dropna()
        return float(function(present)) if len(present) else float("nan")

    return lambda value: F.nanvl(aggregate(value), F.lit(None).cast("double"))


def _moment(value: Column, n: Column, centre: Column) -> Column:
    """Sum of squares about the mean, from values moved by ``centre``."""
    off = value - centre
    count = F.sum(F.when(value.isNotNull(), n))
    return F.greatest(F.sum(n * off * off) - F.sum(n * off) * F.sum(n * off) / count, F.lit(0.0))


def _at(position: Column) -> Column:
    """The value at a place of the cell's ordered values."""
    inside = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))
    return F.max(F.when(inside, F.col(VALUE)))


def _quantile(q: float) -> Column:
    place = (F.col("n_total") - 1) * F.lit(float(q))
    low, high = _at(F.floor(place)), _at(F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def cell_statistics(events: DataFrame, freq: str, names: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Many aggregates of each ``(patient, bin, analysis)`` cell, one column each, from one pass over the events.

    Events are reduced to one row per distinct value of a cell, with its number and first and last time; every aggregate
    starts from these. Order statistics (``median``, ``mode``, ``quantiles`` by name) use running totals over buckets of values, so a cell
    with a large part of all events is spread over tasks too. NULL as in :data:`AGGREGATES`.
    """
    keys = [PATIENT, BIN, ID]
    value, n = F.col(VALUE), F.col("n")
    counts = checkpointed(
        _with_bin(events, freq).groupBy(*keys, VALUE).agg(
            F.count(F.lit(1)).alias("n"), F.min(TIME).alias("_first"), F.max(TIME).alias("_last")
        )
    )
    quantiles = dict(quantiles or {})
    if "median" in names:
        quantiles["median"] = 0.5
    # sums of squares are taken about the mean of the analysis, so that large means don't eat the digits
    centres = counts.groupBy(ID).agg((F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))).alias("_centre"))
    rows = counts.withColumns({"n_below": F.lit(None).cast("long"), "n_total": F.lit(None).cast("long")})
    if quantiles:
        ranked = running_totals(counts.where(value.isNotNull()), keys, VALUE, ["n"])
        rows = ranked.unionByName(rows.where(value.isNull()))
    rows = rows.join(centres, ID)
    count = F.sum(F.when(value.isNotNull(), n))
    square = _moment(value, n, F.col("_centre"))
    variance = F.when(count > 1, square / (count - 1))
    known = {
        "mean": F.sum(value * n) / count,
        "min": F.min(value),
        "max": F.max(value),
        "sum": F.sum(F.coalesce(value * n, F.lit(0.0))),
        "prod": F.product(F.coalesce(F.pow(value, n), F.lit(1.0))),
        "count": F.coalesce(count, F.lit(0)).cast("double"),
        "size": F.sum(n).cast("double"),
        "nunique": F.count(value).cast("double"),
        "std": F.sqrt(variance),
        "var": variance,
        "sem": F.sqrt(variance) / F.sqrt(count),
        "first": F.min_by(value, F.when(value.isNotNull(), F.struct("_first", value))),
        "last": F.max_by(value, F.when(value.isNotNull(), F.struct("_last", value))),
        "mode": F.min(F.when(value.isNotNull(), F.struct(-n, value)))[VALUE],
        **{name: _quantile(q) for name, q in quantiles.items()},
    }
    wanted = [*names, *[q for q in quantiles if q not in names]]
    return rows.groupBy(*keys).agg(*[known[name].alias(name) for name in wanted])


def grid_records(
    events: DataFrame, ids: list | None = None, freq: str = "h", aggfunc: str | Callable = "mean"
) -> DataFrame:
    """Time grid: one row per ``(patient, bin)``, one column per analysis.

    ``events`` come from :func:`clean_events`. All columns are aggregated in one pass
    with a partial aggregate before the only exchange. ``aggfunc`` is a name or a
    function ``Column -> aggregate Column``. Rows without any value are dropped. Without
    ``ids`` every analysis that occurs gets a column.
    """
    if ids is None:
        ids = analysis_ids(events)
    names = [str(i) for i in ids]
    if aggfunc == "median":
        cells = long_records(events.where(F.col(ID).isin(list(ids))), freq, "median")
        columns = [F.max(F.when(F.col(ID) == i, F.col(VALUE))).alias(n) for i, n in zip(ids, names)]
        return cells.groupBy(PATIENT, BIN).agg(*columns)
    binned = _with_bin(events, freq)
    columns = []
    for i, n in zip(ids, names):
        here = F.col(ID) == i
        value = F.when(here, F.col(VALUE))
        agg = aggfunc(value) if callable(aggfunc) else AGGREGATES[aggfunc](value, F.col(TIME), here)
        columns.append(agg.alias(n))
    return drop_empty(binned.groupBy(PATIENT, BIN).agg(*columns), names)


def drop_empty(df: DataFrame, features: list[str]) -> DataFrame:
    """Drop rows whose features are all NULL."""
    return df.where(F.coalesce(*[F.col(f"`{f}`").cast("double") for f in features]).isNotNull())


def select_features(records: DataFrame, ids: list) -> DataFrame:
    """Fixed feature columns in the given order: absent ones NULL, others dropped."""
    wanted = [str(i) for i in ids]
    keys = [c for c in (PATIENT, BIN, PERIOD, INDEX) if c in records.columns]
    present = set(records.columns)
    features = [F.col(f"`{n}`") if n in present else F.lit(None).cast("double").alias(n) for n in wanted]
    return records.select(*keys, *features)


def resample(records: DataFrame, features: list[str], unit: str, time: str = BIN) -> DataFrame:
    """Mean per calendar period of the grid rows, labelled by the period's last day.

    Output ``(patient_id, period_end, period_index, features...)``. Works on any rows with
    a time column; periods without a value are dropped.
    """
    means = [F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features]
    periods = records.groupBy(PATIENT, period_end(time, unit).alias(PERIOD)).agg(*means)
    with_index = periods.select(
        PATIENT, PERIOD, period_index(PERIOD, unit).alias(INDEX), *[F.col(f"`{f}`") for f in features]
    )
    return drop_empty(with_index, features)


def resample_long(records: DataFrame, unit: str) -> DataFrame:
    """Period means of the sparse form: one row per ``(patient, period, analysis)``.

    With many analyses the sparse form moves only the values that exist; a wide grid would
    move a column per analysis.
    """
    return (
        records.groupBy(PATIENT, period_end(BIN, unit).alias(PERIOD), ID)
        .agg(F.avg(VALUE).alias(VALUE))
        .where(F.col(VALUE).isNotNull())
    )


def pivot_periods(long_periods: DataFrame, ids: list, unit: str) -> DataFrame:
    """Sparse period means of the chosen analyses as one row per period, like :func:`resample`."""
    cells = [F.max(F.when(F.col(ID) == i, F.col(VALUE))).alias(str(i)) for i in ids]
    wide = long_periods.where(F.col(ID).isin(list(ids))).groupBy(PATIENT, PERIOD).agg(*cells)
    return wide.select(
        PATIENT, PERIOD, period_index(PERIOD, unit).alias(INDEX), *[F.col(f"`{i}`") for i in ids]
    )
