"""Sample sets: keys, alignment, imputation, splits, combination of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetframe.functions.arrays import let, quantile, total
from onsetframe.functions.ranking import grouped_quantile, number_by_hash
from onsetframe.operators.labels import LABEL
from onsetframe.operators.windows import MATRIX
from onsetframe.schemas import KEYS, PATIENT

SPLIT, TRAIN, TEST = "split", "train", "test"


def sample_keys(records: DataFrame) -> DataFrame:
    """Distinct keys of a record or label table."""
    return records.select(*KEYS).distinct()


def labels_for(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of every key; a key without label fails the job when it is reached."""
    known = labels.select(*KEYS, LABEL)
    missing = F.raise_error(F.concat_ws(" ", F.lit("no label for"), *[F.col(k).cast("string") for k in KEYS]))
    return keys.join(known, KEYS, "left").withColumn(
        LABEL, F.when(F.col(LABEL).isNotNull(), F.col(LABEL)).otherwise(missing.cast("int"))
    )


def align_to_keys(
    keys: DataFrame, windows: DataFrame, steps: int, width: int, fill: float | None = None
) -> DataFrame:
    """One matrix per key; a key without data gets a matrix of ``fill``."""
    blank = F.array_repeat(F.array_repeat(F.lit(fill).cast("double"), width), steps)
    return keys.join(windows.select(*KEYS, MATRIX), KEYS, "left").withColumn(
        MATRIX, F.coalesce(F.col(MATRIX), blank)
    )


# --- one window: columns of a matrix -------------------------------------------------

Statistic = Callable[[Column], Column]


def column_series(matrix: Column, width: int) -> Column:
    """The matrix turned: one array of steps per feature, missing values removed."""
    features = F.array(*[F.lit(j) for j in range(width)])
    return F.transform(
        features, lambda j: F.filter(F.transform(matrix, lambda row: F.get(row, j)), lambda v: v.isNotNull())
    )


def series_mean(series: Column) -> Column:
    return F.when(F.size(series) > 0, total(series) / F.size(series))


def series_mode(series: Column) -> Column:
    """Most frequent value, the smallest of equally frequent ones."""
    def counted(v: Column) -> Column:
        times = F.size(F.filter(series, lambda w: w == v))
        return F.struct((-times).alias("n"), v.alias("v"))

    return F.array_min(F.transform(F.array_distinct(series), counted))["v"]


STRATEGIES: dict[str, Statistic] = {
    "mean": series_mean,
    "median": lambda s: let(F.sort_array(s), lambda ordered: quantile(ordered, 0.5)),
    "most_frequent": series_mode,
}


def _batch_mean(value: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Means over the steps of ``windows x steps x features``, summed step by step."""
    total = np.zeros(value[:, 0].shape)
    for k in range(value.shape[1]):
        total = np.where(present[:, k], total + value[:, k], total)
    return total / np.maximum(present.sum(axis=1), 1)


def _batch_mode(value: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Most frequent values, NaN equal to itself and the largest."""
    nan = np.isnan(value)
    best, most = np.zeros(value[:, 0].shape), np.zeros(value[:, 0].shape, int)
    for k in range(value.shape[1]):
        here = value[:, k : k + 1]
        times = (present & ((value == here) | (nan & nan[:, k : k + 1]))).sum(axis=1)
        less = (value[:, k] < best) | (np.isnan(best) & ~nan[:, k])
        better = present[:, k] & ((times > most) | (times == most) & less)
        best, most = np.where(better, value[:, k], best), np.where(better, times, most)
    return best


# the same statistics over whole Arrow batches; of windows without a value any number
BATCHED = {"mean": _batch_mean, "most_frequent": _batch_mode}


def _filled_batch(matrices: pa.ListArray, width: int, statistic: Callable) -> pa.ListArray:
    """The matrices with their gaps filled; rows shorter than ``width`` are filled up."""
    rows = matrices.flatten()
    cells = rows.flatten()
    size = pc.list_value_length(rows).fill_null(0).to_numpy()
    wide = max(width, size.max(initial=0))
    inside = np.arange(wide) < size[:, None]
    value, present = np.zeros((len(rows), wide)), np.zeros((len(rows), wide), bool)
    value[inside], present[inside] = cells.to_numpy(zero_copy_only=False), np.asarray(cells.is_valid())
    steps = pc.list_value_length(matrices).fill_null(0).to_numpy()
    start = np.cumsum(steps) - steps
    for n in np.unique(steps[steps > 0]):
        at = start[steps == n][:, None] + np.arange(n)
        some, known = value[at, :width], present[at, :width]
        fill = np.where(known.any(axis=1), statistic(some, known), 0.0)
        value[at, :width] = np.where(known, some, fill[:, None])
    kept = np.maximum(size, width) * np.asarray(rows.is_valid())
    shown = np.arange(wide) < kept[:, None]
    filled = pa.array(value[shown], mask=~(present | (np.arange(wide) < width))[shown])

    def lists(sizes: np.ndarray, values: pa.Array, like: pa.ListArray) -> pa.ListArray:
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=like.is_null())

    return lists(steps, lists(kept, filled, rows), matrices)


def impute_windows(
    windows: DataFrame, width: int, strategy: str | Statistic = "mean", constant: float = 0.0
) -> DataFrame:
    """Fill gaps of each window from that window's own column; 0 if all are missing.

    ``strategy`` is a name or a function from a column's values (array) to a value. The
    work is inside one row, there is no exchange. The names in ``BATCHED`` fill whole Arrow batches.
    """
    if isinstance(strategy, str) and strategy in BATCHED:
        statistic, names = BATCHED[strategy], windows.columns

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [_filled_batch(c, width, statistic) if n == MATRIX else c for n, c in zip(names, batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

        numbers = windows.withColumn(MATRIX, F.col(MATRIX).cast("array<array<double>>"))
        return numbers.mapInArrow(fill, numbers.schema)
    if strategy == "constant":
        fills = F.array_repeat(F.lit(float(constant)), width)
    else:
        statistic = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
        fills = None

    def filled(matrix: Column) -> Column:
        values = fills
        if values is None:
            values = F.transform(column_series(matrix, width), lambda s: F.coalesce(statistic(s), F.lit(0.0)))
        return let(
            values,
            lambda fill: F.transform(matrix, lambda row: F.zip_with(row, fill, lambda v, f: F.coalesce(v, f))),
        )

    return windows.withColumn(MATRIX, let(F.col(MATRIX), filled))


# --- flat tables: statistics from the training rows ----------------------------------


def fit_column_fill(train: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    """One row of fill values per column; a column without values fills with 0."""
    if strategy == "mean":
        return train.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])
    values = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_v")).select("_v.name", "_v.value")
    if strategy == "median":
        fitted = grouped_quantile(values, ["name"], "value", 0.5, "value")
    elif strategy == "most_frequent":
        counts = values.where(F.col("value").isNotNull()).groupBy("name", "value").count()
        fitted = counts.groupBy("name").agg(F.min(F.struct(-F.col("count"), F.col("value")))["value"].alias("value"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return fitted.agg(
        *[F.coalesce(F.max(F.when(F.col("name") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in columns]
    )


def apply_column_fill(df: DataFrame, fill: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing values with the fitted row (one value per column)."""
    values = fill.agg(F.first(F.struct(*columns))).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("_fill")[c]) for c in columns}
    return df.withColumn("_fill", values).withColumns(filled).drop("_fill")


# --- split by patient ----------------------------------------------------------------


def _test_count(n: Column, test_size: float | int) -> Column:
    if isinstance(test_size, int):
        return F.lit(test_size)
    return F.ceil(F.lit(float(test_size)) * n)


def _split_patients(patients: DataFrame, group: list[str], test_size: float | int, seed: int) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(PATIENT).cast("string")))
    numbered = number_by_hash(patients, group, digest, [PATIENT], "_position")
    side = F.when(F.col("_position") < _test_count(F.col("group_rows"), test_size), TEST).otherwise(TRAIN)
    return numbered.select(PATIENT, side.alias(SPLIT))


def patient_sides(samples: DataFrame, test_size: float | int = 0.2, seed: int = 0) -> DataFrame:
    """``(patient_id, split)`` of the patients of the samples."""
    return _split_patients(samples.select(PATIENT).distinct(), [], test_size, seed)


def split_by_patient(samples: DataFrame, test_size: float | int = 0.2, seed: int = 0) -> DataFrame:
    """Add ``split``: exactly ``ceil(test_size * patients)`` patients are test."""
    return samples.join(patient_sides(samples, test_size, seed), PATIENT)


def split_stratified(samples: DataFrame, test_size: float | int = 0.2, seed: int = 0) -> DataFrame:
    """Split positive and negative patients apart, each with its exact share of test patients."""
    patients = samples.groupBy(PATIENT).agg(F.max(LABEL).alias("_class"))
    return samples.join(_split_patients(patients, ["_class"], test_size, seed), PATIENT)


# --- shape changes -------------------------------------------------------------------


def extend_timesteps(samples: DataFrame, steps: int) -> DataFrame:
    """Repeat a single-step matrix along time; longer matrices stay as they are."""
    return samples.withColumn(
        MATRIX,
        F.when(F.size(MATRIX) == 1, F.array_repeat(F.element_at(MATRIX, 1), steps)).otherwise(F.col(MATRIX)),
    )


def single_step(samples: DataFrame, name: str = "vector") -> DataFrame:
    """The last and only step as a flat array."""
    return samples.withColumn(name, F.element_at(MATRIX, 1)).drop(MATRIX)


def flatten_windows(samples: DataFrame, name: str = "vector") -> DataFrame:
    """Row-major flat array of a window."""
    return samples.withColumn(name, F.flatten(MATRIX)).drop(MATRIX)


def feature_series(samples: DataFrame, position: int, name: str = "series") -> DataFrame:
    """The series of one feature of each window."""
    return samples.withColumn(name, F.transform(MATRIX, lambda row: F.get(row, position))).drop(MATRIX)


def _rank_of(df: DataFrame, column: str) -> int:
    return 3 if df.schema[column].dataType.simpleString().startswith("array<array") else 2


def _value_column(df: DataFrame) -> str:
    return MATRIX if MATRIX in df.columns else "vector"


def combine_sources(sources: list[DataFrame], aligned: bool = False) -> DataFrame:
    """Join sources on the keys and append their features.

    All matrices: per step; all vectors: per row; mixed: matrices are flattened first.
    A key absent from one of the sources fails the job when it is reached. Sources that were
    ``aligned`` to the same keys are joined from the first one, which keeps its partitioning,
    so none of the combined windows is moved again.
    """
    columns = [_value_column(s) for s in sources]
    ranks = [_rank_of(s, c) for s, c in zip(sources, columns)]
    same = len(set(ranks)) == 1
    result = None
    for i, (source, column, rank) in enumerate(zip(sources, columns, ranks)):
        value = F.col(column) if same or rank == 2 else F.flatten(column)
        part = source.select(*KEYS, value.alias(f"_s{i}"))
        result = part if result is None else result.join(part, KEYS, "left" if aligned else "full")
    names = [f"_s{i}" for i in range(len(sources))]
    if same and ranks[0] == 3:
        combined = F.col(names[0])
        for name in names[1:]:
            combined = F.zip_with(combined, F.col(name), lambda a, b: F.concat(a, b))
        out = MATRIX
    else:
        combined, out = F.concat(*names) if len(names) > 1 else F.col(names[0]), "vector"
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(name).isNotNull()
    checked = F.when(whole, combined).otherwise(
        F.raise_error(F.lit("sources have different samples")).cast(
            result.select(combined.alias("c")).schema["c"].dataType
        )
    )
    return result.select(*KEYS, checked.alias(out))


