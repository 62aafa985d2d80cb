"""Scaling and class balancing of window samples.

A balanced set is kept as its distinct samples with a ``weight``, how often each is there. Statistics and
models take the weight; copies are made at the end, if they are asked for at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.functions.ranking import hash_number, number_by_hash
from onsetframe.operators.labels import LABEL
from onsetframe.operators.samples import Statistic, apply_column_fill, fit_column_fill, impute_windows
from onsetframe.operators.windows import MATRIX
from onsetframe.schemas import KEYS
from onsetframe.session import checkpointed

COPY, TIMES, WEIGHT = "copy", "times", "weight"
PICK_CHUNK = 10_000  # picks one row makes


# --- scaling -------------------------------------------------------------------------


def _spread(sd: Column) -> Column:
    return F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def _merged_moments(alike: DataFrame, keys: list[str]) -> DataFrame:
    """``mu, sd`` per key from the moments of groups: rows times weight ``_n``, ``_mu``, ``_var``.

    Squares are taken about the common mean, so nothing large is subtracted.
    """
    whole = Window.partitionBy(*keys)
    total = F.sum("_n").over(whole)
    mean = F.sum(F.col("_n") * F.col("_mu")).over(whole) / F.when(total > 0, total)
    off = F.col("_mu") - F.col("mu")
    parts = alike.withColumn("mu", mean).withColumn("_part", F.col("_n") * (F.col("_var") + off * off))
    sd = F.sqrt(F.sum("_part") / F.when(F.sum("_n") > 0, F.sum("_n")))
    return parts.groupBy(*keys).agg(F.first("mu").alias("mu"), _spread(sd).alias("sd"))


def _matrix_moments(train: DataFrame, width: int, by_step: bool, weight: str | None) -> DataFrame:
    """``step, j, mu, sd``: the moments of a feature, per step or over all of them (``step`` 0)."""
    carried = [weight] if weight else []
    rows = train.select(*carried, F.posexplode(MATRIX).alias("step", "_row"))
    step = F.col("step") if by_step else F.lit(0)
    if weight is None:
        cells = [
            F.struct(F.avg(F.col("_row")[j]).alias("mu"), _spread(F.stddev_pop(F.col("_row")[j])).alias("sd")) for j in range(width)
        ]
        per_step = rows.groupBy(step.alias("step")).agg(F.array(*cells).alias("cells"))
        return per_step.select("step", F.posexplode("cells").alias("j", "c")).select("step", "j", "c.mu", "c.sd")
    # one row for each step and weight, all features in it, before cells become rows
    alike = rows.groupBy(step.alias("step"), weight).agg(F.array(*[
        F.struct(
            (F.count(F.col("_row")[j]) * F.col(weight)).alias("_n"), F.avg(F.col("_row")[j]).alias("_mu"), F.var_pop(F.col("_row")[j]).alias("_var")
        ) for j in range(width)
    ]).alias("cells"))
    cells = alike.select("step", F.posexplode("cells").alias("j", "c")).select("step", "j", "c.*")
    return _merged_moments(cells, ["step", "j"])


def fit_cell_scaler(train: DataFrame, width: int, weight: str | None = None) -> DataFrame:
    """Mean and population spread per (step, feature), as one row.

    The exploded steps are reduced to one row per step (and weight) before the exchange, so the
    result is bounded by the window shape.
    """
    return _as_stats(_matrix_moments(train, width, True, weight))


def fit_feature_scaler(train: DataFrame, width: int, steps: int, weight: str | None = None) -> DataFrame:
    """Mean and population spread per feature over all steps, in the shape of the cell scaler."""
    one = _as_stats(_matrix_moments(train, width, False, weight))
    return one.select(F.array_repeat(F.get("stats", F.lit(0)), steps).alias("stats"))


def _as_stats(moments: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("j", F.struct("mu", "sd").alias("cell"))))
    per_step = moments.groupBy("step").agg(F.transform(ordered, lambda s: s["cell"]).alias("cells"))
    steps = F.sort_array(F.collect_list(F.struct("step", "cells")))
    return per_step.agg(F.transform(steps, lambda s: s["cells"]).alias("stats"))


def apply_scaler(samples: DataFrame, scaler: DataFrame) -> DataFrame:
    """Standardise with fitted statistics; they enter as a scalar subquery of fixed size."""
    def scaled_row(row: Column, cells: Column) -> Column:
        return F.zip_with(row, cells, lambda v, c: (v - c["mu"]) / c["sd"])

    return (
        samples.withColumn("_stats", scaler.scalar())
        .withColumn(MATRIX, F.zip_with(F.col(MATRIX), F.col("_stats"), scaled_row))
        .drop("_stats")
    )


def fit_vector_scaler(train: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Mean and population spread of flat columns, as one row."""
    if weight is None:
        return train.agg(F.struct(*[
            F.struct(F.avg(c).alias("mu"), _spread(F.stddev_pop(c)).alias("sd")).alias(c) for c in columns
        ]).alias("stats"))
    alike = train.groupBy(weight).agg(F.array(*[
        F.struct(
            F.lit(c).alias("name"), (F.count(c) * F.col(weight)).alias("_n"), F.avg(c).alias("_mu"), F.var_pop(c).alias("_var")
        ) for c in columns
    ]).alias("cells"))
    moments = _merged_moments(alike.select(F.inline("cells")), ["name"])
    pair = F.struct("mu", "sd")
    return moments.agg(F.struct(*[F.max(F.when(F.col("name") == c, pair)).alias(c) for c in columns]).alias("stats"))


def apply_vector_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    scaled = {c: (F.col(c) - F.col("_stats")[c]["mu"]) / F.col("_stats")[c]["sd"] for c in columns}
    return df.withColumn("_stats", scaler.scalar()).withColumns(scaled).drop("_stats")


# --- oversampling --------------------------------------------------------------------


def _missing_rows(classes: DataFrame, ratio: float | str) -> DataFrame:
    """Per class the number of rows to add; ``classes`` has one row per class."""
    majority = F.max("rows").over(Window.partitionBy())
    if ratio == "auto":
        need = majority - F.col("rows")
    else:
        floor = F.floor(F.lit(float(ratio)) * majority - F.col("rows"))
        need = F.when(F.col("rows") == majority, F.lit(0).cast("long")).when(floor <= 0, F.raise_error(
            F.lit("the ratio leaves no minority rows to add")
        ).cast("long")).otherwise(floor)
    return classes.withColumn("need", need)


def repeat_counts(
    samples: DataFrame, ratio: float | str = "auto", seed: int = 0, label: str = LABEL, keys: list[str] | None = None
) -> DataFrame:
    """How often each sample of a growing class is repeated: ``(keys, times)``, thin rows only.

    Draws with replacement are hash picks of a row number, made in chunks over many tasks and
    summed to one multiplicity per number. Only the classes that grow are numbered.
    """
    keys = keys or KEYS
    classes = samples.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    need = _missing_rows(classes, ratio).where(F.col("need") > 0)
    chunks = need.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1) / PICK_CHUNK)))
    )
    # chunks are thin: without a number of tasks, Spark puts them all into one
    tasks = 2 * samples.sparkSession.sparkContext.defaultParallelism
    chunks = chunks.repartition(tasks, F.col(label), F.col("_chunk"))
    first = F.col("_chunk") * PICK_CHUNK
    last = F.least(first + PICK_CHUNK, F.col("need")) - 1
    picks = chunks.select(label, "rows", F.explode(F.sequence(first, last)).alias("_i"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"), F.col("_i").cast("string"))
    times = (
        picks.withColumn("_number", F.pmod(hash_number(text), F.col("rows")))
        .groupBy(label, "_number")
        .agg(F.count(F.lit(1)).alias(TIMES))
    )
    grows = need.agg(F.collect_list(label)).scalar()  # class names only
    growing = samples.select(label, *keys).withColumn("_grows", grows).where(F.array_contains("_grows", F.col(label)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    numbered = number_by_hash(growing.drop("_grows"), [label], digest, keys, "_number")
    # picks grow with the samples; Spark takes them to be as few as the chunks and would have the driver collect all of them
    return numbered.join(times.hint("merge"), [label, "_number"]).select(*keys, TIMES)


def weigh_samples(samples: DataFrame, counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every sample once, with the number of times it is there as ``weight``."""
    joined = samples.join(counts, keys or KEYS, "left")
    return joined.withColumn(WEIGHT, F.coalesce(F.col(TIMES), F.lit(0).cast("long")) + 1).drop(TIMES)


def copy_samples(weighted: DataFrame) -> DataFrame:
    """Every sample (``copy`` 0) and its repeats (``copy`` 1, 2, ...)."""
    return weighted.withColumn(COPY, F.explode(F.sequence(F.lit(0).cast("long"), F.col(WEIGHT) - 1))).drop(WEIGHT)


def repeat_samples(samples: DataFrame, counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every sample and its repeats, in one pass."""
    return copy_samples(weigh_samples(samples, counts, keys))


def oversample(
    samples: DataFrame,
    ratio: float | str = "auto",
    seed: int = 0,
    label: str = LABEL,
    keys: list[str] | None = None,
) -> DataFrame:
    """Repeat samples of smaller classes, drawn with replacement, until the counts are met.

    ``"auto"`` fills every class up to the largest; a number fills up to that share of the
    largest. Originals stay. The thin table of multiplicities is kept, so a plan that uses the
    result twice draws once.
    """
    counts = repeat_counts(samples, ratio, seed, label, keys)
    return repeat_samples(samples, checkpointed(counts), keys)


# --- chains --------------------------------------------------------------------------


def check_matrix(samples: DataFrame, label: str = LABEL) -> None:
    """Raise unless ``matrix`` is two-level and the samples carry a label."""
    if MATRIX not in samples.columns or samples.schema[MATRIX].dataType.simpleString() != "array<array<double>>":
        raise ValueError("samples need a matrix ARRAY<ARRAY<DOUBLE>> (samples x steps x features)")
    if label not in samples.columns:
        raise ValueError("every sample needs a label")


def prepare_train(
    train: DataFrame,
    width: int,
    imputer: str | Statistic | None = "mean",
    resampler: float | str | None = "auto",
    scale: bool = True,
    seed: int = 0,
    copies: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Impute, balance, scale the training windows; returns the samples and the scaler.

    The scaler is fitted on the balanced set through the weights and kept, as the samples and the test set both read it.
    Without ``copies`` the samples stay distinct and carry their ``weight``. ``train`` is used several times and should
    be a written table.
    """
    check_matrix(train)
    prepared = impute_windows(train, width, imputer) if imputer is not None else train
    weight = None
    if resampler is not None:
        # keys and labels only, imputation is not needed
        prepared, weight = weigh_samples(prepared, checkpointed(repeat_counts(train, resampler, seed))), WEIGHT
    scaler = checkpointed(fit_cell_scaler(prepared, width, weight)) if scale else None
    prepared = apply_scaler(prepared, scaler) if scale else prepared
    return (copy_samples(prepared) if weight and copies else prepared), scaler


def prepare_test(
    test: DataFrame, width: int, imputer: str | Statistic | None = "mean", scaler: DataFrame | None = None
) -> DataFrame:
    """Impute and scale the test windows; they are never balanced."""
    prepared = impute_windows(test, width, imputer) if imputer is not None else test
    return apply_scaler(prepared, scaler) if scaler is not None else prepared


def prepare_flat_train(
    train: DataFrame, columns: list[str], imputer: str | None = "mean", resampler: float | str | None = "auto",
    scale: bool = True, seed: int = 0, copies: bool = True,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The same chain on flat columns; fill values and scaler are fitted and returned."""
    fill = fit_column_fill(train, columns, imputer) if imputer is not None else None
    prepared = apply_column_fill(train, fill, columns) if fill is not None else train
    weight = None
    if resampler is not None:
        prepared, weight = weigh_samples(prepared, checkpointed(repeat_counts(train, resampler, seed))), WEIGHT
    scaler = fit_vector_scaler(prepared, columns, weight) if scale else None
    prepared = apply_vector_scaler(prepared, scaler, columns) if scale else prepared
    return (copy_samples(prepared) if weight and copies else prepared), fill, scaler


def prepare_flat_test(
    test: DataFrame, columns: list[str], fill: DataFrame | None, scaler: DataFrame | None
) -> DataFrame:
    prepared = apply_column_fill(test, fill, columns) if fill is not None else test
    return apply_vector_scaler(prepared, scaler, columns) if scaler is not None else prepared
