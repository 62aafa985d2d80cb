"""Fixed-length backward windows.

A window is one row per sample: ``matrix ARRAY<ARRAY<DOUBLE>>`` with one entry per
step (oldest first) and one value per feature, NULL where the period has no data.
Per-window work then needs no further exchange.

Records are cut into time blocks longer than the window. A block also receives the
last ``steps - 1`` periods of the block before it, so a window never looks outside
its block and a patient with a long history is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.functions.periods import index_end, period_index
from onsetframe.operators.records import INDEX, PERIOD
from onsetframe.schemas import KEYS, OBSERVED, PATIENT

MATRIX, STEP, STEP_DATE = "matrix", "step", "step_date"
BLOCK_WINDOWS = 4  # a block spans this many windows, so about 1/4 of the rows are copied
MIN_BLOCK = 64

_BLOCK, _ROW, _HISTORY, _SHOWN, _SOURCE = "_block", "_row", "_history", "_shown", "_source"


def _block_span(steps: int) -> int:
    return max(BLOCK_WINDOWS * steps, MIN_BLOCK)


def _home(index: str, span: int) -> Column:
    return F.floor(F.col(index) / span).cast("int")


def _with_blocks(df: DataFrame, steps: int) -> DataFrame:
    """Each row in its own block, and in the next one if a window there reaches it."""
    span = _block_span(steps)
    home = _home(INDEX, span)
    reaches_next = F.col(INDEX) + (steps - 1) >= (home + 1) * span
    blocks = F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(_BLOCK, F.explode(blocks))


def _dense(history: Column, last: Column, steps: int | Column, width: int) -> Column:
    """History entries (ordered by index) with NULL rows for the absent periods."""
    blank = F.array_repeat(F.lit(None).cast("double"), width)
    before_first = last - steps

    def piece(entry: Column, position: Column) -> Column:
        previous = F.coalesce(F.get(history, position - 1)["i"], before_first)
        return F.concat(F.array_repeat(blank, entry["i"] - previous - 1), F.array(entry["r"]))

    newest = F.coalesce(F.get(history, F.size(history) - 1)["i"], before_first)
    return F.concat(F.flatten(F.transform(history, piece)), F.array_repeat(blank, last - newest))


def _entry(features: list[str]) -> Column:
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return F.struct(F.col(INDEX).alias("i"), values.alias("r"))


def own_date_windows(
    periods: DataFrame,
    features: list[str],
    steps: int,
    carry: list[str] | None = None,
    shown: Column | None = None,
) -> DataFrame:
    """A window for every resampled period; the period's last day is the observation date.

    ``carry`` columns are passed on; with ``shown`` only periods that meet the condition
    get a window (the others still are history), so labels can prune before the cut.
    """
    carry = carry or []
    width = len(features)
    date = F.struct(INDEX, F.col(PERIOD).alias(OBSERVED), *carry)
    prepared = periods.select(
        PATIENT,
        INDEX,
        F.when(F.lit(True) if shown is None else shown, date).alias(_SHOWN),
        _entry(features).alias(_ROW),
    )
    blocked = _with_blocks(prepared, steps)
    at_home = F.when(F.col(_BLOCK) == _home(INDEX, _block_span(steps)), F.col(_SHOWN))
    # the block's rows and its dates meet in its first row, where the absent periods are filled once for all windows
    by_index = Window.partitionBy(PATIENT, _BLOCK).orderBy(INDEX)
    whole = by_index.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = blocked.select(
        PATIENT, F.collect_list(_ROW).over(whole).alias(_HISTORY), F.collect_list(at_home).over(whole).alias(_SHOWN),
        F.row_number().over(by_index).alias("_place"),
    ).where((F.col("_place") == 1) & (F.size(_SHOWN) > 0))
    history = F.col(_HISTORY)
    first, last = F.get(history, F.lit(0))["i"], F.get(history, F.size(history) - 1)["i"]
    dense = _dense(history, last, last - first + steps, width)
    # with several rows of a period the windows are longer, and each is filled for itself
    repeated = F.size(dense) > last - first + steps
    filled = met.select(
        PATIENT, _SHOWN, first.alias("_first"), dense.alias(_ROW), F.when(repeated, history).alias(_HISTORY)
    )
    dated = filled.select(PATIENT, "_first", _ROW, _HISTORY, F.inline(_SHOWN))
    reached = F.filter(_HISTORY, lambda e: (e["i"] > F.col(INDEX) - steps) & (e["i"] <= F.col(INDEX)))
    matrix = F.when(
        F.col(_HISTORY).isNull(), F.slice(_ROW, F.col(INDEX) - F.col("_first") + 1, F.lit(steps))
    ).otherwise(_dense(reached, F.col(INDEX), steps, width))
    return dated.select(PATIENT, OBSERVED, *carry, matrix.alias(MATRIX))


def _swept(sources: list[tuple[DataFrame, list[str]]], shown: list[DataFrame], steps: int) -> DataFrame:
    """One pass over the rows of all sources and the dates that get a window.

    Sources and ``shown`` rows (patient, index, date) are merged into the same time blocks; a row with a date takes the
    history of every source with it. Nothing is moved after the matrices are built.
    """
    kind = shown[0].schema[OBSERVED].dataType
    rows = None
    for k, (periods, features) in enumerate(sources):
        values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
        part = periods.select(
            PATIENT, INDEX, F.lit(None).cast(kind).alias(OBSERVED), F.lit(k).alias(_SOURCE),
            F.struct(F.col(INDEX).alias("i"), values.alias("r")).alias(_ROW),
        )
        part = _with_blocks(part, steps)
        rows = part if rows is None else rows.unionByName(part)
    blank = F.lit(None).cast(rows.schema[_ROW].dataType)
    for points in shown:
        placed = points.select(PATIENT, INDEX, OBSERVED, F.lit(-1).alias(_SOURCE), blank.alias(_ROW))
        rows = rows.unionByName(placed.withColumn(_BLOCK, _home(INDEX, _block_span(steps))))
    window = Window.partitionBy(PATIENT, _BLOCK).orderBy(INDEX).rangeBetween(-(steps - 1), 0)
    histories = {
        f"{_HISTORY}{k}": F.collect_list(F.when(F.col(_SOURCE) == k, F.col(_ROW))).over(window) for k in range(len(sources))
    }
    cut = rows.withColumns(histories).where(F.col(_SOURCE) < 0)
    parts = [
        _dense(F.col(f"{_HISTORY}{k}"), F.col(INDEX), steps, len(features)) for k, (_, features) in enumerate(sources)
    ]
    matrix = parts[0]
    for part in parts[1:]:
        matrix = F.zip_with(matrix, part, lambda a, b: F.concat(a, b))
    return cut.select(PATIENT, OBSERVED, matrix.alias(MATRIX))


def given_date_windows(
    periods: DataFrame, spine: DataFrame, features: list[str], unit: str, steps: int
) -> DataFrame:
    """A window for every given ``(patient, observation_date)``.

    The window ends with the period that holds the date; the output keeps the date.
    Patients without records are left out, dates outside the records give NULL windows.
    """
    return merged_windows([(periods, features)], spine, unit, steps)


def merged_windows(sources: list[tuple[DataFrame, list[str]]], spine: DataFrame, unit: str, steps: int) -> DataFrame:
    """Windows of several sources on the same dates, their features side by side.

    ``sources`` are resampled periods of the same unit with their features. Patients without records in some source
    are left out; a step without data in a source has NULLs there.
    """
    points = spine.select(*KEYS).distinct().withColumn(INDEX, period_index(OBSERVED, unit))
    for periods, _ in sources:
        points = points.join(periods.select(PATIENT).distinct(), PATIENT, "left_semi")
    return _swept(sources, [points], steps)


def merged_own_windows(sources: list[tuple[DataFrame, list[str]]], steps: int) -> DataFrame:
    """The same for the period ends of the first source; patients without rows in another one have NULLs there."""
    first = sources[0][0]
    return _swept(sources, [first.select(PATIENT, INDEX, F.col(PERIOD).alias(OBSERVED))], steps)


def to_long(windows: DataFrame, features: list[str], unit: str, steps: int) -> DataFrame:
    """Windows as one row per step: keys, ``step``, ``step_date``, feature columns."""
    others = [c for c in windows.columns if c != MATRIX]
    index = period_index(OBSERVED, unit) - (steps - 1) + F.col(STEP)
    return windows.select(*others, F.posexplode(MATRIX).alias(STEP, _ROW)).select(
        *others,
        STEP,
        index_end(index, unit).alias(STEP_DATE),
        *[F.col(_ROW)[j].alias(f) for j, f in enumerate(features)],
    )


def to_matrix(long: DataFrame, features: list[str]) -> DataFrame:
    """Long windows nested again; a group holds the steps of one sample only."""
    rows = F.sort_array(F.collect_list(F.struct(STEP, F.array(*[F.col(f"`{f}`") for f in features]).alias("r"))))
    return long.groupBy(*KEYS).agg(F.transform(rows, lambda x: x["r"]).alias(MATRIX))


def second_source_windows(
    measurements: DataFrame, spine: DataFrame, features: list[str], time: str, unit: str, steps: int
) -> DataFrame:
    """Windows of another source (raw rows, no time grid) on the dates of a label spine."""
    from onsetframe.operators.records import resample
    from onsetframe.sources.tables import as_time

    patients = spine.select(PATIENT).distinct()
    kept = measurements.select(
        PATIENT, as_time(measurements, time).alias(time), *[F.col(f"`{f}`") for f in features]
    ).join(patients, PATIENT, "left_semi")
    return given_date_windows(resample(kept, features, unit, time), spine, features, unit, steps)
