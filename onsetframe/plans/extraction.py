"""Extraction jobs: labelled lab windows and the secondary sources on the label dates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetframe.operators.demographics import demographics_at_dates
from onsetframe.operators.labels import earliest_positive, label_onset_grid, label_onsets, mark_onsets, spine_of
from onsetframe.operators.records import (
    clean_events,
    grid_records,
    long_records,
    pivot_periods,
    resample,
    resample_long,
    select_features,
)
from onsetframe.operators.samples import patient_sides
from onsetframe.operators.windows import own_date_windows, second_source_windows
from onsetframe.plans.config import (
    PERIOD_SETTINGS,
    RECORD_SETTINGS,
    WINDOW_SETTINGS,
    CohortConfig,
    GridCell,
    StagePaths,
)
from onsetframe.schemas import ECG_FEATURES, KEYS, PATIENT
from onsetframe.session import join_path
from onsetframe.sources.stages import StageStore, is_complete
from onsetframe.sources.tables import ClinicalTables

AT_ONCE = 4  # categories of a grid that are written at the same time

ONSET_SETTINGS = ("positive_diagnoses", "gap_days", "prediction_window_days")
# labels also depend on the dates of the category they were made for
LABEL_SETTINGS = (*ONSET_SETTINGS, *PERIOD_SETTINGS)


def digest(**parts) -> str:
    """Key of a stage: a digest of everything that it depends on, in the order given."""
    return hashlib.md5(json.dumps(parts, default=str).encode()).hexdigest()[:16]


def stage(
    spark: SparkSession, path: str | None, key: str, build: Callable[[], DataFrame], overwrite: bool = False
) -> DataFrame:
    """A stage table below ``path``; without a path the plan stays lazy."""
    if path is None:
        return build()
    target = join_path(path, key)
    if overwrite or not is_complete(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def lab_periods(events: DataFrame, ids: list, freq: str, unit: str) -> DataFrame:
    """Events -> time grid -> calendar periods, in one plan.

    The grid stays sparse until the periods are known: an event moves as one value, not as a
    column for every analysis.
    """
    return pivot_periods(resample_long(long_records(clean_events(events, ids), freq), unit), ids, unit)


def labelled_windows(
    events: DataFrame,
    diagnoses: DataFrame,
    admissions: DataFrame,
    config: CohortConfig,
    split: tuple[float | int, int] | None = None,
) -> DataFrame:
    """The main job as one lazy plan: ``(keys, label, matrix)``, and ``split`` if asked for.

    Labels and sides of the split (test size, seed) are decided on the thin period rows, so
    windows are only cut for labelled dates and never joined afterwards.
    """
    ids = config.selected_analyses_ids
    names = [str(i) for i in ids]
    periods = lab_periods(events, ids, config.lab_records_frequency, config.backward_window_time_unit)
    earliest = earliest_positive(diagnoses, admissions, config.positive_diagnoses)
    marked = mark_onsets(periods, earliest, config.gap_days, config.prediction_window_days, time="period_end")
    carry = ["label"]
    if split is not None:
        labelled = marked.where(F.col("label").isNotNull())
        marked = marked.join(patient_sides(labelled, *split), PATIENT, "left")
        carry.append("split")
    return own_date_windows(
        marked, names, config.backward_window_value, carry=carry, shown=F.col("label").isNotNull()
    )


def extract(
    tables: ClinicalTables,
    config: CohortConfig,
    paths: StagePaths | None = None,
    events: DataFrame | None = None,
    overwrite: bool = False,
    label_config: CohortConfig | None = None,
) -> dict[str, DataFrame]:
    """Lab records, windows and labels; stages with a path are written and reused.

    A finished later stage is read without building the earlier ones. ``label_config`` are the
    settings of the category whose dates are labelled (default: ``config``), so categories that
    share labels get the same ones in any order.
    """
    dated = label_config or config
    spark, paths = tables.spark, paths or StagePaths()
    ids = config.selected_analyses_ids
    if ids is None:
        raise ValueError("a labelled extraction needs selected_analyses_ids")
    names = [str(i) for i in ids]
    unit = config.backward_window_time_unit

    def at(path: str | None, settings: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
        return stage(spark, path, config.key(*settings), build, overwrite)

    def selected() -> DataFrame:
        source = tables.analyses() if events is None else events
        return at(paths.filtered_analyses, ("selected_analyses_ids",), lambda: clean_events(source, ids))

    def records() -> DataFrame:
        return at(
            paths.lab_records, RECORD_SETTINGS, lambda: grid_records(selected(), ids, config.lab_records_frequency)
        )

    def filtered() -> DataFrame:
        return at(paths.filtered_lab_records, RECORD_SETTINGS, lambda: select_features(records(), ids))

    def dates() -> DataFrame:
        if dated == config:
            return spine_of(windows)
        source = tables.analyses() if events is None else events
        periods = lab_periods(
            source, dated.selected_analyses_ids, dated.lab_records_frequency, dated.backward_window_time_unit
        )
        return periods.select(PATIENT, F.col("period_end").alias("observation_date"))

    windows = at(
        paths.rolling_lab_records,
        WINDOW_SETTINGS,
        lambda: own_date_windows(resample(filtered(), names, unit), names, config.backward_window_value),
    )
    labels = stage(
        spark,
        paths.labeled_lab_records,
        dated.key(*LABEL_SETTINGS),
        lambda: label_onsets(
            dates(),
            earliest_positive(tables.diagnoses(), tables.admissions(), dated.positive_diagnoses),
            dated.gap_days,
            dated.prediction_window_days,
        ),
        overwrite,
    )
    return {"windows": windows, "labels": labels}


def ecg_for_labels(
    measurements: DataFrame, labels: DataFrame, config: CohortConfig, features: list[str] | None = None
) -> DataFrame:
    """Windows of the ECG measurements on the label dates."""
    return second_source_windows(
        measurements, spine_of(labels), features or ECG_FEATURES, "ecg_time",
        config.backward_window_time_unit, config.backward_window_value,
    )


def demographics_for_labels(patients: DataFrame, labels: DataFrame) -> DataFrame:
    """Age and gender on the label dates."""
    return demographics_at_dates(spine_of(labels), patients)


def extract_grid(
    tables: ClinicalTables, cells: list[GridCell], root: str, label_category: str, overwrite: bool = False
) -> dict[str, DataFrame]:
    """All cells of a grid with every shared stage computed once.

    One scan over the union of the analyses gives the sparse period means of all categories,
    in a folder for each analysis so that a category opens only its files; one pass gives the onset of all
    diseases; one explode gives the labels of all prediction windows; windows are cut once
    per category. Cells of one grid share window, gap and
    frequency. Output: ``windows_<category>``, ``labels``, ``ecg``, ``demographics``.
    """
    if not cells:
        raise ValueError("a grid needs at least one cell")
    store = StageStore(tables.spark, root)
    base = cells[0].config
    shared = ("backward_window_time_unit", "backward_window_value", "gap_days", "lab_records_frequency")
    if any(c.config.key(*shared) != base.key(*shared) for c in cells):
        raise ValueError("the cells of a grid share window, gap and frequency")
    categories = {c.category: c.config.selected_analyses_ids for c in cells}
    diseases = {c.disease: c.config.positive_diagnoses for c in cells}
    horizons = sorted({c.config.prediction_window_days for c in cells})
    union = sorted({i for ids in categories.values() for i in ids})
    whole = CohortConfig(union, [], base.lab_records_frequency, base.backward_window_time_unit,
                         base.backward_window_value, base.gap_days, 0)
    unit, steps = base.backward_window_time_unit, base.backward_window_value
    periods = store.materialize(
        "periods", digest(settings=whole.key(*PERIOD_SETTINGS), tables=tables.identity()),
        lambda: resample_long(
            long_records(clean_events(tables.analyses(), union), base.lab_records_frequency), unit
        ),
        overwrite, folders="analysis_id",
    )
    identity = tables.identity()

    def category_windows(category: str) -> DataFrame:
        ids = categories[category]
        settings = CohortConfig(ids, [], base.lab_records_frequency, unit, steps).key(*WINDOW_SETTINGS)
        return store.materialize(
            f"windows_{category}", digest(settings=settings, tables=identity),
            lambda: own_date_windows(pivot_periods(periods, ids, unit), [str(i) for i in ids], steps), overwrite,
        )

    # categories do not depend on each other: a few at a time keep the cluster busy while others end
    with ThreadPool(min(AT_ONCE, len(categories))) as pool:
        windows = pool.map(category_windows, categories)
    out = {f"windows_{category}": made for category, made in zip(categories, windows)}
    label_key = digest(
        diseases=list(diseases.items()), horizons=horizons, category=label_category,
        ids=categories[label_category], base=base.key(*shared), tables=tables.identity(),
    )
    out["labels"] = store.materialize(
        "labels", label_key,
        lambda: label_onset_grid(
            spine_of(out[f"windows_{label_category}"]),
            earliest_positive(tables.diagnoses(), tables.admissions(), diseases),
            list(diseases), horizons, base.gap_days,
        ), overwrite,
    )
    dates = out["labels"].select(*KEYS).distinct()
    out["ecg"] = store.materialize(
        "ecg", label_key, lambda: ecg_for_labels(tables.ecg_machine_measurements(), dates, base), overwrite
    )
    out["demographics"] = store.materialize(
        "demographics", label_key, lambda: demographics_for_labels(tables.patients(), dates), overwrite
    )
    return out
