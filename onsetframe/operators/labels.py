"""Onset labels of observation dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetframe.functions.periods import days
from onsetframe.schemas import KEYS, OBSERVED, PATIENT
from onsetframe.sources.tables import as_time

LABEL, EARLIEST, ADMISSION, DISCHARGED, CODE = (
    "label", "earliest", "admission_id", "discharge_time", "diagnosis_code",
)


def discharges(admissions: DataFrame) -> DataFrame:
    """Admissions with a valid discharge time."""
    return admissions.select(
        PATIENT, ADMISSION, as_time(admissions, DISCHARGED).alias(DISCHARGED)
    ).where(F.col(DISCHARGED).isNotNull())


def timed_diagnoses(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Diagnoses with the discharge time of their admission."""
    return diagnoses.join(discharges(admissions), [PATIENT, ADMISSION])


def _earliest_column(disease: str) -> str:
    return EARLIEST if not disease else f"{EARLIEST}_{disease}"


def earliest_positive(
    diagnoses: DataFrame, admissions: DataFrame, positive: list[str] | dict[str, list[str]]
) -> DataFrame:
    """Earliest positive diagnosis of every patient that has any diagnosis, NULL if none.

    With a dict of code lists one column ``earliest_<name>`` per list is made in the same
    pass. Diagnoses are reduced to one row per admission before they meet the admissions.
    """
    lists = positive if isinstance(positive, dict) else {"": positive}
    flags = {f"_positive_{n}": F.max(F.col(CODE).isin(list(codes))) for n, codes in lists.items()}
    per_admission = (
        diagnoses.where(F.col(PATIENT).isNotNull())
        .groupBy(PATIENT, ADMISSION)
        .agg(*[flag.alias(name) for name, flag in flags.items()])
    )
    timed = per_admission.join(discharges(admissions), [PATIENT, ADMISSION], "left")
    return timed.groupBy(PATIENT).agg(
        *[F.min(F.when(F.col(f"_positive_{n}"), F.col(DISCHARGED))).alias(_earliest_column(n)) for n in lists]
    )


def _moment(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def _onset(earliest: Column, gap: Column, window: Column, time: str = OBSERVED) -> tuple[Column, Column]:
    """(keep condition, label) of an observation date."""
    start = _moment(time) + gap
    keep = earliest.isNull() | (start <= earliest)
    label = F.when(earliest.isNotNull() & (earliest <= start + window), 1).otherwise(0)
    return keep, label


def mark_onsets(
    spine: DataFrame, earliest: DataFrame, gap_days: int, window_days: int, time: str = OBSERVED
) -> DataFrame:
    """All rows of the spine with their label, NULL where a date gets none.

    A date gets no label if its gap ends after the onset or its patient has no diagnosis row.
    """
    joined = spine.join(earliest.withColumn("_known", F.lit(True)), PATIENT, "left")
    keep, label = _onset(F.col(EARLIEST), days(gap_days), days(window_days), time)
    return joined.withColumn(LABEL, F.when(F.col("_known") & keep, label)).drop(EARLIEST, "_known")


def label_onsets(spine: DataFrame, earliest: DataFrame, gap_days: int, window_days: int) -> DataFrame:
    """Label of every observation date; dates whose gap ends after the onset are left out.

    ``spine`` is any DataFrame with the two key columns; its other columns are kept.
    Patients without any diagnosis row are left out.
    """
    joined = spine.join(earliest, PATIENT)
    keep, label = _onset(F.col(EARLIEST), days(gap_days), days(window_days))
    return joined.where(keep).withColumn(LABEL, label).drop(EARLIEST)


def label_onset_grid(
    spine: DataFrame, earliest: DataFrame, diseases: list[str], windows_days: list[int], gap_days: int
) -> DataFrame:
    """Labels for every disease and prediction window in one pass over the spine.

    The few settings are a literal array in the plan, there is no join with them.
    """
    settings = F.array(
        *[
            F.struct(
                F.lit(d).alias("disease"),
                F.lit(w).alias("prediction_window_days"),
                F.col(_earliest_column(d)).alias(EARLIEST),
            )
            for d in diseases
            for w in windows_days
        ]
    )
    expanded = spine.join(earliest, PATIENT).select(*spine.columns, F.explode(settings).alias("_s"))
    keep, label = _onset(F.col("_s")[EARLIEST], days(gap_days), days(F.col("_s")["prediction_window_days"]))
    return expanded.where(keep).select(
        *spine.columns, F.col("_s")["disease"].alias("disease"),
        F.col("_s")["prediction_window_days"].alias("prediction_window_days"), label.alias(LABEL),
    )


def label_coverage(spine: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """One row: patients of the spine found in the diagnoses table, and not found."""
    found = diagnoses.select(PATIENT).distinct().withColumn("_found", F.lit(1))
    patients = spine.select(PATIENT).distinct().join(found, PATIENT, "left")
    return patients.agg(
        F.count("_found").alias("patients_found"),
        F.count(F.when(F.col("_found").isNull(), 1)).alias("patients_not_found"),
    )


def spine_of(df: DataFrame) -> DataFrame:
    """The key columns of labels or windows."""
    return df.select(*KEYS)
