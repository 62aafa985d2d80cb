"""Column names, aliases and schemas of the clinical tables."""

from __future__ import annotations

from pyspark.sql import types as T

PATIENT = "patient_id"
OBSERVED = "observation_date"
KEYS = [PATIENT, OBSERVED]

# Raw column name -> normalised column name.
COLUMN_ALIASES = {
    "icd_code": "diagnosis_code",
    "hadm_id": "admission_id",
    "subject_id": "patient_id",
    "itemid": "analysis_id",
    "admittime": "admission_time",
    "dischtime": "discharge_time",
    "anchor_age": "age",
    "storetime": "analysis_time",
    "label": "analysis_name",
    "valuenum": "analysis_value",
    "ecg_time": "ecg_time",
}

# Logical table -> (module folder, file).
TABLE_FILES = {
    "analyses": ("hosp", "labevents.csv.gz"),
    "patients": ("hosp", "patients.csv.gz"),
    "admissions": ("hosp", "admissions.csv.gz"),
    "diagnoses": ("hosp", "diagnoses_icd.csv.gz"),
    "diagnoses_lookup": ("hosp", "d_icd_diagnoses.csv.gz"),
    "analyses_lookup": ("hosp", "d_labitems.csv.gz"),
    "ecg_machine_measurements": ("ecg", "machine_measurements.csv"),
}

# Numeric ECG features kept for the second source.
ECG_FEATURES = [
    "rr_interval", "p_onset", "p_end", "qrs_onset", "qrs_end", "t_end", "p_axis", "qrs_axis", "t_axis",
]

# Types by raw column name. Columns not listed are read as text, so a code made
# of digits never turns into a number.
_LONG = ("subject_id", "hadm_id", "labevent_id", "specimen_id", "study_id", "cart_id")
_INT = ("itemid", "anchor_age", "anchor_year", "seq_num", "icd_version", "hospital_expire_flag")
_DOUBLE = ("valuenum", "ref_range_lower", "ref_range_upper", *ECG_FEATURES)
_TIME = ("charttime", "storetime", "ecg_time", "admittime")


def column_type(raw_name: str) -> T.DataType:
    """Type of a raw column; ``dischtime`` stays text, bad values are coerced later."""
    if raw_name in _LONG:
        return T.LongType()
    if raw_name in _INT:
        return T.IntegerType()
    if raw_name in _DOUBLE:
        return T.DoubleType()
    if raw_name in _TIME:
        return T.TimestampNTZType()
    return T.StringType()


def schema_for(raw_names: list[str]) -> T.StructType:
    """Schema of a delimited file from its header."""
    return T.StructType([T.StructField(name, column_type(name)) for name in raw_names])
