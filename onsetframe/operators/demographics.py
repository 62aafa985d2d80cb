"""Age and gender at an observation date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetframe.schemas import KEYS, OBSERVED, PATIENT


def age_at(date: Column, age: Column, anchor_year: Column) -> Column:
    """Age at a date from the age in an anchor year; the day of birth is unknown."""
    return (F.year(date) - (anchor_year - age)).cast("int")


def gender_code(gender: Column) -> Column:
    """F -> 0, M -> 1, anything else NULL."""
    return F.when(gender == "F", 0).when(gender == "M", 1)


def demographics_at_dates(spine: DataFrame, patients: DataFrame) -> DataFrame:
    """``(keys, age, gender)`` per observation date; NULL for an unknown patient."""
    known = patients.select(PATIENT, F.col("age").alias("_age"), "gender", "anchor_year")
    age = age_at(F.col(OBSERVED), F.col("_age"), F.col("anchor_year"))
    return spine.select(*KEYS).join(known, PATIENT, "left").select(*KEYS, age.alias("age"), "gender")


def demographics_matrix(demographics: DataFrame) -> DataFrame:
    """Single-step matrix ``[[age, gender code]]`` per sample."""
    row = F.array(F.col("age").cast("double"), gender_code(F.col("gender")).cast("double"))
    return demographics.select(*KEYS, F.array(row).alias("matrix"))


def gender_onehot(demographics: DataFrame, levels: list[str]) -> DataFrame:
    """One 0/1 column per level, the first level dropped if there are two; age stays."""
    kept = sorted(levels)[1:] if len(levels) == 2 else sorted(levels)
    flags = [F.coalesce((F.col("gender") == v).cast("int"), F.lit(0)).alias(f"gender_{v}") for v in kept]
    return demographics.select(*KEYS, *flags, "age")
