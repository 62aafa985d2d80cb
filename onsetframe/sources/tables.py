"""Delimited and Parquet scans of the named clinical tables."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onsetframe.schemas import COLUMN_ALIASES, TABLE_FILES, schema_for
from onsetframe.session import join_path
from onsetframe.sources.manifest import exists, fingerprint


def rename_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Normalised column names; columns without alias pass through."""
    return df.withColumnsRenamed(COLUMN_ALIASES if aliases is None else aliases)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value inside the engine."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in floats})


def as_time(df: DataFrame, column: str) -> Column:
    """A time column as ``timestamp_ntz``; text that is no time becomes NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.expr(f"try_cast(`{column}` AS timestamp_ntz)")
    return F.col(column).cast("timestamp_ntz")


MALFORMED = "_malformed_line"


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", keep_malformed: bool = False
) -> DataFrame:
    """Delimited file with a header, plain or gz, under fixed types (no inference pass).

    A line with another number of fields, or with text where a number or time belongs, has NULL in the fields that can't be read;
    with ``keep_malformed`` such a line is also kept whole in a column of its own, see :func:`quarantined`.
    """
    header = spark.read.option("encoding", encoding).text(path).head()
    names = next(csv.reader(io.StringIO(header[0].lstrip("﻿")), delimiter=delimiter)) if header else []
    schema = schema_for(names)
    if keep_malformed:
        schema = schema.add(MALFORMED, T.StringType())
    return (
        spark.read.schema(schema)
        .option("enforceSchema", "true")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path, header=True, sep=delimiter, encoding=encoding, quote='"', escape='"')
    )


def quarantined(lines: DataFrame, path: str) -> DataFrame:
    """The well-formed rows of a scan that kept malformed lines; those lines go to a table at ``path``.

    Whether a line is malformed shows only when all its fields are read, so the scan is written once, split by the
    outcome, and each side reads its own files. The quarantine table has the lines as they are in the file.
    """
    marked = lines.withColumn("malformed", F.col(MALFORMED).isNotNull())
    marked.write.mode("overwrite").partitionBy("malformed").parquet(path)
    stored = lines.sparkSession.read.schema(marked.schema).parquet(path)
    return stored.where(~F.col("malformed")).drop("malformed", MALFORMED)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines that :func:`quarantined` put aside, as ``line``."""
    stored = spark.read.schema(f"{MALFORMED} string, malformed boolean").parquet(path)
    return stored.where("malformed").select(F.col(MALFORMED).alias("line"))


class ClinicalTables:
    """Named access to the seven tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, delimiter: str = ",", encoding: str = "utf-8"):
        self.spark = spark
        self.root = root
        self.delimiter = delimiter
        self.encoding = encoding
        self._replaced: dict[str, DataFrame] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> ClinicalTables:
        return cls(spark, json.loads(Path(path).read_text())["database_root"])

    @staticmethod
    def write_config(path: str, root: str = "") -> None:
        Path(path).write_text(json.dumps({"database_root": root}, indent=4, sort_keys=True))

    def identity(self) -> dict:
        """What the tables are read from, for the keys of written stages: the files with their size and time."""
        replaced = {}
        for name, df in self._replaced.items():
            files = df.inputFiles()
            replaced[name] = fingerprint(self.spark, files) if files else df.schema.simpleString()
        files = [join_path(self.root, *TABLE_FILES[name]) for name in TABLE_FILES if name not in self._replaced]
        there = [f for f in files if exists(self.spark, f)]
        return {
            "root": self.root, "replaced": sorted(replaced.items()), "files": fingerprint(self.spark, there) if there else None,
        }

    def replace(self, name: str, df: DataFrame) -> ClinicalTables:
        """Serve ``name`` from a DataFrame, e.g. a Parquet sample or converted table."""
        self._replaced[name] = df
        return self

    def table(self, name: str) -> DataFrame:
        if name in self._replaced:
            return self._replaced[name]
        return nan_to_null(rename_columns(self._scan(name)))

    def _scan(self, name: str, keep_malformed: bool = False) -> DataFrame:
        module, file = TABLE_FILES[name]
        return read_delimited(self.spark, join_path(self.root, module, file), self.delimiter, self.encoding, keep_malformed)

    def set_aside(self, name: str, path: str) -> DataFrame:
        """Serve ``name`` without its malformed lines, which go to a quarantine table at ``path``."""
        good = quarantined(self._scan(name, keep_malformed=True), path)
        return self.replace(name, nan_to_null(rename_columns(good))).table(name)

    def analyses(self) -> DataFrame:
        return self.table("analyses")

    def patients(self) -> DataFrame:
        return self.table("patients")

    def admissions(self) -> DataFrame:
        return self.table("admissions")

    def diagnoses(self) -> DataFrame:
        return self.table("diagnoses")

    def diagnoses_lookup(self) -> DataFrame:
        return self.table("diagnoses_lookup")

    def analyses_lookup(self) -> DataFrame:
        return self.table("analyses_lookup")

    def ecg_machine_measurements(self) -> DataFrame:
        return self.table("ecg_machine_measurements")

    def register_views(self) -> None:
        """Temp views of all tables, for SQL."""
        for name in TABLE_FILES:
            self.table(name).createOrReplaceTempView(name)

    def to_parquet(self, name: str, path: str, partitions: int | None = None) -> DataFrame:
        """Convert a table to Parquet once: a gz file is read by one task, Parquet by many."""
        df = self.table(name)
        df = df.repartition(partitions) if partitions else df.repartition()
        df.write.mode("overwrite").parquet(path)
        self.replace(name, self.spark.read.parquet(path))
        return self._replaced[name]


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """Parquet sample of a table, with normalised names."""
    return nan_to_null(rename_columns(spark.read.parquet(path)))


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of records ``(icd_code, occurrence_count, long_title)``; counts come as text."""
    schema = "icd_code STRING, occurrence_count STRING, long_title STRING"
    return rename_columns(
        spark.read.schema(schema)
        .json(path, multiLine=True)
        .withColumn("occurrence_count", F.col("occurrence_count").cast("long"))
    )
