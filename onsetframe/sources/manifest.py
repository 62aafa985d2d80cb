"""Fingerprints of input files, and manifests of what a stage was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, length, modificationTime`` of the files below some paths; no content is read."""
    paths = [paths] if isinstance(paths, str) else paths
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    )


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def path_part(name: str) -> Column:
    """The number in a folder name ``name=number`` of ``path``."""
    return F.regexp_extract("path", f"/{name}=(\\d+)/", 1).try_cast("int").alias(name)


def _mark() -> Column:
    """One number of a set of files, whatever their order."""
    file = F.xxhash64("path", "length", "modificationTime")
    parts = [F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(file), F.lit(0))]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])).alias("fingerprint")


def fingerprint(spark: SparkSession, paths: str | list[str]) -> str:
    """Digest of path, size and time of all files below the paths."""
    return listed(spark, paths).agg(_mark()).first()[0][:16]


def fingerprints(files: DataFrame, part: str) -> DataFrame:
    """The fingerprint of the files of every folder ``part=number``."""
    numbered = files.withColumn(part, path_part(part))
    return numbered.where(F.col(part).isNotNull()).groupBy(part).agg(_mark())


class Manifest:
    """Numbered entries with the fingerprint they were made from.

    Each state is one small file, so it is there as a whole or not at all; the highest version counts. A writer
    has the stage to itself.
    """

    SCHEMA = "version long, entry int, fingerprint string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _states(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.path)
        except Exception as error:  # nothing was published yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def version(self) -> int:
        return self._states().agg(F.max("version")).first()[0] or 0

    def entries(self) -> dict[int, str]:
        """The entries of the last state; one row per bucket of the stage."""
        states = self._states()
        last = states.agg(F.max("version")).scalar()
        return {r.entry: r.fingerprint for r in states.where((F.col("version") == last) & F.col("entry").isNotNull()).collect()}

    def publish(self, entries: dict[int, str]) -> None:
        version = self.version() + 1
        rows = [(version, None, None), *[(version, e, mark) for e, mark in sorted(entries.items())]]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)
