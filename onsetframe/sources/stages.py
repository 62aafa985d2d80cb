"""Written stages: record sets, reusable intermediate tables, metric files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetframe.schemas import PATIENT
from onsetframe.session import join_path
from onsetframe.sources.manifest import Manifest, exists, fingerprint, fingerprints, listed, path_part

BUCKET = "patient_bucket"
BUCKETS = "patient_buckets"  # their number, a folder level above the buckets


def patient_bucket(patient: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(patient.cast("string")), F.lit(buckets)).cast("int")


def write_records(df: DataFrame, path: str, buckets: int = 64, overwrite: bool = False) -> None:
    """Write a record set, partitioned by a bucket of the patient; the set keeps their number.

    The rebalance hint lets adaptive execution split a bucket that holds a hot
    patient over several writers, and merge small ones.
    """
    keyed = df.withColumns({BUCKETS: F.lit(buckets), BUCKET: patient_bucket(F.col(PATIENT), buckets)})
    spread = keyed.hint("rebalance", F.col(BUCKET))
    spread.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(BUCKETS, BUCKET).parquet(path)


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """The number of buckets a record set was written with, from its folder names; None if it holds no file."""
    found = [r[0] for r in listed(spark, path).select(path_part(BUCKETS)).distinct().where(f"{BUCKETS} IS NOT NULL").limit(9).collect()]
    if len(found) > 1:
        raise ValueError(f"the record set mixes bucket counts {sorted(found)}")
    return found[0] if found else None


def read_records(spark: SparkSession, path: str, patients: list | None = None) -> DataFrame:
    """Read a record set; a short patient list prunes to the buckets that hold them."""
    df = spark.read.parquet(path)
    buckets = bucket_count(spark, path) if patients is not None else None
    if buckets is not None:
        wanted = F.array(*[patient_bucket(F.lit(str(p)), buckets) for p in patients])
        df = df.where(F.array_contains(wanted, F.col(BUCKET)) & F.col(PATIENT).isin(list(patients)))
    return df.drop(BUCKET, BUCKETS)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a write to ``path`` was committed."""
    return exists(spark, join_path(path, "_SUCCESS"))


class StageStore:
    """Stage tables below one shared folder, one folder per stage and config key.

    The key is a digest of the settings a stage depends on, so a stage written under
    other settings is never taken for this one. With ``inputs``, paths of files that a stage is made from,
    the folder also names their fingerprint: other data is never taken for the old.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, stage: str, key: str) -> str:
        return join_path(self.root, stage, key)

    def has(self, stage: str, key: str) -> bool:
        return is_complete(self.spark, self.path(stage, key))

    def materialize(
        self,
        stage: str,
        key: str,
        build: Callable[[], DataFrame],
        overwrite: bool = False,
        inputs: list[str] | None = None,
        folders: str | None = None,
    ) -> DataFrame:
        """The written stage; built and written first if it is absent.

        ``build`` is called only when needed: a finished later stage skips the earlier ones. With ``folders`` the rows of each
        value of that column have files of their own, and a filter on it opens only these.
        """
        path = self.path(stage, key if inputs is None else f"{key}-{fingerprint(self.spark, inputs)}")
        if overwrite or not is_complete(self.spark, path):
            rows = build()
            writer = rows.hint("rebalance", F.col(folders)).write.partitionBy(folders) if folders else rows.write
            writer.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


class BucketStage:
    """A stage made from a record set, bucket by bucket, that follows its input.

    The manifest holds the fingerprint of the files each bucket was made from. A refresh builds only the buckets whose
    files changed and rewrites only their folders. The changed buckets are taken out of the manifest before they are
    rewritten and entered again afterwards, each time by one published file: after a crash they are simply built again, and
    a reader never takes a half-written bucket for a finished one.
    """

    def __init__(self, spark: SparkSession, root: str, stage: str, key: str):
        self.spark = spark
        self.path = join_path(root, stage, key)
        self.manifest = Manifest(spark, join_path(root, stage, f"{key}.manifest"))

    def changed(self, records: str) -> tuple[dict[int, str], set[int]]:
        """Fingerprint of every bucket of the record set, and the buckets that the stage lacks or has from other files."""
        now = {r[BUCKET]: r["fingerprint"] for r in fingerprints(listed(self.spark, records), BUCKET).collect()}
        known = self.manifest.entries()
        return now, {b for b, mark in now.items() if known.get(b) != mark}

    def refresh(self, records: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage for the record set as it is now.

        ``build`` maps records to rows of the same patients; it gets the records of the changed buckets alone.
        """
        now, stale = self.changed(records)
        gone = set(self.manifest.entries()) - set(now)
        if stale or gone:
            finished = {b: mark for b, mark in now.items() if b not in stale}
            self.manifest.publish(finished)
            if stale:
                count = bucket_count(self.spark, records)
                read = self.spark.read.parquet(records).where(F.col(BUCKET).isin(sorted(stale))).drop(BUCKET, BUCKETS)
                made = build(read).withColumn(BUCKET, patient_bucket(F.col(PATIENT), count))
                made.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                    BUCKET
                ).parquet(self.path)
                self.manifest.publish(now)
        return self.read()

    def read(self) -> DataFrame:
        """The rows of the finished buckets."""
        entries = self.manifest.entries()
        rows = self.spark.read.parquet(self.path)
        return rows.where(F.col(BUCKET).isin(sorted(entries)) if entries else F.lit(False)).drop(BUCKET)


def write_output(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write an output table; an existing one is kept unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_metrics(metrics: DataFrame, path: str, overwrite: bool = True) -> None:
    """Metric table (a few rows) as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)
