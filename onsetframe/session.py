"""Session settings the plans rely on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Skewed join sides are split by adaptive execution also where
# the split costs one more exchange, so a hot patient never pins one task. Windows grow
# their input by the number of steps, so small exchanges are merged less eagerly.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor can reach: the cluster's checkpoint directory.

    Where the session names none, as in tests, the given fallback or else a folder in the
    warehouse, which executors share as well.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    return folder or fallback or join_path(spark.conf.get("spark.sql.warehouse.dir"), "_shared")


def checkpointed(df: DataFrame) -> DataFrame:
    """The DataFrame, computed once and kept in the shared folder until it is no longer used.

    Later reads survive lost executors. Spark removes the files with the DataFrame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_path(root: str, *parts: str) -> str:
    """Join path parts for local paths and object-store URLs alike."""
    return "/".join([root.rstrip("/" if root != os.sep else ""), *parts])
