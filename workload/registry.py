"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from onsetframe.session import tune
from workload.adapters import Star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(star) -> DataFrame`` under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Star(tune(spark), folder))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register
