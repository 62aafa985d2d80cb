"""Compare every query with its SQL: ``python -m workload.check <folder> [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.queries import ORACLES, QUERIES


def normalised(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return None
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    rows = [tuple(plain(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark: SparkSession, con, folder: str, name: str) -> str:
    start = time.time()
    got = QUERIES[name](spark, folder).toPandas()
    spent = time.time() - start
    if name not in ORACLES:
        return f"rows {len(got):>8} {spent:6.1f}s"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normalised(got), normalised(want)
    if a == b:
        kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns
                 if str(got[c].dtype) != str(want[c].dtype)}
        return f"ok   {len(got):>8} {spent:6.1f}s {kinds or ''}"
    differ = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"DIFFERENT {len(a)} {len(b)} {differ}"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), database(folder)
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {str(error)[:700]}"
        bad += result.split()[0] not in ("ok", "rows")
        print(f"{name:26s} {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
