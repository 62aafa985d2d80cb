import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onsetframe.operators.records import (
    clean_events,
    grid_records,
    long_records,
    resample,
    select_features,
)

SCHEMA = "patient_id long, analysis_time timestamp_ntz, analysis_id string, analysis_value double"


@pytest.fixture
def events(spark, t):
    raw = [
        (1, "2022-01-01 10:00", "A", 10.0), (1, "2022-01-01 11:00", "B", 15.0), (2, "2022-01-02 10:00", "A", 20.0),
        (2, None, "B", 25.0), (3, "2022-01-03 10:00", "A", 30.0), (3, "2022-01-03 11:00", "B", 35.0),
        (None, "2022-01-04 10:00", "A", 40.0),
    ]
    return spark.createDataFrame([(p, t(x) if x else None, a, v) for p, x, a, v in raw], SCHEMA)


def test_grid_of_example(events, t, rows):
    grid = grid_records(clean_events(events), ["A", "B"])
    assert rows(grid) == sorted([
        (1, t("2022-01-01 10:00"), 10.0, None), (1, t("2022-01-01 11:00"), None, 15.0),
        (2, t("2022-01-02 10:00"), 20.0, None), (3, t("2022-01-03 10:00"), 30.0, None),
        (3, t("2022-01-03 11:00"), None, 35.0),
    ], key=str)


def test_grid_finds_ids_and_text_times(spark, rows):
    raw = [(1, "2022-01-01 10:20:00", "B", 1.0), (1, "no time", "A", 2.0), (1, "2022-01-01 10:40:00", "A", float("nan"))]
    df = spark.createDataFrame(raw, SCHEMA.replace("timestamp_ntz", "string"))
    grid = grid_records(clean_events(df))
    assert grid.columns == ["patient_id", "time_bin", "A", "B"]
    assert [(r.A, r.B) for r in grid.collect()] == [(None, 1.0)]


def test_empty_rows_vanish(spark, t):
    df = spark.createDataFrame([(1, t("2022-01-01 10:00"), "A", None)], SCHEMA)
    assert grid_records(clean_events(df), ["A"]).count() == 0


@pytest.mark.parametrize(
    "agg", ["mean", "min", "max", "sum", "count", "median", "std", "var", "sem", "prod", "nunique", "first", "last", "size"]
)
def test_aggregates_like_pandas(spark, t, agg):
    rng = np.random.default_rng(3)
    times = pd.date_range("2022-01-01", periods=60, freq="17min")
    pdf = pd.DataFrame({
        "patient_id": rng.integers(1, 3, 60), "analysis_time": times, "analysis_id": rng.choice(["A", "B"], 60),
        "analysis_value": np.where(rng.random(60) < 0.25, np.nan, rng.integers(0, 9, 60).astype(float)),
    })
    df = spark.createDataFrame(
        [(int(p), x.to_pydatetime(), a, None if np.isnan(v) else float(v)) for p, x, a, v in pdf.itertuples(index=False)],
        SCHEMA,
    )
    got = grid_records(clean_events(df), ["A", "B"], "2h", agg).toPandas().set_index(["patient_id", "time_bin"])
    want = {}
    for patient, group in pdf.groupby("patient_id"):
        table = group.pivot_table(index=pd.Grouper(key="analysis_time", freq="2h"), columns="analysis_id",
                                  values="analysis_value", aggfunc=agg)
        for when, row in table.iterrows():
            if row.notna().any():
                want[(patient, when)] = [row.get("A", np.nan), row.get("B", np.nan)]
    assert set(got.index) == set(want)
    for key, values in want.items():
        np.testing.assert_allclose(got.loc[key, ["A", "B"]].astype(float).to_numpy(), np.array(values, float))


def test_custom_aggregate(events):
    grid = grid_records(clean_events(events), ["A"], "D", lambda c: F.max(c) * 2)
    assert {r.A for r in grid.collect()} == {20.0, 40.0, 60.0}


def test_select_features(spark, t):
    df = spark.createDataFrame([(1, t("2022-01-01"), 1.0, 3.0)], "patient_id long, time_bin timestamp_ntz, B double, A double")
    out = select_features(df, ["A", "X", "B"])
    assert out.columns == ["patient_id", "time_bin", "A", "X", "B"]
    assert tuple(out.first())[2:] == (3.0, None, 1.0)
    assert select_features(df.where("false"), ["A"]).count() == 0


def test_resample_is_mean_of_hourly_means(spark, t):
    raw = [(1, "2022-01-01 10:00", "A", 1.0), (1, "2022-01-01 10:30", "A", 3.0), (1, "2022-01-05 10:00", "A", 8.0)]
    df = spark.createDataFrame([(p, t(x), a, v) for p, x, a, v in raw], SCHEMA)
    out = resample(grid_records(clean_events(df), ["A"]), ["A"], "month").collect()
    assert [(str(r.period_end), r.A) for r in out] == [("2022-01-31", 5.0)]


def test_long_records_match_grid(events, rows):
    long = long_records(clean_events(events))
    assert {(r.patient_id, r.analysis_id, r.analysis_value) for r in long.collect()} == {
        (1, "A", 10.0), (1, "B", 15.0), (2, "A", 20.0), (3, "A", 30.0), (3, "B", 35.0)
    }


def test_hot_patient_keeps_all_rows(spark):
    """One patient with most rows in one cell: exact median and mean."""
    hot = spark.range(20000).select(
        F.lit(1).cast("long").alias("patient_id"), F.expr("timestamp_ntz'2022-01-01 10:00:00'").alias("analysis_time"),
        F.lit("A").alias("analysis_id"), (F.col("id") * 37 % 20011).cast("double").alias("analysis_value"),
    )
    values = np.array([i * 37 % 20011 for i in range(20000)], float)
    assert grid_records(hot, ["A"], "h", "median").first().A == np.median(values)
    assert grid_records(hot, ["A"]).first().A == pytest.approx(values.mean())


NAMES = ["mean", "min", "max", "sum", "count", "median", "std", "var", "sem", "prod", "nunique", "first", "last", "size"]


@pytest.mark.parametrize("base", [0.0, 1e7])
def test_all_statistics_of_a_cell_at_once(spark, monkeypatch, base):
    from onsetframe.functions import ranking
    from onsetframe.operators.records import cell_statistics

    monkeypatch.setattr(ranking, "LEAF_ROWS", 2)
    rng = np.random.default_rng(8)
    times = pd.date_range("2022-01-01", periods=200, freq="37min")
    pdf = pd.DataFrame({
        "patient_id": rng.integers(1, 3, 200), "analysis_time": times, "analysis_id": rng.choice(["A", "B"], 200, p=[0.9, 0.1]),
        "analysis_value": np.where(rng.random(200) < 0.25, np.nan, base + rng.integers(0, 6, 200) / 4),
    })
    df = spark.createDataFrame(
        [(int(p), x.to_pydatetime(), a, None if np.isnan(v) else float(v)) for p, x, a, v in pdf.itertuples(index=False)], SCHEMA
    )
    out = cell_statistics(df, "D", [*NAMES, "mode"], {"q10": 0.1, "q90": 0.9}).toPandas()
    got = out.set_index(["patient_id", "time_bin", "analysis_id"])
    groups = dict(list(pdf.groupby(["patient_id", pdf.analysis_time.dt.floor("D"), "analysis_id"]).analysis_value))
    assert set(got.index) == set(groups)
    for key, values in groups.items():
        row, present = got.loc[key], values.dropna()
        for name in NAMES:
            if name == "prod" and base:
                continue
            want = values.size if name == "size" else values.agg(name) if name not in ("first", "last") else (present.iloc[[0, -1][name == "last"]] if len(present) else np.nan)
            np.testing.assert_allclose(float(row[name]), want, rtol=1e-9, atol=1e-7, err_msg=f"{key} {name}")
        if len(present):
            assert row["mode"] == present.mode().iloc[0]
            np.testing.assert_allclose([row.q10, row.q90], np.quantile(present, [0.1, 0.9]))


def test_plain_function_as_aggregate(events, rows):
    from onsetframe.operators.records import plain_aggregate

    spread = plain_aggregate(lambda values: values.max() - values.min() + len(values))
    long = long_records(clean_events(events), "D", spread)
    assert {(r.patient_id, r.analysis_id, r.analysis_value) for r in long.collect()} == {(1, "A", 1.0), (1, "B", 1.0), (2, "A", 1.0), (3, "A", 1.0), (3, "B", 1.0)}
    assert {r.A for r in grid_records(clean_events(events), ["A"], "D", spread).collect()} == {1.0}
