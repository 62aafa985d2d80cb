import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onsetframe.operators import windows as w
from onsetframe.operators.records import resample

N = None
OWN = [
    ("day", 3, ["2023-01-01", "2023-01-02", "2023-01-03", "2023-01-04"],
     {"2023-01-01": [N, N, 1], "2023-01-02": [N, 1, 2], "2023-01-03": [1, 2, 3], "2023-01-04": [2, 3, 4]}),
    ("week", 2, ["2023-01-08", "2023-01-15"], {"2023-01-08": [N, 1], "2023-01-15": [1, 2]}),
    ("month", 2, ["2023-01-08", "2023-02-14", "2023-04-24", "2023-08-12"],
     {"2023-01-31": [N, 1], "2023-02-28": [1, 2], "2023-04-30": [N, 3], "2023-08-31": [N, 4]}),
    ("year", 2, ["2023-01-08", "2024-02-14", "2027-04-24", "2029-08-12"],
     {"2023-12-31": [N, 1], "2024-12-31": [1, 2], "2027-12-31": [N, 3], "2029-12-31": [N, 4]}),
]
GIVEN = [
    ("day", 3, 0, ["2023-01-04", "2023-01-06"],
     {"2023-01-04": [("2023-01-02", 2), ("2023-01-03", 3), ("2023-01-04", 4)],
      "2023-01-06": [("2023-01-04", 4), ("2023-01-05", N), ("2023-01-06", N)]}),
    ("week", 2, 1, ["2023-01-05", "2024-05-28"],
     {"2023-01-05": [("2023-01-01", N), ("2023-01-08", 1)], "2024-05-28": [("2024-05-26", N), ("2024-06-02", N)]}),
    ("month", 2, 2, ["2023-01-31", "2023-05-28"],
     {"2023-01-31": [("2022-12-31", N), ("2023-01-31", 1)], "2023-05-28": [("2023-04-30", 3), ("2023-05-31", N)]}),
    ("year", 2, 3, ["2023-06-06", "2024-04-24"],
     {"2023-06-06": [("2022-12-31", N), ("2023-12-31", 1)], "2024-04-24": [("2023-12-31", 1), ("2024-12-31", 2)]}),
]


def records(spark, t, times, patients=("patient_1", "patient_2")):
    raw = [(p, t(x), float(i + 1)) for p in patients for i, x in enumerate(times)]
    return spark.createDataFrame(raw, "patient_id string, time_bin timestamp_ntz, v double")


@pytest.mark.parametrize("unit,steps,times,want", OWN)
def test_own_dates(spark, t, unit, steps, times, want):
    out = w.own_date_windows(resample(records(spark, t, times), ["v"], unit), ["v"], steps).collect()
    for patient in ("patient_1", "patient_2"):
        got = {str(r.observation_date): [x[0] for x in r.matrix] for r in out if r.patient_id == patient}
        assert got == want


@pytest.mark.parametrize("unit,steps,case,dates,want", GIVEN)
def test_given_dates(spark, t, unit, steps, case, dates, want):
    periods = resample(records(spark, t, OWN[case][2]), ["v"], unit)
    spine = spark.createDataFrame(
        [("patient_1", t(d)) for d in dates] + [("stranger", t(dates[0]))],
        "patient_id string, observation_date timestamp_ntz",
    )
    cut = w.given_date_windows(periods, spine, ["v"], unit, steps)
    long = w.to_long(cut, ["v"], unit, steps).orderBy("observation_date", "step").collect()
    assert {r.patient_id for r in long} == {"patient_1"}
    got = {}
    for r in long:
        got.setdefault(str(r.observation_date.date()), []).append((str(r.step_date), r.v))
    assert got == want


def test_time_of_day_is_kept_in_the_key_only(spark, t):
    periods = resample(records(spark, t, ["2023-01-04"]), ["v"], "day")
    spine = spark.createDataFrame(
        [("patient_1", t("2023-01-04 13:00")), ("patient_1", t("2023-01-04 15:00"))],
        "patient_id string, observation_date timestamp_ntz",
    )
    out = w.given_date_windows(periods, spine, ["v"], "day", 2).orderBy("observation_date").collect()
    assert [r.matrix for r in out] == [[[None], [1.0]]] * 2
    assert [r.observation_date.hour for r in out] == [13, 15]


@pytest.mark.parametrize("steps", [1, 2, 5, 70])
def test_long_history_over_many_blocks(spark, steps):
    """Days of 3 years with holes, against a plain lookup."""
    rng = np.random.default_rng(steps)
    days = np.sort(rng.choice(1100, 500, replace=False))
    base = pd.Timestamp("1969-01-01")
    raw = [(1, (base + pd.Timedelta(days=int(d))).to_pydatetime(), float(d), None if d % 3 else float(-d)) for d in days]
    df = spark.createDataFrame(raw, "patient_id long, time_bin timestamp_ntz, a double, b double")
    out = w.own_date_windows(resample(df, ["a", "b"], "day"), ["a", "b"], steps).collect()
    known = {int(d): [float(d), None if d % 3 else float(-d)] for d in days}
    assert len(out) == len(days)
    for r in out:
        last = (pd.Timestamp(r.observation_date) - base).days
        assert r.matrix == [known.get(last - steps + 1 + s, [None, None]) for s in range(steps)]


def test_shown_prunes_windows_not_history(spark, t):
    periods = resample(records(spark, t, OWN[0][2], ["p"]), ["v"], "day").withColumn("label", F.dayofmonth("period_end"))
    out = w.own_date_windows(periods, ["v"], 2, ["label"], F.col("label") == 3).collect()
    assert [(r.label, r.matrix) for r in out] == [(3, [[2.0], [3.0]])]


def test_long_and_matrix_invert(spark, t, rows):
    cut = w.own_date_windows(resample(records(spark, t, OWN[2][2]), ["v"], "month"), ["v"], 3)
    back = w.to_matrix(w.to_long(cut, ["v"], "month", 3), ["v"])
    assert rows(cut.select("patient_id", "observation_date", "matrix")) == rows(back)


def test_second_source(spark, t):
    rows_ = [(1, "2023-01-02 10:00", 1.0, 5.0), (1, "2023-01-02 22:00", 3.0, None), (2, "2023-01-02 10:00", 9.0, 9.0)]
    ecg = spark.createDataFrame(
        [(p, t(x), a, b) for p, x, a, b in rows_], "patient_id long, ecg_time timestamp_ntz, rr double, qrs double"
    )
    spine = spark.createDataFrame([(1, t("2023-01-03"))], "patient_id long, observation_date timestamp_ntz")
    out = w.second_source_windows(ecg, spine, ["rr", "qrs"], "ecg_time", "day", 2).collect()
    assert [(r.patient_id, r.matrix) for r in out] == [(1, [[2.0, 5.0], [None, None]])]


def exchanges_above_the_window(df):
    """Exchange nodes between the result and the window that cuts the histories."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    above = executed.split("Window [")[0]
    assert "Window [" in executed and plan
    return above.count("Exchange") + above.count("Join")


def test_finished_windows_are_not_moved(spark, t):
    periods = resample(records(spark, t, OWN[0][2]), ["v"], "day")
    spine = spark.createDataFrame([("patient_1", t("2023-01-04"))], "patient_id string, observation_date timestamp_ntz")
    given = w.given_date_windows(periods, spine, ["v"], "day", 3)
    assert exchanges_above_the_window(given) == 0
    assert exchanges_above_the_window(w.merged_own_windows([(periods, ["v"]), (periods, ["v"])], 2)) == 0


@pytest.mark.parametrize("steps", [1, 3, 70])
def test_merged_sources(spark, steps):
    rng = np.random.default_rng(steps)
    base = pd.Timestamp("2001-03-01")

    def source(names, patients, seed):
        rows_ = [
            (p, (base + pd.Timedelta(days=int(d))).to_pydatetime(), *[float(d * 10 + p + i) for i in range(len(names))])
            for p in patients for d in np.sort(np.random.default_rng(seed + p).choice(400, 90, replace=False))
        ]
        frame = spark.createDataFrame(rows_, "patient_id long, time_bin timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
        return resample(frame, names, "day"), {(r[0], (pd.Timestamp(r[1]) - base).days): list(r[2:]) for r in rows_}

    (one, known), (two, other) = source(["a", "b"], [1, 2, 3], 10), source(["c"], [1, 2], 50)

    def want(p, last):
        return [known.get((p, d), [None, None]) + other.get((p, d), [None]) for d in range(last - steps + 1, last + 1)]

    own = w.merged_own_windows([(one, ["a", "b"]), (two, ["c"])], steps).collect()
    assert len(own) == len(known)
    for r in own:
        assert r.matrix == want(r.patient_id, (pd.Timestamp(r.observation_date) - base).days)
    dates = [(int(p), (base + pd.Timedelta(days=int(d))).to_pydatetime()) for p in (1, 2, 3, 4) for d in rng.integers(-20, 430, 30)]
    spine = spark.createDataFrame(dates, "patient_id long, observation_date timestamp_ntz")
    given = w.merged_windows([(one, ["a", "b"]), (two, ["c"])], spine, "day", steps).collect()
    assert {(r.patient_id, r.observation_date) for r in given} == {d for d in dates if d[0] < 3} and len(given) == len({d for d in dates if d[0] < 3})
    for r in given:
        assert r.matrix == want(r.patient_id, (pd.Timestamp(r.observation_date) - base).days)


def test_absent_periods_are_filled_once_a_block(spark):
    rows = [("p", "2020-01-31", 24241, 1.0), ("p", "2020-03-31", 24243, 2.0), ("p", "2020-03-31", 24243, 3.0),
            ("p", "2020-04-30", 24244, 4.0), (None, "2020-04-30", 24244, 5.0), ("q", "2020-04-30", 24244, None), ("q", None, None, 1.0)]
    schema = "patient_id string, period_end string, period_index int, f double"
    cut = w.own_date_windows(spark.createDataFrame(rows, schema), ["f"], 2)
    got = sorted(((r.patient_id, r.observation_date, sorted([v for v, in r.matrix], key=str)) for r in cut.collect()), key=str)
    assert got == sorted([
        ("p", "2020-01-31", [1.0, N]), ("p", "2020-03-31", [2.0, 3.0, N]), ("p", "2020-03-31", [2.0, 3.0, N]),
        ("p", "2020-04-30", [2.0, 3.0, 4.0]), (None, "2020-04-30", [5.0, N]), ("q", "2020-04-30", [N, N]),
    ], key=str)
    # a frame that slides over the history would add up every window anew
    assert "specifiedwindowframe(RangeFrame" not in cut._jdf.queryExecution().executedPlan().toString()
