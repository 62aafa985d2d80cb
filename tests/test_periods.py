import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onsetframe.functions.periods import (
    index_end,
    needs_origin,
    parse_frequency,
    period_end,
    period_index,
    time_bin,
)

EDGES = [
    "2023-01-01 23:30", "2023-01-02 00:00", "2024-02-29 12:00", "2024-02-28 23:59", "2023-12-31 00:00",
    "2023-12-31 23:59", "2024-01-01 00:00", "1969-12-28 10:00", "1969-12-31 10:00", "2023-04-30 23:30", "2023-05-01 00:00",
]


def frame(spark, t, texts):
    return spark.createDataFrame([(t(x),) for x in texts], "ts timestamp_ntz")


def test_period_ends(spark, t):
    df = frame(spark, t, EDGES).select("ts", *[period_end("ts", u).alias(u) for u in ("day", "week", "month", "year")])
    for r in df.collect():
        ts = pd.Timestamp(r.ts)
        assert r.day == ts.date()
        assert r.week == pd.offsets.Week(weekday=6).rollforward(ts.normalize()).date()
        assert r.month == pd.offsets.MonthEnd().rollforward(ts.normalize()).date()
        assert r.year == pd.offsets.YearEnd().rollforward(ts.normalize()).date()


@pytest.mark.parametrize("unit", ["day", "week", "month", "year"])
def test_index_inverts(spark, t, unit):
    df = frame(spark, t, EDGES)
    bad = df.where(index_end(period_index("ts", unit), unit) != period_end("ts", unit))
    assert bad.count() == 0


@pytest.mark.parametrize("unit,offset", [("day", "D"), ("week", "W"), ("month", "ME"), ("year", "YE")])
def test_index_counts_periods(spark, unit, offset):
    ends = pd.date_range("1965-01-01", "2030-12-31", freq=offset)
    df = spark.createDataFrame([(i, e.to_pydatetime()) for i, e in enumerate(ends)], "i int, ts timestamp_ntz")
    got = df.select(F.min(period_index("ts", unit) - F.col("i")), F.max(period_index("ts", unit) - F.col("i"))).first()
    assert got[0] == got[1]


def test_unknown_unit_and_frequency():
    with pytest.raises(ValueError):
        period_end(F.lit(None), "decade")
    for bad in ("x", "2W", "0h", "hh", ""):
        with pytest.raises(ValueError):
            parse_frequency(bad)


@pytest.mark.parametrize("freq", ["h", "D", "2h", "30min", "90s", "W", "ME", "YE"])
def test_time_bin_like_pandas(spark, t, freq):
    df = frame(spark, t, EDGES).select("ts", time_bin("ts", freq).alias("bin"))
    for r in df.collect():
        series = pd.Series([1.0], index=[pd.Timestamp(r.ts)])
        assert r.bin == series.resample(freq).sum().index[-1].to_pydatetime(), r


@pytest.mark.parametrize("freq", ["5h", "7min", "36h", "2D"])
def test_time_bin_counts_from_first_day(spark, t, freq):
    assert needs_origin(freq)
    texts = ["2024-01-01 13:10", "2024-01-02 01:05", "2024-01-03 09:59:59", "2024-01-05 00:00"]
    df = frame(spark, t, texts).select("ts", time_bin("ts", freq, F.lit("2024-01-01").cast("date")).alias("bin"))
    series = pd.Series(1, index=pd.DatetimeIndex([t(x) for x in texts]))
    observed = series.resample(freq).count()
    assert {r.bin for r in df.collect()} == {i.to_pydatetime() for i in observed[observed > 0].index}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(min_value=pd.Timestamp("1950-01-01").to_pydatetime(),
                             max_value=pd.Timestamp("2050-01-01").to_pydatetime()), min_size=1, max_size=30))
def test_hour_bin_property(spark, moments):
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz").select("ts", time_bin("ts", "h").alias("b"))
    assert all(r.b == r.ts.replace(minute=0, second=0, microsecond=0) for r in df.collect())
