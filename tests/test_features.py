import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onsetframe.functions.ranking import grouped_quantile, number_by_hash, with_rows_below
from onsetframe.operators import tsfeatures as ts

SCHEMA = "patient_id long, observation_date timestamp_ntz, matrix array<array<double>>"


def expected(x, steps, length):
    n, m = len(x), x.mean()
    d = np.diff(x)
    out = {
        "count": n, "sum": x.sum(), "mean": m, "median": np.median(x), "min": x.min(), "max": x.max(),
        "stddev_pop": x.std(), "rms": math.sqrt((x**2).mean()), "abs_energy": (x**2).sum(),
        "q10": np.quantile(x, 0.1), "q90": np.quantile(x, 0.9), "missing_share": 1 - n / length,
        "mean_abs_change": np.abs(d).mean() if n > 1 else None, "abs_sum_of_changes": np.abs(d).sum(),
        "mean_change": (x[-1] - x[0]) / (n - 1) if n > 1 else None, "cid": math.sqrt((d**2).sum()),
        "first": x[0], "last": x[-1], "first_location_max": x.argmax() / n,
        "last_location_max": 1 - x[::-1].argmax() / n, "first_location_min": x.argmin() / n,
        "last_location_min": 1 - x[::-1].argmin() / n, "count_above_mean": (x > m).sum(), "count_below_mean": (x < m).sum(),
        "zero_crossings": ((x[1:] > 0) != (x[:-1] > 0)).sum(), "mean_crossings": ((x[1:] > m) != (x[:-1] > m)).sum(),
    }
    for name, above in (("above", x > m), ("below", x < m)):
        best = run = 0
        for flag in above:
            run = run + 1 if flag else 0
            best = max(best, run)
        out[f"longest_strike_{name}_mean"] = best
    if n > 1:
        out["slope"], out["intercept"] = np.polyfit(steps, x, 1)
    if n > 2 and x.std() > 0:
        out["autocorr_1"] = ((x[:-1] - m) * (x[1:] - m)).mean() / x.var()
        out["skew"] = ((x - m) ** 3).mean() / x.std() ** 3
        out["kurtosis"] = ((x - m) ** 4).mean() / x.var() ** 2 - 3
        out["r2"] = np.corrcoef(steps, x)[0, 1] ** 2
    return out


def test_catalogue(spark, t):
    rng = np.random.default_rng(5)
    samples = [np.where(rng.random((8, 2)) < 0.3, np.nan, np.round(rng.normal(size=(8, 2)), 3)) for _ in range(20)]
    samples.append(np.full((8, 2), np.nan))
    samples.append(np.ones((8, 2)))
    df = spark.createDataFrame(
        [(i, t("2020-01-01"), [[None if np.isnan(v) else float(v) for v in r] for r in x]) for i, x in enumerate(samples)],
        SCHEMA,
    )
    out = ts.extract_features(df, ["a", "b"]).collect()
    assert len(out) == 2 * len(samples)
    for r in out:
        series = samples[r.patient_id][:, "ab".index(r.feature)]
        keep = ~np.isnan(series)
        if not keep.any():
            assert r["count"] == 0 and r["mean"] is None and r["longest_strike_above_mean"] == 0
            continue
        for name, value in expected(series[keep], np.arange(8)[keep], 8).items():
            if value is None:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(value, abs=1e-9), name


def test_feature_table_imputation(spark, t):
    inf = float("inf")
    raw = [(i, t("2020-01-01"), "f", v) for i, v in enumerate([1.0, 2.0, 9.0, None, inf, -inf])]
    raw += [(i, t("2020-01-01"), "g", None) for i in range(2)]
    df = spark.createDataFrame(raw, "patient_id long, observation_date timestamp_ntz, name string, value double")
    got = {(r.name, r.patient_id): r.value for r in ts.impute_feature_table(df).collect()}
    assert [got[("f", i)] for i in range(6)] == [1.0, 2.0, 9.0, 2.0, 9.0, 1.0]
    assert got[("g", 0)] == 0.0
    wide = ts.wide_feature_table(ts.impute_feature_table(df), ["f", "g"])
    assert wide.columns == ["patient_id", "observation_date", "f", "g"] and wide.count() == 6


def rank_sum(x, y):
    """z of the rank sum test by pandas ranks."""
    ranks = pd.Series(x).rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    u = ranks[y == 1].sum() - n1 * (n1 + 1) / 2
    ties = pd.Series(x).value_counts()
    n = n1 + n0
    var = n1 * n0 / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1)))
    return u, np.sign(u - n1 * n0 / 2) * max(abs(u - n1 * n0 / 2) - 0.5, 0) / math.sqrt(var)


def test_rank_sum_and_selection(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    values = {"good": np.round(y + rng.normal(size=300), 1), "noise": np.round(rng.normal(size=300), 1),
              "constant": np.ones(300)}
    raw = [(n, float(v), int(k)) for n, x in values.items() for v, k in zip(x, y)]
    df = spark.createDataFrame(raw, "name string, value double, label int")
    tests = ts.rank_sum_test(df)
    got = {r.name: (r.u, r.z) for r in tests.collect()}
    for name in ("good", "noise"):
        assert got[name] == pytest.approx(rank_sum(values[name], y))
    assert got["constant"][1] is None
    selected = ts.select_relevant(tests)
    assert ts.relevant_names(selected) == ["good"]
    assert {r.name: round(r.p_value, 3) for r in selected.collect()}["constant"] == 1.0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_grouped_quantile(spark, q):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": np.round(rng.normal(scale=100, size=500), 1)})
    pdf.loc[0:3, "v"] = 0.0
    out = grouped_quantile(spark.createDataFrame(pdf), ["g"], "v", q, "x").collect()
    for r in out:
        assert r.x == pytest.approx(np.quantile(pdf.v[pdf.g == r.g], q))


def test_rows_below_and_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    numbered = number_by_hash(df, ["g"], F.md5(F.col("id").cast("string")), ["id"], "k").collect()
    for g in (0, 1):
        assert sorted(r.k for r in numbered if r.g == g) == list(range(500))
    counts = spark.createDataFrame([(-1e300, 2), (-3.5, 1), (0.0, 4), (1e-300, 1), (5.0, 3)], "v double, n long")
    below = {r.v: r.rows_below for r in with_rows_below(counts, [], "v").collect()}
    assert below == {-1e300: 0, -3.5: 2, 0.0: 3, 1e-300: 7, 5.0: 8}
