import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from onsetframe.operators import demographics as dm
from onsetframe.operators import samples as sm

KEY = "patient_id string, observation_date timestamp_ntz"
MATRICES = f"{KEY}, matrix array<array<double>>"


@pytest.fixture
def records(spark, t):
    def three(row):
        return [list(row)] * 3

    raw = [
        ("p1", "2016-02-29 13:00", (1.11, 1.12)), ("p2", "2025-01-29 12:00", (2.11, 2.12)),
        ("p2", "2028-05-12 19:30", (2.21, 2.22)), ("p4", "2020-06-04 02:00", (None, None)),
        ("p4", "2020-06-04 08:00", (4.21, None)), ("p4", "2023-11-11 11:11", (4.31, 4.32)),
    ]
    return spark.createDataFrame([(p, t(x), three(v)) for p, x, v in raw], MATRICES)


def test_keys_and_alignment(spark, t, records):
    keys = sm.sample_keys(records)
    assert keys.count() == 6
    extra = keys.unionByName(spark.createDataFrame([("p5", t("2020-01-01"))], KEY))
    got = {r.patient_id: r.matrix for r in sm.align_to_keys(extra, records, 3, 2).collect() if r.patient_id == "p5"}
    assert got["p5"] == [[None, None]] * 3
    filled = sm.align_to_keys(extra, records, 3, 2, 1.0).where("patient_id = 'p5'").first()
    assert filled.matrix == [[1.0, 1.0]] * 3
    assert sm.align_to_keys(keys, records, 3, 2).count() == 6


def test_labels_for_missing_key_fails(spark, t, records):
    keys = sm.sample_keys(records)
    labels = keys.withColumn("label", F.lit(1))
    assert sm.labels_for(keys, labels).where("label = 1").count() == 6
    with pytest.raises(PySparkException):
        sm.labels_for(keys, labels.where("patient_id <> 'p2'")).collect()


def test_impute_windows(spark, t):
    matrix = [[1.0, None, 5.0], [None, None, 5.0], [4.0, None, 1.0], [4.0, None, None]]
    df = spark.createDataFrame([("p", t("2020-01-01"), matrix)], MATRICES)

    def column(strategy, j, **kw):
        return [r[j] for r in sm.impute_windows(df, 3, strategy, **kw).first().matrix]

    assert column("mean", 0) == [1.0, 3.0, 4.0, 4.0]
    assert column("mean", 1) == [0.0] * 4
    assert column("median", 0) == [1.0, 4.0, 4.0, 4.0]
    assert column("most_frequent", 2) == [5.0, 5.0, 1.0, 5.0]
    assert column("constant", 1, constant=7.0) == [7.0] * 4
    assert column(lambda s: F.array_max(s), 2) == [5.0, 5.0, 1.0, 5.0]


def test_column_fill(spark):
    train = spark.createDataFrame([(1.0, 2.0, None), (None, 2.0, None), (4.0, 9.0, None)], "a double, b double, c double")
    test = spark.createDataFrame([(None, None, None)], "a double, b double, c double")
    columns = ["a", "b", "c"]
    want = {"mean": (2.5, 13 / 3, 0.0), "median": (2.5, 2.0, 0.0), "most_frequent": (1.0, 2.0, 0.0)}
    for strategy, values in want.items():
        fill = sm.fit_column_fill(train, columns, strategy)
        assert tuple(sm.apply_column_fill(test, fill, columns).first()) == pytest.approx(values)


@pytest.mark.parametrize("n,size", [(5, 0.2), (5, 0.4), (3, 0.5), (700, 0.2), (10, 3)])
def test_split_counts(spark, t, n, size):
    raw = [(f"p{i}", t(f"2020-01-{1 + j:02d}")) for i in range(n) for j in range(i % 3 + 1)]
    out = sm.split_by_patient(spark.createDataFrame(raw, KEY), size, 11)
    sides = out.groupBy("patient_id").agg(F.count_distinct("split").alias("k"), F.min("split").alias("s")).collect()
    assert out.count() == len(raw) and all(r.k == 1 for r in sides)
    assert sum(r.s == "test" for r in sides) == (size if isinstance(size, int) else math.ceil(size * n))


def test_stratified_counts(spark, t):
    raw = [(f"p{i}", t("2020-01-01"), int(i < 10)) for i in range(60)]
    out = sm.split_stratified(spark.createDataFrame(raw, KEY + ", label int"), 0.25, 3)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(1, "test"): 3, (1, "train"): 7, (0, "test"): 13, (0, "train"): 37}


def test_demographics(spark, t):
    patients = spark.createDataFrame([("1", "F", 52, 2180), ("2", "M", 60, 2180), ("3", "X", 1, 2180)],
                                     "patient_id string, gender string, age int, anchor_year int")
    spine = spark.createDataFrame(
        [("1", t("2181-01-01")), ("1", t("2182-01-01")), ("2", t("2181-01-01")), ("3", t("2181-01-01")), ("9", t("2181-01-01"))],
        KEY,
    )
    at = dm.demographics_at_dates(spine, patients)
    assert sorted((r.patient_id, r.age) for r in at.collect() if r.age) == [("1", 53), ("1", 54), ("2", 61), ("3", 2)]
    matrices = {(r.patient_id, r.observation_date.year): r.matrix for r in dm.demographics_matrix(at).collect()}
    assert matrices[("2", 2181)] == [[61.0, 1.0]]
    assert matrices[("3", 2181)] == [[2.0, None]] and matrices[("9", 2181)] == [[None, None]]
    long = sm.extend_timesteps(dm.demographics_matrix(at), 5).where("patient_id = '1'").first().matrix
    assert len(long) == 5 and len(set(map(tuple, long))) == 1
    assert sm.single_step(dm.demographics_matrix(at)).where("patient_id = '2'").first().vector == [61.0, 1.0]
    onehot = dm.gender_onehot(at.where("patient_id <> '3'"), ["F", "M"])
    assert onehot.columns == ["patient_id", "observation_date", "gender_M", "age"]
    assert dm.gender_onehot(at, ["F", "M", "X"]).columns[2:5] == ["gender_F", "gender_M", "gender_X"]


def test_combine(spark, t):
    keys = [(f"p{i}", t("2020-01-01")) for i in range(4)]
    rng = np.random.default_rng(0)
    a, b = rng.random((4, 5, 8)), rng.random((4, 5, 6))
    v, u = rng.random((4, 10)), rng.random((4, 15))
    m = [spark.createDataFrame([(*k, x.tolist()) for k, x in zip(keys, arr)], MATRICES) for arr in (a, b)]
    f = [spark.createDataFrame([(*k, x.tolist()) for k, x in zip(keys, arr)], KEY + ", vector array<double>") for arr in (v, u)]

    def ordered(df, c):
        return np.array([r[c] for r in df.orderBy("patient_id").collect()])

    np.testing.assert_array_equal(ordered(sm.combine_sources(m), "matrix"), np.concatenate([a, b], axis=-1))
    np.testing.assert_array_equal(ordered(sm.combine_sources(f), "vector"), np.concatenate([v, u], axis=-1))
    np.testing.assert_array_equal(
        ordered(sm.combine_sources([m[0], f[0]]), "vector"), np.hstack([a.reshape(4, -1), v])
    )
    np.testing.assert_array_equal(ordered(sm.combine_sources([m[0]]), "matrix"), a)
    np.testing.assert_array_equal(ordered(sm.feature_series(m[0], 2), "series"), a[:, :, 2])
    np.testing.assert_array_equal(ordered(sm.flatten_windows(m[0]), "vector"), a.reshape(4, -1))
    with pytest.raises(PySparkException):
        sm.combine_sources([m[0], m[1].where("patient_id <> 'p1'")]).collect()


@pytest.mark.parametrize("name", ["mean", "most_frequent"])
def test_whole_batches_fill_like_single_windows(spark, name):
    nan = float("nan")
    rows = [
        (1, [[1.0, None], [2.0, None], [2.5, None]]), (2, [[1.0, None], [1.0, 5.0]]), (3, None), (4, []),
        (5, [[None, 3.0], None, [4.0]]), (6, [[1.0, 2.0, 9.0], [None, nan, None], [3.0, nan, None]]), (7, [[3.0, nan], [2.0, 1.0], [None, None]]),
    ]
    windows = spark.createDataFrame(rows, "id int, matrix array<array<double>>")
    single = {r.id: str(r.matrix) for r in sm.impute_windows(windows, 2, sm.STRATEGIES[name]).collect()}
    whole = sm.impute_windows(windows, 2, name)
    assert {r.id: str(r.matrix) for r in whole.collect()} == single
    assert "MapInArrow" in whole._jdf.queryExecution().executedPlan().toString()
