import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetframe.operators import balance as bl

SCHEMA = "patient_id long, observation_date timestamp_ntz, label int, matrix array<array<double>>"


def windows(spark, t, arrays, labels):
    return spark.createDataFrame(
        [(i, t("2020-01-01"), int(y), x.tolist()) for i, (x, y) in enumerate(zip(arrays, labels))], SCHEMA
    )


def matrices(df):
    return np.array([r.matrix for r in df.orderBy("patient_id").collect()])


def test_scale_per_cell_and_feature(spark, t):
    train, test = np.arange(1.0, 13).reshape(3, 2, 2), np.arange(13.0, 21).reshape(2, 2, 2)
    a, b = windows(spark, t, train, [0, 1, 0]), windows(spark, t, test, [0, 1])
    cell = bl.fit_cell_scaler(a, 2)
    mu, sd = train.mean(0), train.std(0)
    np.testing.assert_allclose(matrices(bl.apply_scaler(a, cell)), (train - mu) / sd)
    np.testing.assert_allclose(matrices(bl.apply_scaler(b, cell)), (test - mu) / sd)
    np.testing.assert_allclose(matrices(bl.apply_scaler(a, cell)).mean(0), 0, atol=1e-12)
    feature = bl.fit_feature_scaler(a, 2, 2)
    mu, sd = train.mean((0, 1)), train.std((0, 1))
    np.testing.assert_allclose(matrices(bl.apply_scaler(b, feature)), (test - mu) / sd)


def test_constant_cell_is_only_centred(spark, t):
    df = windows(spark, t, np.ones((3, 2, 1)) * 5, [0, 1, 0])
    assert (matrices(bl.apply_scaler(df, bl.fit_cell_scaler(df, 1))) == 0).all()


@pytest.mark.parametrize("ratio,want", [("auto", (90, 90)), (0.5, (90, 45))])
def test_oversample_counts(spark, t, ratio, want):
    labels = np.array([0] * 90 + [1] * 10)
    df = windows(spark, t, np.random.default_rng(0).random((100, 10, 3)), labels)
    out = bl.oversample(df, ratio, 5).cache()
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert (counts[0], counts[1]) == want
    assert out.where("copy = 0").count() == 100
    assert out.groupBy("patient_id", "copy").count().where("count > 1").count() == 0
    whole = {r.patient_id: r.matrix for r in df.collect()}
    assert all(whole[r.patient_id] == r.matrix for r in out.collect())
    again = bl.oversample(df, ratio, 5)
    assert out.exceptAll(again).count() == 0
    out.unpersist()


def test_oversample_more_classes_and_errors(spark, t):
    df = windows(spark, t, np.zeros((30, 1, 1)), [0] * 20 + [1] * 9 + [2])
    counts = {r.label: r["count"] for r in bl.oversample(df, "auto", 1).groupBy("label").count().collect()}
    assert counts == {0: 20, 1: 20, 2: 20}
    with pytest.raises(Exception, match="no minority rows"):
        bl.oversample(df.where("label < 2"), 0.1, 1).collect()
    with pytest.raises(ValueError):
        bl.check_matrix(df.drop("label"))
    with pytest.raises(ValueError):
        bl.check_matrix(df.withColumn("matrix", F.flatten("matrix")))


def test_many_picks_use_many_chunks(spark):
    df = spark.range(25001).select(
        F.col("id").alias("patient_id"), F.lit("2020-01-01").cast("date").alias("observation_date"),
        (F.col("id") == 0).cast("int").alias("label"),
    )
    out = bl.oversample(df, "auto", 2).groupBy("label").agg(F.count("*").alias("n"), F.max("copy").alias("c"))
    assert {(r.label, r.n, r.c) for r in out.collect()} == {(0, 25000, 0), (1, 25000, 24999)}


def test_picks_are_made_by_many_tasks(spark):
    def samples(parts):
        return spark.range(0, 9_000, 1, parts).select(
            F.col("id").alias("patient_id"), F.lit(0).alias("observation_date"), F.when(F.col("id") < 100, 1).otherwise(0).alias("label")
        )

    counts = bl.repeat_counts(samples(2))
    # an exchange of thin chunks that Spark may shrink puts all picks into one task
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.agg(F.sum("times")).first()[0] == 8_800
    assert sorted(counts.collect()) == sorted(bl.repeat_counts(samples(5)).collect())


def test_picks_never_meet_in_the_driver(spark):
    samples = spark.range(0, 9_000, 1, 2).select(
        F.col("id").alias("patient_id"), F.lit(0).alias("observation_date"), F.when(F.col("id") < 100, 1).otherwise(0).alias("label")
    )
    counts = bl.repeat_counts(samples)
    assert sum(r.times for r in counts.collect()) == 8_800
    # the plan that ran, as it's chosen anew when the thin chunks have been counted
    joins = re.findall(r"(\w+Join) \[[^\]]*_number", counts._jdf.queryExecution().executedPlan().toString())
    assert set(joins) == {"SortMergeJoin"}


def test_scaler_is_fitted_once(spark, t):
    df = windows(spark, t, np.random.default_rng(2).random((30, 3, 2)), [int(i < 20) for i in range(30)])
    prepared, scaler = bl.prepare_train(df, 2, seed=4, copies=False)
    for made in (scaler, prepared, bl.prepare_test(df, 2, scaler=scaler)):
        assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_chains(spark, t, tmp_path):
    rng = np.random.default_rng(1)
    train = np.where(rng.random((12, 3, 2)) < 0.2, np.nan, rng.random((12, 3, 2)))
    as_rows = [(i, t("2020-01-01"), int(i < 9), [[None if np.isnan(v) else float(v) for v in r] for r in x])
               for i, x in enumerate(train)]
    df = spark.createDataFrame(as_rows, SCHEMA)
    filled = np.array([np.where(np.isnan(x), np.nan_to_num(np.nanmean(x, 0)), x) for x in train])
    prepared, scaler = bl.prepare_train(df, 2, seed=4)
    out = prepared.collect()
    assert sum(r.label for r in out) * 2 == len(out) == 18
    raw = np.array([filled[r.patient_id] for r in out])
    mu, sd = raw.mean(0), raw.std(0)
    np.testing.assert_allclose(np.array([r.matrix for r in out]), (raw - mu) / sd, atol=1e-9)
    tested = bl.prepare_test(df, 2, scaler=scaler)
    assert tested.count() == 12
    np.testing.assert_allclose(matrices(tested), (filled - mu) / sd, atol=1e-9)
    untouched, none = bl.prepare_train(df, 2, None, None, False)
    assert none is None and untouched.count() == 12


def test_flat_chain(spark, t):
    raw = [(i, t("2020-01-01"), int(i > 3), float(i) if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(raw, "patient_id long, observation_date timestamp_ntz, label int, a double")
    prepared, fill, scaler = bl.prepare_flat_train(df, ["a"], seed=1)
    values = prepared.collect()
    assert len(values) == 8 and abs(np.mean([r.a for r in values])) < 1e-9
    assert bl.prepare_flat_test(df, ["a"], fill, scaler).where("a is null").count() == 0


def test_weights_stand_for_copies(spark, t):
    rng = np.random.default_rng(3)
    arrays = 1e6 + rng.random((40, 3, 2))  # a large mean, where plain sums of squares lose all digits
    df = windows(spark, t, arrays, [int(i < 33) for i in range(40)])
    counts = bl.repeat_counts(df, "auto", 6)
    weighted, copied = bl.weigh_samples(df, counts).cache(), bl.repeat_samples(df, counts).cache()
    assert weighted.count() == 40 and weighted.agg(F.sum("weight")).first()[0] == copied.count() == 66
    raw = matrices(copied)
    for scaler, axis in ((bl.fit_cell_scaler(weighted, 2, "weight"), 0), (bl.fit_feature_scaler(weighted, 2, 3, "weight"), (0, 1))):
        stats = scaler.first().stats
        mu, sd = (np.array([[c[k] for c in step] for step in stats]) for k in ("mu", "sd"))
        np.testing.assert_allclose(mu, np.broadcast_to(raw.mean(axis), (3, 2)), rtol=1e-12)
        np.testing.assert_allclose(sd, np.broadcast_to(raw.std(axis), (3, 2)), rtol=1e-6)
    prepared, _ = bl.prepare_train(df, 2, seed=6, copies=False)
    assert prepared.count() == 40 and {"weight"} <= set(prepared.columns) and "copy" not in prepared.columns
    full, _ = bl.prepare_train(df, 2, seed=6)
    assert full.drop("copy").exceptAll(bl.copy_samples(prepared).drop("copy")).count() == 0 and full.count() == 66


def test_weights_with_missing_values(spark):
    rows = [(1, 1.0, None, 3), (2, 2.0, None, 1), (3, None, None, 5), (4, 8.0, None, 1)]
    df = spark.createDataFrame(rows, "i int, a double, b double, weight long")
    stats = bl.fit_vector_scaler(df, ["a", "b"], "weight").first().stats
    copies = np.array([1, 1, 1, 2, 8.0])
    assert stats.a.mu == pytest.approx(copies.mean()) and stats.a.sd == pytest.approx(copies.std())
    assert stats.b.mu is None


def test_forest_takes_weights(spark, t):
    from onsetframe.operators import learn

    rng = np.random.default_rng(4)
    arrays = rng.random((60, 2, 2))
    df = windows(spark, t, arrays, (arrays[:, 0, 0] > 0.8).astype(int))
    prepared, scaler = bl.prepare_train(df, 2, seed=1, copies=False)
    model = learn.fit_forest(prepared, trees=5, seed=1, max_depth=3)
    assert model.stages[-1].getWeightCol() == "weight"
    assert learn.score_forest(model, bl.prepare_test(df, 2, scaler=scaler)).count() == 60


def test_copies_of_vectors_fit_like_copies_of_matrices(spark, t):
    from onsetframe.operators import learn

    arrays = np.random.default_rng(5).random((60, 2, 2))
    df = windows(spark, t, arrays, (arrays[:, 0, 0] > 0.8).astype(int)).coalesce(1)
    prepared, scaler = bl.prepare_train(df, 2, seed=1, copies=False)
    vectors = learn.training_vectors(prepared)
    assert set(vectors.columns) == {"patient_id", "observation_date", "label", "weight", "features"}
    tested = bl.prepare_test(df, 2, scaler=scaler)

    def scores(train):
        scored = learn.score_forest(learn.fit_forest(train, trees=5, seed=1, max_depth=3), tested)
        return {r.patient_id: r.scores for r in scored.collect()}

    assert scores(bl.copy_samples(vectors)) == scores(bl.copy_samples(prepared))
    assert scores(vectors) == scores(prepared)
