import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from onsetframe.operators import balance, parts, samples
from onsetframe.operators.windows import MATRIX
from onsetframe.plans.learning import learn

SCHEMA = "patient_id long, observation_date date, label int, split string, matrix array<array<double>>"


@pytest.fixture
def data(spark):
    import datetime

    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.2)
        x = rng.normal(size=(5, 2)) + [3 * y, 0]
        gaps = rng.random((5, 2)) < 0.15
        rows.append((i, datetime.date(2020, 1, 1), y, "test" if i % 4 == 0 else "train", [[None if g else float(v) for v, g in zip(*r)] for r in zip(x, gaps)]))
    return spark.createDataFrame(rows, SCHEMA)


class Halver(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A scaler of one's own."""

    def _transform(self, dataset):
        return dataset.withColumn(MATRIX, F.transform(MATRIX, lambda row: F.transform(row, lambda v: v / 2)))


class TakeAll(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A resampler of one's own: the rare class counts four times."""

    def _transform(self, dataset):
        label = F.col("label") if "label" in dataset.columns else F.lit(0)
        return dataset.withColumn("weight", F.when(label == 1, 4).otherwise(1).cast("long"))


def forest():
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=5, seed=1, maxDepth=3)


def scores(model, df):
    return {r.patient_id: tuple(r.probability) for r in model.transform(df).collect()}


def test_chain_is_one_pipeline_that_can_be_saved(data, tmp_path):
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    chain = [parts.WindowImputer(width=2), parts.Oversampler(seed=3), parts.CellScaler(width=2), parts.WindowVector()]
    model = Pipeline(stages=[*chain, forest()]).fit(train)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert scores(loaded, test) == scores(model, test) and len(scores(loaded, test)) == 40
    # the same windows as the functions give
    prepared, scaler = balance.prepare_train(train, 2, seed=3, copies=False)
    want = {r.patient_id: (r.weight, r.matrix) for r in prepared.collect()}
    fitted = train
    for stage in model.stages[:3]:
        fitted = stage.transform(fitted)
    got = {r.patient_id: (r.weight, r.matrix) for r in fitted.collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] for p in want)
    np.testing.assert_allclose([got[p][1] for p in want], [want[p][1] for p in want])
    tested = balance.prepare_test(test, 2, scaler=scaler)
    again = loaded.stages[2].transform(loaded.stages[0].transform(test))
    np.testing.assert_allclose(
        [r.matrix for r in again.orderBy("patient_id").collect()], [r.matrix for r in tested.orderBy("patient_id").collect()]
    )
    unfitted = str(tmp_path / "plan")
    Pipeline(stages=[*chain, forest()]).write().overwrite().save(unfitted)
    assert scores(Pipeline.load(unfitted).fit(train), test) == scores(model, test)


def test_own_scaler_and_resampler(data, tmp_path):
    plan = Pipeline(stages=[parts.WindowImputer(width=2, strategy="median"), TakeAll(), Halver(), parts.WindowVector(), forest()])
    learned = learn(data, 2, pipeline=plan)
    metrics = {r.metric: r.value for r in learned.metrics.collect()}
    assert metrics["accuracy"] > 0.8 and learned.predictions.count() == 40
    path = str(tmp_path / "own")
    learned.model.write().overwrite().save(path)
    test = data.where("split = 'test'")
    loaded = PipelineModel.load(path)
    assert scores(loaded, test) == scores(learned.model, test)
    assert type(loaded.stages[2]).__name__ == "Halver"


@pytest.mark.parametrize("strategy", ["mean", "constant"])
def test_scale_per_feature(data, strategy):
    imputer = parts.WindowImputer(width=2, strategy=strategy, constant=9.0)
    filled = imputer.transform(data)
    assert imputer.getOrDefault("strategy") == strategy
    model = parts.CellScaler(width=2, steps=5).fit(filled)
    raw = np.array([r.matrix for r in filled.orderBy("patient_id").collect()])
    got = np.array([r.matrix for r in model.transform(filled).orderBy("patient_id").collect()])
    np.testing.assert_allclose(got, (raw - raw.mean((0, 1))) / raw.std((0, 1)))


def test_learned_features(data, tmp_path):
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    chain = [parts.Oversampler(seed=1), parts.RelevantFeatures(features=["a", "b"], groups=["basic", "change"])]
    plan = Pipeline(stages=[*chain, LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=20)])
    model = plan.fit(train)
    names = model.stages[1].names()
    assert "a__mean" in names and "b__mean" not in names
    path = str(tmp_path / "features")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.stages[1].names() == names and scores(loaded, test) == scores(model, test)
    truth = {r.patient_id: r.label for r in test.collect()}
    assert np.mean([(s[1] > 0.5) == truth[p] for p, s in scores(loaded, test).items()]) > 0.9
    with pytest.raises(ValueError, match="bears on"):
        parts.RelevantFeatures(features=["a", "b"], fdr=1e-300).fit(train)
    every = parts.WindowFeatures(features=["a", "b"], groups=["trend"])
    assert len(every.transform(train).first().features) == len(every.names()) == 6


def test_contracts(data):
    class Own:
        name, width = "own", 2

        def windows(self, spine):
            return spine.join(data.select("patient_id", "observation_date", "matrix"), ["patient_id", "observation_date"])

    assert isinstance(Own(), parts.DataSource) and isinstance(parts.SideBySide(), parts.Aggregator)
    assert not isinstance(Own(), parts.Evaluator)
    spine = samples.sample_keys(data)
    both = parts.SideBySide().combine([Own().windows(spine), Own().windows(spine)])
    assert len(both.first().matrix[0]) == 4
