"""Forest training and scoring on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.operators.balance import WEIGHT
from onsetframe.operators.evaluate import PREDICTED, SCORE, SCORES, TRUTH
from onsetframe.operators.labels import LABEL
from onsetframe.operators.windows import MATRIX

VECTOR = "features"


def with_vector(samples: DataFrame) -> DataFrame:
    """ML vector from ``matrix`` (flattened row by row) or from the array ``vector``."""
    array = F.flatten(MATRIX) if MATRIX in samples.columns else F.col("vector")
    return samples.withColumn(VECTOR, array_to_vector(array.cast("array<double>")))


def training_vectors(train: DataFrame) -> DataFrame:
    """The samples with their ML vector in place of the values it is made of.

    A fit reads its rows several times, so keep these (as a written table) and make copies of them, not of the matrices.
    """
    return with_vector(train).drop(MATRIX, "vector")


def fit_forest(
    train: DataFrame, trees: int = 100, seed: int = 0, max_depth: int = 10, label: str = LABEL, **params
) -> PipelineModel:
    """Random forest on the prepared samples or their vectors; a ``weight`` column counts a sample more than once."""
    weights = {"weightCol": WEIGHT} if WEIGHT in train.columns else {}
    forest = RandomForestClassifier(
        featuresCol=VECTOR, labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth, **weights, **params
    )
    made = VECTOR in train.columns and train.schema[VECTOR].dataType == VectorUDT()
    data = (train if made else with_vector(train)).select(VECTOR, F.col(label).cast("double").alias(label), *weights.values())
    return Pipeline(stages=[forest]).fit(data)


def score_forest(model: PipelineModel, samples: DataFrame, label: str = LABEL) -> DataFrame:
    """Predicted class and probabilities, with the truth if the samples carry it."""
    return scored_by(model, with_vector(samples), label)


def scored_by(model: PipelineModel, samples: DataFrame, label: str = LABEL) -> DataFrame:
    """The same by any pipeline that ends in a classifier."""
    drop = [MATRIX, "vector", VECTOR, WEIGHT, "rawPrediction", "probability", "prediction"]
    scored = (
        model.transform(samples)
        .withColumn(SCORES, vector_to_array("probability"))
        .withColumn(PREDICTED, F.col("prediction").cast("int"))
        .drop(*drop)
    )
    return scored.withColumnRenamed(label, TRUTH) if label in scored.columns else scored


def binary_score(scored: DataFrame) -> DataFrame:
    """Probability of class 1 as ``score``, for two classes."""
    return scored.withColumn(SCORE, F.coalesce(F.get(SCORES, F.lit(1)), F.lit(0.0))).drop(SCORES)
