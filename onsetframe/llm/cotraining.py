"""Quality classifier by co-training.

Two views of a document: its text content (how classes of characters follow each other, how much
repeats) and its metadata (source, language, length). Each view has its own logistic regression. In
every round each classifier labels the unlabelled documents it is sure of, and these pseudo-labels go
to the other classifier's next fit. All fits run on all labelled rows and all confident ones, spread
over the cluster. At the end each view's margin is calibrated on labelled rows that no fit has
seen, and a document's score is the probability of their sum, the common prior counted once.

Defined results: a null or empty text has neutral content; null metadata is a value of its own;
labels without a document or without a quality are not used; a document labelled both ways counts as
both; repeated rows are scored each; if a fit lacks a class, scores are null and everything is kept;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetframe.llm.texts import SPACES, slices, utf8
from onsetframe.session import checkpointed

ROUNDS = 2
SURE = 0.97  # a view is sure of a class from this probability on
PSEUDO_WEIGHT = 0.3
KEEP_FROM = 0.5
METADATA_SIZE = 128
ITERATIONS = 12
CALIBRATION_SHARE = 4  # one labelled document in four serves calibration only

# classes of bytes: letters, capitals, digits, spaces, line ends, sentence marks, exclamation marks, other signs
CLASSES = 8
CLASS = np.full(256, 7, np.int64)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[0x80:] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[9, 11, 12, 13, 32]] = 3
CLASS[10] = 4
CLASS[list(b".,;:?'\"-()")] = 5
CLASS[33] = 6


def content(text: bytes) -> np.ndarray:
    """Shares of pairs of byte classes, of distinct words and of repeated lines."""
    octets = CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(octets[:-1] * CLASSES + octets[1:], minlength=CLASSES**2) if len(octets) > 1 else np.zeros(CLASSES**2)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return np.concatenate([
        pairs / max(len(octets) - 1, 1),
        [len(set(words)) / max(len(words), 1), 1 - len(set(lines)) / max(len(lines), 1)],
    ]).astype(np.float32)


def views(docs: DataFrame) -> DataFrame:
    """``doc_id, content, source, lang, size_class`` in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [content(t) for t in utf8(part)]
            offsets = pa.array((np.arange(len(rows) + 1) * (CLASSES**2 + 2)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "source", "lang", "size_class")],
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))],
                ["doc_id", "source", "lang", "size_class", "content"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # lengths in steps of a quarter of their logarithm
    size_class = F.coalesce(F.floor(F.log1p(F.col("n_chars").cast("double")) * 4).cast("string"), F.lit("none"))
    rows = docs.select(
        "doc_id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("source", "lang")],
        size_class.alias("size_class"),
    )
    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, size_class string, content array<float>")


def _margin(view: str) -> Column:
    return vector_to_array(F.col(f"raw_{view}"))[1]


def _fit(rows: DataFrame, view: str, iterations: int = ITERATIONS):
    """A logistic regression on ``view``; None unless both classes occur."""
    classes = rows.agg(F.countDistinct("label")).first()[0]
    if classes < 2:
        return None
    return LogisticRegression(
        featuresCol=view, labelCol="label", weightCol="weight", maxIter=iterations, regParam=1e-3,
        rawPredictionCol=f"raw_{view}", probabilityCol=f"p_{view}", predictionCol=f"class_{view}",
    ).fit(rows)


def _probability(view: str) -> Column:
    return vector_to_array(F.col(f"p_{view}"))[1]


VIEWS = ("text_view", "meta_view")


def cotrained_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every document."""
    hasher = FeatureHasher(inputCols=["source", "lang", "size_class"], outputCol="meta_view", numFeatures=METADATA_SIZE)
    # one row per labelled document; labels grow with the corpus, so they are merged at every size
    truth = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.col("quality").cast("double"))).alias("labels")
    ).hint("merge")
    thin = checkpointed(views(docs).join(truth, "doc_id", "left"))
    vectors = hasher.transform(thin).withColumn("text_view", array_to_vector("content"))
    ready, unlabelled = vectors.select("doc_id", *VIEWS), vectors.where("labels IS NULL").select(*VIEWS)
    labelled = vectors.select("doc_id", *VIEWS, F.explode("labels").alias("label"), F.lit(1.0).alias("weight"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    fit_rows, held = labelled.where(~held_out), labelled.where(held_out)
    models = {v: _fit(fit_rows.select(v, "label", "weight"), v) for v in VIEWS}
    for _ in range(rounds):
        if None in models.values():
            break
        judged = unlabelled
        for v in VIEWS:
            judged = models[v].transform(judged)
        given = {}
        for view, teacher in (VIEWS, VIEWS[::-1]):
            p = _probability(teacher)
            sure = judged.where((p >= SURE) | (p <= 1 - SURE))
            given[view] = sure.select(view, F.when(p >= SURE, 1.0).otherwise(0.0).alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"))
        models = {v: _fit(fit_rows.select(v, "label", "weight").unionByName(given[v]), v) for v in VIEWS}
    if None in models.values():
        nothing = F.lit(None).cast("double")
        return ready.select("doc_id", nothing.alias("text_score"), nothing.alias("meta_score"), nothing.alias("score"), F.lit(True).alias("kept"))

    scored, odds = ready, {}
    for v in VIEWS:
        margins = models[v].transform(held).select(
            array_to_vector(F.array(_margin(v))).alias("m"), "label", "weight"
        )
        platt = _fit(margins.withColumnRenamed("m", "margin"), "margin")
        slope, shift = (float(platt.coefficients[0]), float(platt.intercept)) if platt else (1.0, 0.0)
        scored = models[v].transform(scored)
        odds[v] = _margin(v) * slope + shift
    # independent views add up their evidence; each has the classes' own odds in it once
    good, rows = held.agg(F.sum("label"), F.count("*")).first()
    common = float(np.log(((good or 0.0) + 0.5) / (rows - (good or 0.0) + 0.5)))
    both = odds["text_view"] + odds["meta_view"] - common

    def chance(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    return scored.select(
        "doc_id", chance(odds["text_view"]).alias("text_score"), chance(odds["meta_view"]).alias("meta_score"),
        chance(both).alias("score"), (chance(both) >= KEEP_FROM).alias("kept"),
    )


def op5_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrained_scores(docs, labels)
