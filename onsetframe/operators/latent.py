"""Latent compression of wide windows by a randomised range finder.

The principal directions come from a few passes over the samples. A pass multiplies each partition with a thin matrix, reduces the
product to its triangular factor, stacks and reduces these factors in a tree, and sums the products back. No matrix of
all feature pairs exists anywhere: a task and the driver hold (steps x features) x (latent_dim + a few) numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onsetframe.operators.windows import MATRIX

EXTRA = 8  # directions beyond the wanted ones, for accuracy
POWER_PASSES = 3
TREE = 64  # partial results that one task of the tree merges at most, up to TREE squared partitions


def flat(samples: DataFrame) -> DataFrame:
    """The window of each sample as one array, from ``matrix`` or ``vector``."""
    array = F.flatten(MATRIX) if MATRIX in samples.columns else F.col("vector")
    return samples.withColumn("_x", array.cast("array<double>"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("_x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["r", "w"])


def _unpacked(table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for r, w in zip(table.column("r").to_pylist(), table.column("w").to_pylist()):
        yield np.frombuffer(r).reshape(-1, width), np.frombuffer(w)


def _pass(vectors: DataFrame, middle: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangular factor of Y = (A - middle) thin, and (A - middle)' Y with the sum of squares of A behind it."""
    size = thin.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, w, squares = np.zeros((0, size)), np.zeros((len(middle), size)), 0.0
        for batch in batches:
            x = _rows(batch)
            if len(x):
                x = x - middle
                y = x @ thin
                r = np.linalg.qr(np.vstack((r, y)), mode="r")
                w += x.T @ y
                squares += float((x * x).sum())
        yield _packed([r, np.r_[w.ravel(), squares]])

    def merge(table: pa.Table) -> pa.Table:
        parts = list(_unpacked(table, size))
        r = np.linalg.qr(np.vstack([p for p, _ in parts]), mode="r")
        return pa.Table.from_batches([_packed([r, np.sum([w for _, w in parts], axis=0)])])

    parts = vectors.mapInArrow(part, "r binary, w binary").withColumn("_node", F.spark_partition_id() % TREE)
    merged = parts.groupBy("_node").applyInArrow(lambda t: merge(t.select(["r", "w"])), "r binary, w binary").toArrow()
    found = list(_unpacked(merged, size))
    triangle = np.linalg.qr(np.vstack([r for r, _ in found]), mode="r")
    # fewer samples than directions leave rows of zeros
    triangle = np.vstack((triangle, np.zeros((size - len(triangle), size))))
    return triangle, np.sum([w for _, w in found], axis=0)


def _mean(vectors: DataFrame) -> tuple[np.ndarray, int]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            x = _rows(batch)
            if len(x):
                total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.atleast_1d(total).tolist()])], ["n", "total"])

    parts = vectors.mapInArrow(part, "n long, total array<double>").where("n > 0")
    sums = parts.select("n", F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = sums.orderBy("i").collect()  # one row per step and feature
    if not rows:
        raise ValueError("no samples to fit on")
    return np.array([r.v / r.n for r in rows]), rows[0].n


def fit_latent(train: DataFrame, latent_dim: int, seed: int = 0) -> LatentModel:
    """Principal directions of the windows; ``train`` is read a few times and should be a written table."""
    vectors = flat(train).select("_x")
    middle, n = _mean(vectors)
    wide = len(middle)
    size = min(latent_dim + EXTRA, wide)
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, size)))[0]
    for last in [False] * POWER_PASSES + [True]:
        triangle, back = _pass(vectors, middle, thin)
        product, squares = back[:-1].reshape(wide, size), back[-1]
        if not last:
            thin = np.linalg.qr(product)[0]
    # Y = QR, so Q'A = (R')^-1 Y'A; its right singular vectors are the directions
    _, scale, directions = np.linalg.svd(np.linalg.pinv(triangle.T) @ product.T, full_matrices=False)
    directions, scale = directions[:latent_dim], scale[:latent_dim]
    most = np.abs(directions).argmax(axis=1)
    directions = directions * np.sign(directions[np.arange(len(directions)), most])[:, None]
    shares = scale**2 / squares if squares else np.zeros(len(scale))
    return LatentModel(state=json.dumps({"n": n, "mean": middle.tolist(), "directions": directions.tolist(), "shares": shares.tolist()}))


class LatentModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``vector``: the window on the principal directions, the largest entry of each direction positive."""

    state = Param(Params._dummy(), "state", "mean, directions and their shares of the variance as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _state(self, name: str) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault(self.state))[name])

    @property
    def directions(self) -> np.ndarray:
        return self._state("directions")

    @property
    def shares(self) -> np.ndarray:
        """Share of all variance along each direction."""
        return self._state("shares")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        middle, directions = self._state("mean"), self.directions

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = (_rows(batch) - middle) @ directions.T if batch.num_rows else np.zeros((0, len(directions)))
                vector = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
                others = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*others, vector], [*kept, "vector"])

        narrow = flat(dataset).drop(MATRIX, "vector")
        kept = [c for c in narrow.columns if c != "_x"]
        schema = narrow.drop("_x").schema.add("vector", T.ArrayType(T.DoubleType()))
        return narrow.mapInArrow(project, schema)
