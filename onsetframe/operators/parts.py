"""The preparation steps as ``pyspark.ml`` stages, and the contracts of what can be put in their place.

A learning plan is one ``Pipeline`` over window samples: imputer, resampler, scaler, extractor, model. Any stage with the
same input and output columns can stand in for one of these; the stages here can be saved and loaded with the
pipeline. Samples have the key columns, ``matrix`` and, for fitting, ``label``.
"""

from __future__ import annotations

import json
from typing import Protocol, runtime_checkable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.functions.ranking import grouped_quantile
from onsetframe.operators import balance, relevance, samples, tsfeatures
from onsetframe.operators.labels import LABEL
from onsetframe.operators.windows import MATRIX
from onsetframe.schemas import KEYS
from onsetframe.session import checkpointed

VECTOR = "features"


# --- contracts ------------------------------------------------------------------------


@runtime_checkable
class DataSource(Protocol):
    """A named source of windows."""

    name: str
    width: int

    def windows(self, spine: DataFrame) -> DataFrame:
        """``(keys, matrix)`` on the dates of a spine, ``width`` features in a step."""


@runtime_checkable
class Aggregator(Protocol):
    """Puts the windows of several sources together."""

    def combine(self, sources: list[DataFrame]) -> DataFrame: ...


@runtime_checkable
class Evaluator(Protocol):
    """Judges predictions ``(truth, predicted, score or scores)``."""

    def evaluate(self, predictions: DataFrame) -> DataFrame:
        """Rows ``(metric, value)``."""


class SideBySide:
    """The usual aggregator: features of all sources in one step."""

    def combine(self, sources: list[DataFrame]) -> DataFrame:
        return samples.combine_sources(sources)


# --- stages ---------------------------------------------------------------------------


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Keyword parameters, and a state that is saved as text."""

    def _param(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def _optional(self, name: str):
        param = getattr(self, name)
        return self.getOrDefault(param) if self.isDefined(param) else None


class WindowImputer(Transformer, _Stage):
    """Fills the gaps of each window from its own columns."""

    width = Param(Params._dummy(), "width", "features in a step", TypeConverters.toInt)
    strategy = Param(Params._dummy(), "strategy", "mean, median, most_frequent or constant", TypeConverters.toString)
    constant = Param(Params._dummy(), "constant", "value of the constant strategy", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, width=None, strategy=None, constant=None):
        super().__init__()
        self._setDefault(strategy="mean", constant=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return samples.impute_windows(dataset, self._param("width"), self._param("strategy"), self._param("constant"))


class Oversampler(Estimator, _Stage):
    """Balances the classes by weights of the samples it is fitted on."""

    ratio = Param(Params._dummy(), "ratio", "auto, or a share of the largest class", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, ratio=None, seed=None):
        super().__init__()
        self._setDefault(ratio="auto", seed=0)
        self._set(**{k: str(v) if k == "ratio" and v is not None else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> OversamplerModel:
        ratio = self._param("ratio")
        counts = balance.repeat_counts(dataset, ratio if ratio == "auto" else float(ratio), self._param("seed"))
        model = OversamplerModel()
        model.counts = checkpointed(counts)
        return model


class OversamplerModel(Model, _Stage):
    """Adds ``weight``: that of a sample of the fit, 1 for any other. A loaded model knows no samples."""

    counts: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.counts is None:
            return dataset.withColumn(balance.WEIGHT, F.lit(1).cast("long"))
        return balance.weigh_samples(dataset, self.counts)


class CellScaler(Estimator, _Stage):
    """Standardises every (step, feature) cell, or every feature over all steps."""

    width = Param(Params._dummy(), "width", "features in a step", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "steps of a window, for one scale per feature", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, width=None, steps=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CellScalerModel:
        weight = balance.WEIGHT if balance.WEIGHT in dataset.columns else None
        width, steps = self._param("width"), self._optional("steps")
        if steps is None:
            fitted = balance.fit_cell_scaler(dataset, width, weight)
        else:
            fitted = balance.fit_feature_scaler(dataset, width, steps, weight)
        # bounded by the shape of a window
        stats = [[[c.mu, c.sd] for c in step] for step in fitted.first().stats or []]
        return CellScalerModel(stats=json.dumps(stats))


class CellScalerModel(Model, _Stage):
    stats = Param(Params._dummy(), "stats", "mean and spread of each cell as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, stats=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cells = F.from_json(F.lit(self._param("stats")), "array<array<array<double>>>")
        return dataset.withColumn(MATRIX, F.zip_with(
            F.col(MATRIX), cells, lambda row, fitted: F.zip_with(row, fitted, lambda v, c: (v - c[0]) / c[1])
        ))


class WindowVector(Transformer, _Stage):
    """Passes the window through, flattened to the vector a model takes."""

    outputCol = Param(Params._dummy(), "outputCol", "name of the vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, outputCol=None):
        super().__init__()
        self._setDefault(outputCol=VECTOR)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._param("outputCol"), array_to_vector(F.flatten(MATRIX).cast("array<double>")))


class WindowFeatures(Transformer, _Stage):
    """Statistics of every feature's series as the vector; with ``keep``, the named ones in that order.

    ``fills`` has the median, largest and smallest value of each feature in the fit, for what is missing or infinite.
    """

    features = Param(Params._dummy(), "features", "names of the features in a step", TypeConverters.toListString)
    groups = Param(Params._dummy(), "groups", "groups of statistics", TypeConverters.toListString)
    keep = Param(Params._dummy(), "keep", "names of the kept statistics", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "fill values of each kept statistic as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, features=None, groups=None, keep=None, fills=None, outputCol=None):
        super().__init__()
        self._setDefault(groups=list(tsfeatures.GROUPS), outputCol=VECTOR, fills="{}")
        self._set(**self._input_kwargs)

    def names(self) -> list[str]:
        stats = tsfeatures.stat_names(self._param("groups"))
        return self._optional("keep") or [f"{f}__{s}" for f in self._param("features") for s in stats]

    def table(self, dataset: DataFrame) -> DataFrame:
        """The long feature table ``(keys, name, value)``."""
        groups = self._param("groups")
        wide = tsfeatures.extract_features(dataset, self._param("features"), groups)
        return tsfeatures.long_feature_table(wide, tsfeatures.stat_names(groups))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, fills = self.names(), json.loads(self._param("fills"))
        wide = tsfeatures.wide_feature_table(self.table(dataset), names)

        def cell(name: str):
            value, (middle, most, least) = F.col(f"`{name}`"), fills.get(name, (0.0, 0.0, 0.0))
            return (
                F.when(value.isNull() | F.isnan(value), F.lit(float(middle)))
                .when(value == float("inf"), F.lit(float(most)))
                .when(value == float("-inf"), F.lit(float(least)))
                .otherwise(value)
            )

        vectors = wide.select(*KEYS, array_to_vector(F.array(*[cell(n) for n in names])).alias(self._param("outputCol")))
        return dataset.join(vectors, KEYS)


class RelevantFeatures(Estimator, _Stage):
    """Learns which statistics bear on the label; the model extracts these alone."""

    features = Param(Params._dummy(), "features", "names of the features in a step", TypeConverters.toListString)
    groups = Param(Params._dummy(), "groups", "groups of statistics", TypeConverters.toListString)
    numeric = Param(Params._dummy(), "numeric", "the label is a number, not a class", TypeConverters.toBoolean)
    fdr = Param(Params._dummy(), "fdr", "false discovery rate", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, features=None, groups=None, numeric=None, fdr=None):
        super().__init__()
        self._setDefault(groups=list(tsfeatures.GROUPS), numeric=False, fdr=0.05)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WindowFeatures:
        extractor = WindowFeatures(features=self._param("features"), groups=self._param("groups"))
        # fitted on every sample once, whatever its weight
        labelled = extractor.table(dataset).join(dataset.select(*KEYS, LABEL), KEYS)
        table = checkpointed(labelled.select(tsfeatures.NAME, tsfeatures.VALUE, LABEL))
        finite = table.where(F.abs(tsfeatures.VALUE) < float("inf"))
        medians = grouped_quantile(finite.where(~F.isnan(tsfeatures.VALUE)), [tsfeatures.NAME], tsfeatures.VALUE, 0.5, "middle")
        ends = finite.groupBy(tsfeatures.NAME).agg(F.max(tsfeatures.VALUE).alias("most"), F.min(tsfeatures.VALUE).alias("least"))
        fills = {r.name: (r.middle, r.most, r.least) for r in medians.join(ends, tsfeatures.NAME).collect()}  # one row per statistic
        tests = relevance.relevance(finite, numeric=self._param("numeric"), fdr=self._param("fdr"))
        kept = {r[0] for r in relevance.relevant_for(tests).select(tsfeatures.NAME).collect()}
        names = [n for n in extractor.names() if n in kept]
        if not names:
            raise ValueError("no feature bears on the label at this false discovery rate")
        return extractor.copy({
            extractor.keep: names, extractor.fills: json.dumps({n: fills[n] for n in names}),
        })
