"""Learning job: align, split, prepare, fit, evaluate, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.operators.balance import prepare_test, prepare_train
from onsetframe.operators.demographics import demographics_matrix
from onsetframe.operators.evaluate import confusion_counts, confusion_matrix, evaluate, report, with_class
from onsetframe.operators.labels import LABEL
from onsetframe.operators.learn import binary_score, fit_forest, score_forest, scored_by, training_vectors
from onsetframe.operators.parts import Evaluator
from onsetframe.operators.samples import (
    SPLIT,
    TEST,
    TRAIN,
    align_to_keys,
    combine_sources,
    extend_timesteps,
    impute_windows,
    labels_for,
    sample_keys,
    split_by_patient,
)
from onsetframe.plans.extraction import digest
from onsetframe.schemas import KEYS
from onsetframe.session import checkpointed, join_path
from onsetframe.sources.stages import StageStore, write_metrics


@dataclass
class Source:
    """One windowed source: name, windows, number of features."""

    name: str
    windows: DataFrame
    width: int


@dataclass
class Learned:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame


def assemble(
    labels: DataFrame,
    sources: list[Source],
    steps: int,
    demographics: DataFrame | None = None,
    test_size: float | int = 0.2,
    seed: int = 0,
) -> tuple[DataFrame, int]:
    """One row per labelled key: ``split``, ``label``, combined ``matrix``; and its width.

    Each window is imputed from itself, so this can happen before the split. Demographics
    are repeated along time.
    """
    keys = sample_keys(labels)
    parts = [
        impute_windows(align_to_keys(keys, s.windows, steps, s.width), s.width) for s in sources
    ]
    width = sum(s.width for s in sources)
    if demographics is not None:
        static = align_to_keys(keys, demographics_matrix(demographics), 1, 2)
        parts.append(extend_timesteps(static, steps))
        width += 2
    combined = combine_sources(parts, aligned=True)
    spine = split_by_patient(labels_for(keys, labels), test_size, seed)
    return spine.join(combined, KEYS), width


def learn(
    samples: DataFrame,
    width: int,
    imputer: str | None = "mean",
    resampler: float | str | None = "auto",
    scale: bool = True,
    trees: int = 100,
    max_depth: int = 10,
    seed: int = 0,
    threshold: float = 0.5,
    pipeline: Pipeline | None = None,
    evaluator: Evaluator | None = None,
) -> Learned:
    """Fit a forest on the training side and judge it on the test side.

    A ``pipeline`` of ``pyspark.ml`` stages (see :mod:`onsetframe.operators.parts`) takes the place of imputer, resampler,
    scaler and forest; an ``evaluator`` that of the metrics.

    Pass samples read from a written table (see :func:`learn_job`): they are used for the
    scaler, the fit and the test. Prepared vectors and predictions are kept, as the fit and
    the metrics read them many times. With two classes the threshold decides, with more the
    largest score; all metrics come from that one class.
    """
    train = samples.where(F.col(SPLIT) == TRAIN)
    test = samples.where(F.col(SPLIT) == TEST)
    if pipeline is not None:
        model = pipeline.fit(train)
        scored = scored_by(model, test)
    else:
        prepared, scaler = prepare_train(train, width, imputer, resampler, scale, seed, copies=False)
        model = fit_forest(checkpointed(training_vectors(prepared)), trees, seed, max_depth)
        scored = score_forest(model, prepare_test(test, width, imputer, scaler))
    if model.stages[-1].numClasses <= 2:
        scored = binary_score(scored)
    scored = checkpointed(with_class(scored, threshold))
    confusion = confusion_counts(scored)
    metrics = evaluate(scored, threshold) if evaluator is None else evaluator.evaluate(scored)
    return Learned(model, scored, metrics, report(confusion), confusion_matrix(confusion))


def learn_job(
    store: StageStore,
    key: str,
    labels: DataFrame,
    sources: list[Source],
    steps: int,
    demographics: DataFrame | None = None,
    output: str | None = None,
    test_size: float | int = 0.2,
    seed: int = 0,
    inputs: list[str] | None = None,
    **settings,
) -> Learned:
    """Sources to metrics. Samples are written to the shared folder first, so the lineage of
    the iterative fit starts at a table; model and metrics go to ``output``.

    ``key`` names the settings that labels and windows come from, ``inputs`` the files they are read from: if one
    of these is replaced, the samples are made anew."""
    width = sum(s.width for s in sources) + (2 if demographics is not None else 0)
    samples = store.materialize(
        "samples", digest(
            key=key, seed=seed, test_size=test_size, sources=[(s.name, s.width) for s in sources], steps=steps,
            demographics=demographics is not None,
        ),
        lambda: assemble(labels.select(*KEYS, LABEL), sources, steps, demographics, test_size, seed)[0],
        inputs=inputs,
    )
    learned = learn(samples, width, seed=seed, **settings)
    if output is not None:
        learned.model.write().overwrite().save(join_path(output, "model"))
        learned.predictions.write.mode("overwrite").parquet(join_path(output, "predictions"))
        write_metrics(learned.metrics, join_path(output, "metrics"))
        write_metrics(learned.report, join_path(output, "report"))
        write_metrics(learned.confusion, join_path(output, "confusion"))
    return learned
