"""Classification metrics from confusion counts and score counts.

Predictions are reduced to one row per (truth, class) or (score, truth) before
anything else; all formulas work on these few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetframe.functions.ranking import with_rows_below

TRUTH, PREDICTED, SCORE, SCORES = "truth", "predicted", "score", "scores"
EPS = 2.220446049250313e-16


def present(score: Column) -> Column:
    """The score as a double; a missing one (NULL or NaN) is an error, not a low score."""
    value = score.cast("double")
    missing = F.raise_error(F.lit("a prediction has no score")).cast("double")
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(value)


def threshold_class(score: Column, threshold: float = 0.5) -> Column:
    """1 if the score is strictly above the threshold, else 0."""
    return F.when(present(score) > threshold, 1).otherwise(0)


def argmax_class(scores: Column) -> Column:
    """Position of the largest score, the first of equal ones."""
    checked = F.transform(scores, present)
    return (F.array_position(checked, F.array_max(checked)) - 1).cast("int")


def with_class(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``predicted`` from a ``score`` (two classes) or from ``scores`` (one per class)."""
    if SCORES in predictions.columns:
        return predictions.withColumn(PREDICTED, argmax_class(F.col(SCORES)))
    return predictions.withColumn(PREDICTED, threshold_class(F.col(SCORE), threshold))


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """Rows per (truth, predicted) that occur."""
    return predictions.groupBy(
        F.col(TRUTH).cast("int").alias(TRUTH), F.col(PREDICTED).cast("int").alias(PREDICTED)
    ).agg(F.count(F.lit(1)).alias("n"))


def class_counts(confusion: DataFrame) -> DataFrame:
    """Per class: ``tp``, ``support`` (true rows), ``chosen`` (predicted rows)."""
    sides = F.array(
        F.struct(F.col(TRUTH).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")),
        F.struct(F.col(PREDICTED).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")),
    )
    hit = F.when(F.col(TRUTH) == F.col(PREDICTED), F.col("n")).otherwise(0)
    rows = confusion.select(hit.alias("hit"), F.explode(sides).alias("s"))
    return rows.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("tp"),
        F.sum("s.support").alias("support"),
        F.sum("s.chosen").alias("chosen"),
    )


def _safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def class_scores(confusion: DataFrame) -> DataFrame:
    """Per class precision, recall and F1; 0 where undefined."""
    p, r = _safe(F.col("tp"), F.col("chosen")), _safe(F.col("tp"), F.col("support"))
    return (
        class_counts(confusion)
        .withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn(
            "f1",
            _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def summary(confusion: DataFrame) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, Matthews correlation, kappa."""
    def weighted(c: str) -> Column:
        return F.sum(F.col("support") * F.col(c)) / F.sum("support")

    d = {k: F.col(k).cast("double") for k in ("tp", "support", "chosen")}
    base = class_scores(confusion).agg(
        F.sum("support").cast("double").alias("n"),
        F.sum("tp").cast("double").alias("hits"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1_score"),
        F.sum(d["support"] * d["chosen"]).alias("cross"),
        F.sum(d["support"] * d["support"]).alias("tt"),
        F.sum(d["chosen"] * d["chosen"]).alias("pp"),
    )
    n, hits, cross = F.col("n"), F.col("hits"), F.col("cross")
    spread = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    expected = cross / (n * n)
    return base.select(
        (hits / n).alias("accuracy"),
        "f1_score",
        "precision",
        "recall",
        _safe(hits * n - cross, spread).alias("mcc"),
        ((hits / n - expected) / F.when(expected != 1, 1 - expected)).alias("kappa"),
    )


def log_loss(predictions: DataFrame) -> DataFrame:
    """One row: mean negative log of the probability given to the true class, clipped."""
    if SCORES in predictions.columns:
        of_truth = F.get(F.col(SCORES), F.col(TRUTH).cast("int"))
    else:
        of_truth = F.when(F.col(TRUTH) == 1, F.col(SCORE)).otherwise(1 - F.col(SCORE))
    clipped = F.least(F.greatest(present(of_truth), F.lit(EPS)), F.lit(1 - EPS))
    return predictions.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def report(confusion: DataFrame) -> DataFrame:
    """Per class rows, then macro and weighted averages and accuracy."""
    per_class = class_scores(confusion)
    rows = per_class.select(
        F.col("class").cast("string").alias("class"), "precision", "recall", F.col("f1").alias("f1_score"), "support"
    )
    averages = per_class.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col("support") * F.col(c)) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support")).alias("acc"),
    )

    def line(name: str, *values: str) -> Column:
        names = ("precision", "recall", "f1_score")
        return F.struct(
            F.lit(name).alias("class"), *[F.col(v).alias(n) for v, n in zip(values, names)], F.col("support")
        )

    lines = F.array(
        line("accuracy", "acc", "acc", "acc"),
        line("macro avg", "m_precision", "m_recall", "m_f1"),
        line("weighted avg", "w_precision", "w_recall", "w_f1"),
    )
    return rows.unionByName(averages.select(F.inline(lines)))


def confusion_matrix(confusion: DataFrame) -> DataFrame:
    """Every (truth, predicted) pair of classes: ``n`` and ``share`` of the true class."""
    classes = class_counts(confusion).agg(F.sort_array(F.collect_list("class"))).scalar()
    per_truth = confusion.groupBy(F.col(TRUTH)).agg(
        F.map_from_entries(F.collect_list(F.struct(PREDICTED, "n"))).alias("_cells"), F.sum("n").alias("_total")
    )
    # classes that are only predicted have an empty row
    only_predicted = class_counts(confusion).where(F.col("support") == 0).select(
        F.col("class").alias(TRUTH),
        F.lit(None).cast("map<int,bigint>").alias("_cells"),
        F.lit(0).cast("long").alias("_total"),
    )
    rows = per_truth.unionByName(only_predicted).withColumn("_classes", classes)
    return rows.select(TRUTH, F.explode("_classes").alias(PREDICTED), "_cells", "_total").select(
        TRUTH,
        PREDICTED,
        F.coalesce(F.try_element_at("_cells", F.col(PREDICTED)), F.lit(0)).alias("n"),
        _safe(F.coalesce(F.try_element_at("_cells", F.col(PREDICTED)), F.lit(0)), F.col("_total")).alias("share"),
    )


def auc_of_classes(confusion: DataFrame) -> DataFrame:
    """One row: area under the curve of predicted classes, NULL unless the truth has two classes."""
    counts = class_counts(confusion).where(F.col("support") > 0)
    return counts.agg(
        F.when(F.count(F.lit(1)) == 2, F.avg(F.col("tp") / F.col("support"))).alias("roc_auc")
    )


def auc_of_scores(predictions: DataFrame) -> DataFrame:
    """One row: area under the curve of scores by midranks, NULL unless the truth has two classes."""
    counts = predictions.groupBy(present(F.col(SCORE)).alias(SCORE)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(TRUTH) == 1, 1).otherwise(0)).alias("positives"),
    )
    ranked = with_rows_below(counts, [], SCORE)
    midrank = F.col("rows_below") + (F.col("n") + 1) / 2
    sums = ranked.agg(
        F.sum("positives").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("n0"),
        F.sum(F.col("positives") * midrank).alias("ranks"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    auc = (F.col("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)
    return sums.select(F.when((n1 > 0) & (n0 > 0), auc).alias("roc_auc"))


def evaluate(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All scalar metrics as ``(metric, value)`` rows."""
    classed = with_class(predictions, threshold)
    confusion = confusion_counts(classed)
    parts = [summary(confusion), log_loss(classed), auc_of_classes(confusion)]
    if SCORES not in predictions.columns:
        parts.append(auc_of_scores(classed).withColumnRenamed("roc_auc", "roc_auc_scores"))
    rows = [
        part.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in part.columns
        ])).alias("_m")).select("_m.metric", "_m.value")
        for part in parts
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out
