"""Which features bear on a label: a test for every kind of feature and label.

Input is the long feature table ``(name, value, label)``, one row per sample and feature. Rows without a value or label
are left out. A feature with two values is binary, with more it is real, with one it is constant and not tested.

| label | real feature | binary feature |
|---|---|---|
| two classes | rank-sum test | Fisher's exact test |
| several classes | the same, each class against the rest | the same |
| a number | Kendall's rank correlation | Kolmogorov-Smirnov, the label split by the feature |

All tests start from counts per distinct value, and ranks, running sums and inversions come from bounded buckets of values, so
a feature's samples never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from onsetframe.functions.ranking import running_totals
from onsetframe.functions.tails import fisher_exact, kolmogorov, two_sided_normal
from onsetframe.operators.tsfeatures import NAME, VALUE, false_discovery
from onsetframe.session import checkpointed

LABEL, CLASS, KIND = "label", "class", "kind"
CONSTANT, BINARY, REAL = "constant", "binary", "real"
BLOCK_ROWS = 1 << 16  # rows of one block of neighbouring feature values whose inversions one task counts
COLUMNS = [NAME, CLASS, KIND, "statistic", "p_value"]


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def usable(table: DataFrame, label: str = LABEL) -> DataFrame:
    ready = F.col(VALUE).isNotNull() & ~F.isnan(VALUE) & F.col(label).isNotNull()
    return table.where(ready).select(NAME, F.col(VALUE).cast("double").alias(VALUE), F.col(label).alias(LABEL))


def feature_kinds(counts: DataFrame) -> DataFrame:
    """``name, kind, top``: the larger value marks one side of a binary feature. Takes counts per value."""
    values = counts.groupBy(NAME).agg(F.min(VALUE).alias("_low"), F.max(VALUE).alias("top"), F.countDistinct(VALUE).alias("_n"))
    kind = F.when(F.col("_n") == 1, CONSTANT).when(F.col("_n") == 2, BINARY).otherwise(REAL)
    return values.select(NAME, kind.alias(KIND), "top")


# --- classes --------------------------------------------------------------------------


def rank_sums(counts: DataFrame) -> DataFrame:
    """Rank-sum test of each class against the rest, with tie and continuity correction.

    ``counts``: ``name, value, class, n``. Values are ranked once, whatever the number of classes. Output
    ``name, class, n1, n0, u, z``.
    """
    values = counts.groupBy(NAME, VALUE).agg(F.sum("n").alias("n"))
    ranked = running_totals(values, [NAME], VALUE, ["n"]).withColumn("_rank", F.col("n_below") + (F.col("n") + 1) / 2)
    n = F.col("n").cast("double")
    whole = ranked.groupBy(NAME).agg(F.sum("n").alias("_all"), F.sum(n * n * n - n).alias("_ties"))
    sums = (
        counts.join(ranked.select(NAME, VALUE, "_rank"), [NAME, VALUE])
        .groupBy(NAME, CLASS)
        .agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("_rank")).alias("_ranks"))
        .join(whole, NAME)
        .withColumn("n0", F.col("_all") - F.col("n1"))
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = n1 + n0
    variance = n1 * n0 / 12 * (total + 1 - F.col("_ties") / (total * (total - 1)))
    away = F.col("u") - n1 * n0 / 2
    off = F.greatest(F.abs(away) - 0.5, F.lit(0.0))
    return (
        sums.withColumn("u", F.col("_ranks") - n1 * (n1 + 1) / 2)
        .withColumn("z", F.when(variance > 0, F.signum(away) * off / F.sqrt(variance)))
        .select(NAME, CLASS, "n1", "n0", "u", "z")
    )


@pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, row)) for row in zip(a, b, c, d)], dtype=float)


def fisher_tests(counts: DataFrame, tops: DataFrame) -> DataFrame:
    """``name, class, odds, p_value`` of binary features: one row per class, its samples at the larger value against the rest."""
    marked = counts.join(tops, NAME).withColumn("_at", F.when(F.col(VALUE) == F.col("top"), F.col("n")).otherwise(0))
    whole = marked.groupBy(NAME).agg(F.sum("n").alias("_all"), F.sum("_at").alias("_all_at"))
    cells = marked.groupBy(NAME, CLASS).agg(F.sum("_at").alias("a"), (F.sum("n") - F.sum("_at")).alias("b")).join(whole, NAME)
    cells = cells.withColumn("c", F.col("_all_at") - F.col("a")).withColumn("d", F.col("_all") - F.col("_all_at") - F.col("b"))
    against, along = F.col("b").cast("double") * F.col("c"), F.col("a").cast("double") * F.col("d")
    odds = F.when(against > 0, along / against)
    return cells.select(NAME, CLASS, odds.alias("odds"), _fisher("a", "b", "c", "d").alias("p_value"))


def class_relevance(table: DataFrame, label: str = LABEL) -> DataFrame:
    """``name, class, kind, statistic, p_value`` against a label of classes.

    With two classes the larger one is tested; with more, each against the rest. The statistic is z or the odds ratio.
    """
    rows = usable(table, label).withColumnRenamed(LABEL, CLASS)
    counts = checkpointed(rows.groupBy(NAME, VALUE, CLASS).agg(F.count(F.lit(1)).alias("n")))
    kinds = checkpointed(feature_kinds(counts))
    classes = counts.agg(F.countDistinct(CLASS).alias("n"), F.max(CLASS).alias("last")).first()
    if classes["n"] == 2:
        tested = F.col(CLASS) == F.lit(classes["last"])
    else:
        tested = F.lit(classes["n"] > 2)

    def of(kind: str) -> DataFrame:
        return kinds.where(F.col(KIND) == kind)

    real = rank_sums(counts.join(of(REAL).select(NAME), NAME)).select(
        NAME, CLASS, F.lit(REAL).alias(KIND), F.col("z").alias("statistic"), two_sided_normal(F.col("z")).alias("p_value")
    )
    binary = fisher_tests(counts, of(BINARY).select(NAME, "top")).select(
        NAME, CLASS, F.lit(BINARY).alias(KIND), F.col("odds").alias("statistic"), "p_value"
    )
    return real.unionByName(binary).where(tested).select(*COLUMNS)


# --- numbers --------------------------------------------------------------------------


def kolmogorov_smirnov(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """``name, distance, p_value``: the label's distribution on both sides of a binary feature.

    The largest distance comes from running sums over the distinct label values; the p-value is the limit for many samples.
    """
    at = F.col(VALUE) == F.col("top")
    sides = rows.join(tops, NAME).groupBy(NAME, F.col(LABEL).cast("double").alias(LABEL)).agg(
        F.sum(F.when(at, 1).otherwise(0)).alias("n1"), F.sum(F.when(at, 0).otherwise(1)).alias("n0")
    )
    ran = running_totals(sides, [NAME], LABEL, ["n1", "n0"])
    share = [(F.col(f"{n}_below") + F.col(n)) / F.col(f"{n}_total") for n in ("n1", "n0")]
    found = ran.groupBy(NAME).agg(
        F.max(F.abs(share[0] - share[1])).alias("distance"), F.max("n1_total").alias("_n1"), F.max("n0_total").alias("_n0")
    )
    size = F.sqrt(F.col("_n1").cast("double") * F.col("_n0") / (F.col("_n1") + F.col("_n0")))
    return found.select(NAME, "distance", kolmogorov(size * F.col("distance")).alias("p_value"))


def _tie_sums(counts: DataFrame, prefix: str) -> DataFrame:
    """Sums over groups of equal values that the variance of Kendall's statistic needs."""
    t = _whole(F.col("n"))
    d = F.col("n").cast("double")
    return counts.groupBy(NAME).agg(
        F.sum(t * (t - 1) / 2).cast("double").alias(f"{prefix}_pairs"),
        F.sum(d * (d - 1) * (d - 2)).alias(f"{prefix}_0"),
        F.sum(d * (d - 1) * (2 * d + 5)).alias(f"{prefix}_1"),
    )


def inversions_inside(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Weight of the pairs with ``x`` rising and ``y`` falling, by merging ranges of ranks bit by bit."""
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    found, bits = 0, int(x.max(initial=0)).bit_length()
    for bit in range(bits):
        parent, right = x >> (bit + 1), (x >> bit) & 1
        order = np.lexsort((right, y, parent))
        parent, right, weight = parent[order], right[order], n[order]
        upto = np.cumsum(np.where(right == 0, weight, 0))
        last = np.r_[np.flatnonzero(np.diff(parent)), len(parent) - 1]
        of = np.searchsorted(last, np.arange(len(parent)))
        # lefts of equal y precede, so what comes later in the range has a larger y
        found += int((np.where(right == 1, weight, 0) * (upto[last[of]] - upto)).sum())
    return found


def _blocks(xs: DataFrame, levels: int) -> DataFrame:
    """Feature values in order cut into even blocks; a value with a block's share of the rows has one of its own (odd)."""
    parts = 1 << levels
    place = F.floor(F.col("n_below") * F.lit(parts).cast("double") / F.col("n_total")).cast("long")
    alone = F.col("n") * F.lit(parts) >= F.col("n_total")
    return xs.withColumn("_block", 2 * place + F.when(alone, 1).otherwise(0)).select(NAME, VALUE, "_block")


def discordant(pairs: DataFrame, xs: DataFrame) -> DataFrame:
    """``name, dis``: pairs of samples whose feature rises while the label falls.

    ``pairs``: ``name, value, label, n``; ``xs``: running totals over the feature's values. Inside a block of neighbouring feature
    values they are counted directly. Between blocks, ranges of blocks are merged level by level: for both halves of a
    range, the left rows with a larger label than a right row come from running sums over the label.
    """
    most = xs.agg(F.max("n_total")).first()[0] or 0
    levels = max(int(most // BLOCK_ROWS).bit_length(), 0)
    placed = checkpointed(pairs.join(_blocks(xs, levels), [NAME, VALUE]))

    def count(block: pa.Table) -> pa.Table:
        found = inversions_inside(*(block.column(c).to_numpy() for c in (VALUE, LABEL, "n")))
        return pa.table([block.column(NAME).slice(0, 1), pa.array([found], pa.int64())], [NAME, "dis"])

    light = placed.where(F.col("_block") % 2 == 0)
    inside = light.groupBy(NAME, "_block").applyInArrow(count, f"{NAME} string, dis long")
    each = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    sided = placed.withColumn("_level", each).select(
        NAME, "_level", LABEL, "n", F.expr("shiftright(_block, _level + 1)").alias("_range"), F.expr("shiftright(_block, _level) & 1").alias("_right")
    )
    merged = sided.groupBy(NAME, "_level", "_range", LABEL).agg(
        F.sum(F.when(F.col("_right") == 0, F.col("n")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("_right") == 1, F.col("n")).otherwise(0)).alias("right"),
    )
    ran = running_totals(merged, [NAME, "_level", "_range"], LABEL, ["left"])
    larger = F.col("left_total") - F.col("left_below") - F.col("left")
    between = ran.groupBy(NAME).agg(F.sum(_whole(F.col("right")) * _whole(larger)).alias("dis"))
    both = inside.select(NAME, _whole(F.col("dis")).alias("dis")).unionByName(between.select(NAME, _whole(F.col("dis")).alias("dis")))
    return both.groupBy(NAME).agg(F.sum("dis").cast("double").alias("dis"))


def kendall(rows: DataFrame) -> DataFrame:
    """``name, n, tau, z``: Kendall's tau-b of feature and label, and its normal statistic with ties.

    ``rows``: ``name, value, label``.
    """
    number = F.col(LABEL).cast("double").alias(LABEL)
    pairs = checkpointed(rows.groupBy(NAME, VALUE, number).agg(F.count(F.lit(1)).alias("n")))
    by_value = pairs.groupBy(NAME, VALUE).agg(F.sum("n").alias("n"))
    by_label = pairs.groupBy(NAME, LABEL).agg(F.sum("n").alias("n"))
    xs = checkpointed(running_totals(by_value, [NAME], VALUE, ["n"]))
    joint = pairs.groupBy(NAME).agg(
        F.sum(_whole(F.col("n")) * (_whole(F.col("n")) - 1) / 2).cast("double").alias("_joint"), F.sum("n").alias("n")
    )
    facts = joint.join(_tie_sums(xs, "x"), NAME).join(_tie_sums(by_label, "y"), NAME).join(discordant(pairs, xs), NAME, "left")
    n, dis = F.col("n").cast("double"), F.coalesce("dis", F.lit(0.0))
    every = n * (n - 1) / 2
    score = every - F.col("x_pairs") - F.col("y_pairs") + F.col("_joint") - 2 * dis
    m = n * (n - 1)
    variance = (
        (m * (2 * n + 5) - F.col("x_1") - F.col("y_1")) / 18
        + 2 * F.col("x_pairs") * F.col("y_pairs") / m
        + F.when(n > 2, F.col("x_0") * F.col("y_0") / (9 * m * (n - 2))).otherwise(0.0)
    )
    spread = F.sqrt(every - F.col("x_pairs")) * F.sqrt(every - F.col("y_pairs"))
    return facts.select(
        NAME, "n", F.when(spread > 0, score / spread).alias("tau"), F.when(variance > 0, score / F.sqrt(variance)).alias("z")
    )


def number_relevance(table: DataFrame, label: str = LABEL) -> DataFrame:
    """``name, class (NULL), kind, statistic, p_value`` against a numeric label; the statistic is tau or the distance."""
    rows = checkpointed(usable(table, label))
    kinds = checkpointed(feature_kinds(rows.select(NAME, VALUE).distinct()))

    def of(kind: str) -> DataFrame:
        return kinds.where(F.col(KIND) == kind)

    real = kendall(rows.join(of(REAL).select(NAME), NAME)).select(
        NAME, F.lit(REAL).alias(KIND), F.col("tau").alias("statistic"), two_sided_normal(F.col("z")).alias("p_value")
    )
    binary = kolmogorov_smirnov(rows, of(BINARY).select(NAME, "top")).select(
        NAME, F.lit(BINARY).alias(KIND), F.col("distance").alias("statistic"), "p_value"
    )
    return real.unionByName(binary).withColumn(CLASS, F.lit(None).cast("string")).select(*COLUMNS)


# --- selection ------------------------------------------------------------------------


def relevance(table: DataFrame, label: str = LABEL, numeric: bool = False, fdr: float = 0.05, independent: bool = False) -> DataFrame:
    """The tests with ``relevant``: kept at a false discovery rate, for each class on its own."""
    tests = number_relevance(table, label) if numeric else class_relevance(table, label)
    return false_discovery(tests, fdr, independent, [CLASS])


def relevant_for(tests: DataFrame, classes: int = 1) -> DataFrame:
    """``name, n_significant`` of the features that are relevant for at least ``classes`` classes."""
    counted = tests.groupBy(NAME).agg(F.sum(F.col("relevant").cast("int")).alias("n_significant"))
    return counted.where(F.col("n_significant") >= classes)
