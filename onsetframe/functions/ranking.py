"""Exact ranks and quantiles that never sort one group in one task.

Values are reduced to one weighted row per ``(group, value)`` and spread over buckets by a monotone function of
the value. A refining histogram counts the buckets and splits those that hold too many values, by even steps between
their own least and largest value, until none does; values are ordered inside a bucket only, and shifted by the totals
of the lower buckets, which are known from the histograms. However close the values lie, a split takes ten bits of
the double, so at most six rounds are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.session import checkpointed

STEPS_PER_OCTAVE = 1024
_LOWEST_EXPONENT = 1075
# a bucket holds up to LEAF_ROWS values, or a LEAVES-th of all values where that is more
LEAF_ROWS, LEAVES, SPLIT = 1000, 10_000, 1024
HASH_PREFIX = 4  # hex digits: at most 65,536 buckets


def value_bucket(value: Column) -> Column:
    """Non-decreasing integer function of a finite double."""
    size = F.floor((F.log2(F.abs(value)) + _LOWEST_EXPONENT) * STEPS_PER_OCTAVE)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def _histogram(rows: DataFrame, group: list[str], value: str, weights: list[str], more: list[Column] = ()) -> DataFrame:
    return rows.groupBy(*group, "_path").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(F.col(value).cast("double")).alias("_least"),
        F.max(F.col(value).cast("double")).alias("_largest"),
        *[F.sum(w).alias(f"_sum_{w}") for w in weights],
        *more,
    )


def _lower_sums(counted: DataFrame, within: list, weights: list[str], base: bool) -> DataFrame:
    """The weight of the lower buckets, starting from the one below the bucket that was split."""
    lower = Window.partitionBy(*within).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    sums = {}
    for w in weights:
        before = F.coalesce(F.sum(f"_sum_{w}").over(lower), F.lit(0))
        sums[f"_offset_{w}"] = F.col(f"_base_{w}") + before if base else before
    return counted.withColumns(sums)


def running_totals(
    counts: DataFrame, group: list[str], value: str, weights: list[str], refine: bool = True, written: bool = False
) -> DataFrame:
    """Add ``<weight>_below`` (the weight of smaller values in the group) and ``<weight>_total`` for each weight.

    ``counts`` holds one row per ``(group, value)``; groups and values are not NULL. It is written once (unless it is a
    ``written`` table), as it is read for every histogram. Without ``refine``, for groups known to be small, nothing is
    written or split.
    """
    rows = checkpointed(counts) if refine and not written else counts
    rows = rows.withColumn("_path", F.array(value_bucket(F.col(value).cast("double"))))
    counted = _lower_sums(_histogram(rows, group, value, weights), group, weights, base=False)
    whole = Window.partitionBy(*group)
    counted = counted.withColumns({f"{w}_total": F.sum(f"_sum_{w}").over(whole) for w in weights})
    kept = [*group, "_path", *[c for w in weights for c in (f"_offset_{w}", f"{w}_total")]]
    if refine:
        counted = checkpointed(counted)
        most = max((counted.agg(F.sum("_rows")).first()[0] or 0) // LEAVES, LEAF_ROWS)
        crowded = (F.col("_rows") > most) & (F.col("_largest") > F.col("_least"))
        leaves = counted.where(~crowded).select(*kept)
        while not (full := counted.where(crowded)).isEmpty():
            marks = full.select(*group, "_path", "_least", "_largest", *[
                F.col(c).alias(n) for w in weights for c, n in ((f"_offset_{w}", f"_base_{w}"), (f"{w}_total", f"_whole_{w}"))
            ])
            carried = [c for w in weights for c in (f"_base_{w}", f"_whole_{w}")]
            step = F.floor((F.col(value).cast("double") - F.col("_least")) / (F.col("_largest") - F.col("_least")) * SPLIT)
            # only the rows of crowded buckets are counted again
            inner = rows.join(marks, [*group, "_path"]).withColumn("_parent", F.col("_path"))
            inner = inner.withColumn("_path", F.concat("_path", F.array(step)))
            more = [F.first("_parent").alias("_parent"), *[F.first(c).alias(c) for c in carried]]
            counted = _lower_sums(_histogram(inner, group, value, weights, more), [*group, "_parent"], weights, base=True)
            counted = checkpointed(counted.withColumns({f"{w}_total": F.col(f"_whole_{w}") for w in weights}))
            leaves = leaves.unionByName(counted.where(~crowded).select(*kept))
            split = F.when(F.col("_least").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(step)))
            rows = rows.join(marks.drop(*carried), [*group, "_path"], "left").withColumn("_path", split).drop("_least", "_largest")
    else:
        leaves = counted.select(*kept)
    inside = Window.partitionBy(*group, "_path").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({f"_inside_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    ranked = ranked.join(leaves, [*group, "_path"])
    ranked = ranked.withColumns({f"{w}_below": F.col(f"_offset_{w}") + F.col(f"_inside_{w}") for w in weights})
    return ranked.drop("_path", *[c for w in weights for c in (f"_offset_{w}", f"_inside_{w}")])


def with_rows_below(counts: DataFrame, group: list[str], value: str, weight: str = "n", refine: bool = True) -> DataFrame:
    """Add ``rows_below`` (weight of smaller values in the group) and ``group_rows``."""
    ranked = running_totals(counts, group, value, [weight], refine)
    return ranked.withColumnsRenamed({f"{weight}_below": "rows_below", f"{weight}_total": "group_rows"})


def grouped_quantile(df: DataFrame, group: list[str], value: str, q: float, name: str, refine: bool = True) -> DataFrame:
    """Exact quantile with linear interpolation of the non-null values per group."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_rows_below(counts, group, value, refine=refine)
    position = (F.col("group_rows") - 1) * F.lit(q)
    low, high = F.floor(position), F.ceil(position)
    until = F.col("rows_below") + F.col("n")
    picked = ranked.where((F.col("rows_below") <= high) & (until > low))
    at_low = F.max(F.when((F.col("rows_below") <= low) & (low < until), F.col(value)))
    at_high = F.max(F.when((F.col("rows_below") <= high) & (high < until), F.col(value)))
    return (
        picked.groupBy(*group)
        .agg(at_low.alias("_low"), at_high.alias("_high"), F.max(position - low).alias("_part"))
        .select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))
    )


def number_by_hash(df: DataFrame, group: list[str], digest: Column, tie: list[str], name: str) -> DataFrame:
    """Number rows 0..m-1 per group in the order of an md5 hex digest.

    Hash prefixes cut a group into even, bounded buckets; only a bucket is sorted in
    one task. Adds ``name`` and ``group_rows``.
    """
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, HASH_PREFIX))
    lower = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_bucket_rows"))
        .select(
            *group,
            "_bucket",
            F.coalesce(F.sum("_bucket_rows").over(lower), F.lit(0)).alias("_offset"),
            F.sum("_bucket_rows").over(Window.partitionBy(*group)).alias("group_rows"),
        )
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_digest", *tie)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_digest", "_bucket", "_offset", "_inside")
    )


def hash_number(text: Column) -> Column:
    """First 60 bits of an md5 digest as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
