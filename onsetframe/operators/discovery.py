"""Code search, cohorts and frequency profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.schemas import PATIENT

BLOCK_CODES = 128  # about as many codes of an admission lie in one row

CODE, TITLE, ADMISSION, ID = "diagnosis_code", "long_title", "admission_id", "analysis_id"


def _any(title: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [title.like(p.lower()) for p in patterns])


def title_condition(
    title: Column,
    all_of: list[str] = (),
    any_of: list[str] = (),
    none_of: list[str] = (),
    or_any: list[str] = (),
) -> Column:
    """``(every all_of AND some any_of AND no none_of) OR some or_any``, ignoring case.

    The terms are LIKE patterns.
    """
    lowered = F.lower(title)
    terms = [lowered.like(p.lower()) for p in all_of]
    terms += [_any(lowered, list(any_of))] if any_of else []
    terms += [~_any(lowered, list(none_of))] if none_of else []
    condition = reduce(lambda a, b: a & b, terms) if terms else F.lit(not or_any)
    return condition | _any(lowered, list(or_any)) if or_any else condition


def code_search(lookup: DataFrame, diagnoses: DataFrame, **patterns: list[str]) -> DataFrame:
    """Codes whose title meets the patterns, with their number of diagnosis rows, most first.

    Diagnoses are counted per code before they meet the lookup.
    """
    per_code = diagnoses.groupBy(CODE).agg(F.count(F.lit(1)).alias("_n"))
    wanted = lookup.where(title_condition(F.col(TITLE), **patterns)).select(CODE, TITLE)
    return (
        wanted.join(per_code, CODE)
        .groupBy(CODE, TITLE)
        .agg(F.sum("_n").alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), CODE, TITLE)
    )


def _code_blocks(counted: DataFrame) -> DataFrame:
    """Codes of an admission in blocks: ``admission_id, blocks, block, codes`` (code and its rows)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(ADMISSION))
    blocks = F.ceil(F.col("_size") / BLOCK_CODES).cast("int")
    placed = counted.withColumn("_size", size).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64(CODE), F.col("blocks")).cast("int"))
    codes = F.sort_array(F.collect_list(F.struct(F.col(CODE).alias("c"), "n")))
    return placed.groupBy(ADMISSION, "blocks", "block").agg(codes.alias("codes"))


def code_tiles(counted: DataFrame) -> DataFrame:
    """``times, one, other``: the pairs of blocks of every admission, ``other`` NULL for a block with itself.

    An admission of one block is a basket, and equal baskets are one row with their number. Those of more blocks
    are joined with themselves in a triangle: each pair of blocks meets once, on a key of its own, so no row and no task holds
    a whole basket.
    """
    blocks = _code_blocks(counted)
    baskets = blocks.where((F.col("blocks") == 1) & (F.size("codes") > 1)).groupBy(F.col("codes").alias("one")).agg(
        F.count(F.lit(1)).alias("times")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_with")
    sent = blocks.where(F.col("blocks") > 1).select(ADMISSION, "block", "codes", each)
    corner = [F.least("block", "_with").alias("_i"), F.greatest("block", "_with").alias("_j")]
    met = sent.select(ADMISSION, *corner, "codes").groupBy(ADMISSION, "_i", "_j").agg(F.collect_list("codes").alias("_met"))
    # a block without codes meets nothing
    triangle = met.where((F.col("_i") == F.col("_j")) | (F.size("_met") == 2)).select(
        F.lit(1).cast("long").alias("times"), F.col("_met")[0].alias("one"), F.get("_met", F.lit(1)).alias("other")
    )
    none = F.lit(None).cast(baskets.schema["one"].dataType)
    return baskets.select("times", "one", none.alias("other")).unionByName(triangle)


def pair_cooccurrence(
    diagnoses: DataFrame, lookup: DataFrame, condition: Column, distinct_pairs: bool = False
) -> DataFrame:
    """How often two different codes meet in one admission, per unordered pair of titles.

    Every unordered pair of rows counts twice (once per order); ``distinct_pairs`` halves it.
    Rows are reduced to one count per admission and code first, and pairs of codes are summed before they
    get their titles.
    """
    codes = lookup.where(condition).select(CODE, TITLE)
    matching = diagnoses.where(F.col(ADMISSION).isNotNull()).select(ADMISSION, CODE)
    wanted = matching.join(codes.select(CODE).distinct(), CODE, "left_semi")
    # after a join on admissions, its sorts, both counts and the baskets would all fill one task: rows are dealt anew
    counted = wanted.repartition(F.xxhash64(ADMISSION, CODE)).groupBy(ADMISSION, CODE).agg(F.count(F.lit(1)).alias("n"))
    first = code_tiles(counted).select("times", "one", "other", F.posexplode("one").alias("_p", "a"))
    later = F.coalesce("other", F.slice("one", F.col("_p") + 2, F.size("one")))
    pairs = first.select("times", "a", F.explode(later).alias("b"))
    weight = F.col("times") * F.col("a.n") * F.col("b.n") * (1 if distinct_pairs else 2)
    by_code = pairs.groupBy(F.least("a.c", "b.c").alias("_c1"), F.greatest("a.c", "b.c").alias("_c2")).agg(
        F.sum(weight).alias("_weight")
    )
    titles = [codes.select(F.col(CODE).alias(f"_c{i}"), F.col(TITLE).alias(f"_t{i}")) for i in (1, 2)]
    titled = by_code.join(titles[0], "_c1").join(titles[1], "_c2")
    return (
        titled.groupBy(F.least("_t1", "_t2").alias("diagnosis_1"), F.greatest("_t1", "_t2").alias("diagnosis_2"))
        .agg(F.sum("_weight").alias("pair_occurrence_count"))
        .orderBy(F.desc("pair_occurrence_count"), "diagnosis_1", "diagnosis_2")
    )


def cohort(diagnoses: DataFrame, codes: list[str]) -> DataFrame:
    """Patients with one of the codes."""
    return diagnoses.where(F.col(CODE).isin(list(codes))).select(PATIENT).distinct()


def exclude_cohort(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select(PATIENT), PATIENT, "left_anti")


def include_cohort(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select(PATIENT), PATIENT, "left_semi")


def frequency(events: DataFrame, lookup: DataFrame, key: str = ID, name: str = "analysis_name") -> DataFrame:
    """Rows and share of all rows per key, with its name, most frequent first.

    The total counts every row, also of keys without a name. It is the sum of the counts
    and enters as a scalar subquery, so the table is aggregated once per use and not joined.
    """
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("event_count"))
    total = counts.agg(F.sum("event_count")).scalar()
    shares = counts.withColumn("percentage", F.col("event_count") / total * 100)
    return (
        shares.join(lookup.select(key, name), key)
        .select(name, key, "event_count", "percentage")
        .orderBy(F.desc("event_count"), key)
    )


def top_k(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """First ``k`` rows by a column, descending."""
    return df.orderBy(F.desc(column), tie).limit(k)


def top_n_per_group(
    df: DataFrame, group: str, order: list[Column | str], n: int, count: str, min_count: int
) -> DataFrame:
    """First ``n`` rows per group in a given order, among the rows with ``count > min_count``.

    Every task keeps at most ``n`` rows per group before the exchange.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.where(F.col(count) > min_count).withColumn("place", place).where(F.col("place") <= n)


def group_profile(df: DataFrame, group: str, count: str) -> DataFrame:
    """Sum, largest, smallest count and number of elements per group, largest sum first."""
    return (
        df.groupBy(group)
        .agg(
            F.sum(count).alias("event_count"),
            F.max(count).alias("max_count"),
            F.min(count).alias("min_count"),
            F.count(F.lit(1)).alias("num_elements"),
        )
        .orderBy(F.desc("event_count"), group)
    )


def group_id_lists(top: DataFrame, group: str, key: str) -> DataFrame:
    """List of ids per group in their order; takes the result of :func:`top_n_per_group`."""
    ordered = F.sort_array(F.collect_list(F.struct("place", key)))
    return top.groupBy(group).agg(F.transform(ordered, lambda e: e[key]).alias("ids"))
