"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a budget of words. A document's place is a hash of its id. Words are summed
by source and hash bucket; the bucket in which the running sum crosses the budget is refined
with the next digits of the hash, and all others are decided already. What remains is a filter
``hash < threshold`` per source: nothing is sorted, and a larger budget takes a superset.

Defined results: a null or empty text has size 0 and gives no words; a null source is a source of
its own, the last one; rows that share a doc_id (a null one too) share their fate; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
# hexadecimal digits of the hash at each level of refinement: 4096 buckets each
LEVELS = (3, 6, 9, 12)
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3.0
# thresholds are broadcast up to so many sources; with more, they are joined
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The first 48 bits of an md5 of the id, as digits."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, LEVELS[-1])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """Words each source is to give: ``(source, source_size, target)`` from ``(source, size)``.

    The whole budget is ``share`` of all words, dealt by weight; no source gives more than
    ``MAX_REPEATS`` times its words. With the sources ordered by cap over weight, a source
    stops at its cap if the level that fills it leaves budget over; the rest share one level.
    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumns({
        "weight": F.element_at(cycle, F.pmod(rank - 1, F.lit(len(weights))) + 1),
        "cap": F.col("source_size") * MAX_REPEATS,
        "budget": F.sum("source_size").over(everyone) * share,
    })
    level = F.col("cap") / F.col("weight")
    by_level = Window.orderBy(level, F.col("source").asc_nulls_last())
    filled = F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) + level * F.coalesce(
        F.sum("weight").over(by_level.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)
    )
    judged = weighed.withColumn("capped", filled < F.col("budget"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everyone)
    free = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(everyone)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least((F.col("budget") - spent) / free * F.col("weight"), F.col("cap"))
    )
    return judged.select("source", "source_size", target.alias("target"))


def _near(by_source: DataFrame) -> DataFrame:
    """A table with a row per source, broadcast up to a number of rows."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def thresholds(thin: DataFrame, targets: DataFrame) -> DataFrame:
    """How often each source is taken whole, and up to which hash once more.

    ``thin`` has (source, size, place). The open bucket of every source meets the rows before they are summed, so beyond the
    first level only the rows of the boundary buckets are aggregated.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumns({"whole": whole.cast("long"), "prefix": F.lit(""), "below": F.lit(0).cast("long")}).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    facts = ["source_size", "target", "whole", "rest"]
    length = 0
    for digits in LEVELS:
        state = checkpointed(state)
        opened = _near(state.select(F.col("source").alias("s"), "prefix"))
        boundary = thin.join(opened, F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, length) == F.col("prefix")))
        rows = boundary.groupBy("s", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("size").alias("bytes"))
        inside = _near(state).join(rows, F.col("source").eqNullSafe(F.col("s")))
        running = F.col("below") + F.sum("bytes").over(Window.partitionBy("source").orderBy("bucket"))
        crossing = (
            inside.withColumn("running", running)
            .where(F.col("running") >= F.col("rest") - 1e-6)
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "running", "bytes", *facts)).alias("b"))
        )
        state = crossing.select(
            "source", *[f"b.{c}" for c in facts], F.col("b.bucket").alias("prefix"),
            (F.col("b.running") - F.col("b.bytes")).alias("below"), F.col("b.bytes").alias("last"),
        )
        length = digits
    # the last bucket holds one hash: it is taken if that comes nearer to the budget
    with_last = (F.col("rest") > 0) & (F.col("below") + F.col("last") - F.col("rest") <= F.col("rest") - F.col("below"))
    return state.select(
        "source", "source_size", "target", "whole", F.col("prefix").alias("threshold"), with_last.alias("with_last")
    )


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Thin rows ``(doc_id, source, size, place)`` and the thresholds by source, both kept."""
    thin = checkpointed(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))
    )
    return thin, checkpointed(thresholds(thin, source_targets(thin, weights, share)))


def with_copies(rows: DataFrame, limits: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` (with source and place) and how many ``copies`` the mix takes of each."""
    limits = _near(limits.withColumnRenamed("source", "limit_source"))
    once_more = (F.col("place") < F.col("threshold")) | (
        (F.col("place") == F.col("threshold")) & F.col("with_last")
    )
    copies = F.col("whole") + F.when(F.col("rest_taken"), 1).otherwise(0)
    return (
        rows.join(limits, F.col("source").eqNullSafe(F.col("limit_source")))
        .withColumn("rest_taken", once_more)
        .select(*rows.columns, *keep, copies.alias("copies"))
    )


def mix_decisions(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``."""
    thin, limits = mixture(docs, weights, share)
    decided = with_copies(thin, limits, ["source_size", "target"])
    return decided.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as the mix takes it."""
    _, limits = mixture(docs, weights, share)
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("source"), place(F.col("doc_id")).alias("place"))
    taken = with_copies(rows, limits, []).where(F.col("copies") > 0)
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = """
WITH thin AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS place
  FROM documents),
totals AS (SELECT source, sum(size) AS source_size FROM thin GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         source_size * 3.0 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM totals),
judged AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
         + cap / weight * coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) < budget AS capped
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
         least((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
               / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight, cap) END AS target
  FROM judged),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
places AS (
  SELECT source, place, sum(size) AS here,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS running
  FROM thin GROUP BY source, place),
crossing AS (
  SELECT b.source, min(p.place) AS threshold
  FROM budgets b JOIN places p ON b.source IS NOT DISTINCT FROM p.source
  WHERE p.running >= b.target - b.whole * b.source_size - 1e-6 GROUP BY b.source),
limits AS (
  SELECT b.*, c.threshold,
         p.running - (b.target - b.whole * b.source_size)
           <= (b.target - b.whole * b.source_size) - (p.running - p.here) AS with_last
  FROM budgets b JOIN crossing c ON b.source IS NOT DISTINCT FROM c.source
  JOIN places p ON p.source IS NOT DISTINCT FROM b.source AND p.place = c.threshold)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, CAST(l.source_size AS BIGINT) AS source_size, l.target,
       CAST(t.size * (l.whole + CASE WHEN t.place < l.threshold OR (t.place = l.threshold AND l.with_last)
                                THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM thin t JOIN limits l ON t.source IS NOT DISTINCT FROM l.source
"""


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_decisions(docs).select("doc_id", "size", "source_size", "target", "taken")
