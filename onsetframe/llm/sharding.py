"""Sharding by histogram sort: splitters with equal bytes between them, then one exchange.

The sort key is a hash of the text followed by a hash of the id, as digits, so equal texts are
neighbours. Each round counts the exact bytes below candidate boundaries (the next digits of the
few prefixes in which a splitter must lie) over all partitions, and stops a splitter once a
boundary is within tolerance of its share. A boundary falls inside a group of equal texts only if
the group is larger than the tolerance. The rows move once, by shard and a part of the shard.

Defined results: a null text has 0 bytes and the checksum of the empty text; rows with equal text
and doc_id stay together; with fewer documents than shards some shards are empty; an empty
table gives an empty result; further columns are kept, but for those named like a new one.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.session import checkpointed

SHARDS = 40
OVERHEAD = 16
HALF = 16
FIRST_DIGITS, MORE_DIGITS = 3, 2
# a splitter may be off its place by this share of a shard
TOLERANCE = 0.005
# parts of a shard, so that no task numbers a whole shard
PARTS = 64
PART, PLACE, FIRST = "__part", "__place", "__first_slot"  # names that no column of the documents has


def sort_key(text: Column, doc_id: Column) -> Column:
    def digits(c: Column) -> Column:
        return F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, HALF)

    return F.concat(digits(text), digits(doc_id.cast("string")))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``size``, ``text_crc32`` and ``sort_key``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "size": F.octet_length(text).cast("long") + OVERHEAD,
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
        "sort_key": sort_key(text, F.col("doc_id")),
    })


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[str]:
    """Boundary keys: shard ``i`` has the keys from the i-th up to the next one.

    The driver sees one count per candidate boundary: 4096 in the first round, then at most
    256 for each splitter that is still open.
    """
    last, known, length = 2 * HALF, 0, FIRST_DIGITS
    bins = _counts(rows, 0, length, None)
    total = sum(size for _, size, _ in bins)
    slack = tolerance * total / shards
    found: list[str] = [""] * (shards - 1)
    # splitter -> (wanted bytes below it, prefix it lies in, bytes below that prefix)
    pending = {i: ((i + 1) * total / shards, "", 0) for i in range(shards - 1)}
    while pending and bins:
        inside: dict[str, list] = {}
        for row in sorted(bins):
            inside.setdefault(row[0][:known], []).append(row)
        still = {}
        for i, (wanted, prefix, below) in pending.items():
            here = inside[prefix]
            ends = list(accumulate((size for _, size, _ in here), initial=below))
            at = min(max(bisect_left(ends, wanted) - 1, 0), len(here) - 1)
            name, _, count = here[at]
            low, high = wanted - ends[at], ends[at + 1] - wanted
            if min(low, high) <= slack or count == 1 or length >= last:
                found[i] = name if low <= high else name + "g"  # g sorts after every digit
            else:
                still[i] = (wanted, name, ends[at])
        pending = still
        if pending:
            known, length = length, min(length + MORE_DIGITS, last)
            bins = _counts(rows, known, length, sorted({p for _, p, _ in pending.values()}))
    return found


def _counts(rows: DataFrame, known: int, length: int, prefixes: list[str] | None) -> list[tuple]:
    if prefixes is not None:
        rows = rows.where(F.substring("sort_key", 1, known).isin(prefixes))
    counted = rows.groupBy(F.substring("sort_key", 1, length).alias("b")).agg(F.sum("size"), F.count("*"))
    return [tuple(r) for r in counted.collect()]


def assign(rows: DataFrame, bounds: list[str], parts: int = PARTS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, moved once.

    Slots run over the parts of a shard one after another; the counts that give each part its
    first slot are one row per shard and part.
    """
    shard = F.lit(0)
    for key in bounds:
        shard = shard + F.when(F.col("sort_key") >= key, 1).otherwise(0)
    dealt = rows.withColumns({"shard": shard, PART: F.pmod(F.xxhash64("sort_key"), F.lit(parts)).cast("int")})
    before = Window.partitionBy("shard").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", PART).count().select(
        "shard", PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(FIRST)
    )
    place = F.row_number().over(Window.partitionBy("shard", PART).orderBy("sort_key"))
    numbered = dealt.withColumn(PLACE, place).join(F.broadcast(first), ["shard", PART])  # shards x parts rows
    return numbered.withColumn("slot", F.col(FIRST) + F.col(PLACE) - 1).drop(PART, PLACE, FIRST)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with ``size, text_crc32, sort_key, shard, slot``; whole rows move once."""
    ready = keyed(docs)
    thin = checkpointed(ready.select("size", "sort_key"))
    return assign(ready, splitters(thin, shards))


def op8_histogram_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = checkpointed(keyed(docs).select("doc_id", "size", "text_crc32", "sort_key"))
    return assign(thin, splitters(thin)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
