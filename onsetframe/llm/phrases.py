"""Phrase collocations by a multikey quicksort of suffix pointers.

Every word of a piece starts a suffix: the window of up to five words from it. Windows go to the
task of their leading words. A task sorts pointers to its windows by multikey three-way quicksort,
one word deeper for each partition of equal words, down to the fifth: the size of an equal partition
is the count of the phrase, and a partition lighter than ``LEAST`` is abandoned unsorted. Equal windows
travel once, with their number.

Windows end where no frequent phrase can go on. Two tables of hashed cells say so: one counts words and pairs, the
other the longer phrases whose pairs are frequent. A cell stops at ``LEAST`` and is never too low, so the tables
only save shuffling, whatever their size: one cell for every ``BYTES_PER_CELL`` bytes of text, at most 2^26.

Leading words: one, but where more than 1/``CROWDED`` of the windows start with the same word, the second
deals them out too, and so on. At most ``CROWDED`` such groups exist; their own counts are sums.

Defined results: a null text is empty, a null lang ``und``; repeated rows count as often as they occur; an
empty table, or one without frequent phrases, gives no rows; other columns are ignored. Scores are exact
(38 digits); ties go by a, then by the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.llm.words import Words, byte_kinds, segments
from onsetframe.session import checkpointed

LEAST = 100
LONGEST = 5
FIRST = 2000
KINDS = byte_kinds(gaps=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")
BYTES_PER_CELL, FEWEST_CELLS, MOST_CELLS = 64, 1 << 16, 1 << 26
CELL_BLOCK = 1 << 16
CROWDED = 4096
FEWEST_CROWDED = 20_000  # windows with the same leading words that one task always takes
TASK_WINDOWS = 400_000
RANK_PARTS = 64
TASK_BYTES = 256 << 20  # text one task reads at least if all cores have work, as equal windows add up inside a task
HELD_WINDOWS = 1 << 19  # windows a task holds before equal ones are added up
SEGMENT = 1 << 20  # bytes of text a task turns into arrays at a time
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


# --- tables of cells ------------------------------------------------------------------


def _texts(docs: DataFrame, size: int) -> DataFrame:
    """``lang, text`` in as few tasks as keep every core at work."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").coalesce(tasks)


def _langs(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Number of each row's lang, and the langs."""
    column = batch.column("lang").dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary


def _lang_hash(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, seed=1) for x in langs.to_pylist()], np.uint64)


def _word_hashes(words: Words) -> np.ndarray:
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in words.distinct.to_pylist()], np.uint64)
    return distinct[words.ids] if len(words.ids) else np.zeros(0, np.uint64)


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) % np.uint64(cells)).astype(np.int64)


class Prefixes:
    """The phrases of one to five words from each word of a segment, as hashes, while they may be frequent."""

    def __init__(self, words: Words, lang_hash: np.ndarray) -> None:
        self.n = len(words.ids)
        self.of = _word_hashes(words)
        self.hash = (self.of + lang_hash) * _MIX[0]
        self.at = np.arange(self.n)
        self.room = np.zeros(self.n, np.int64)  # words from here to the end of the piece
        ends = np.r_[np.flatnonzero(np.diff(words.piece)), self.n - 1] if self.n else self.at
        self.room = ends[np.searchsorted(ends, self.at)] - self.at + 1 if self.n else self.room

    def longer(self, length: int) -> None:
        """Go on to phrases of ``length`` words, of those that are left."""
        fit = self.room[self.at] >= length
        self.at, self.hash = self.at[fit], self.hash[fit]
        self.hash = (self.hash ^ self.of[self.at + length - 1]) * _MIX[length % 2] + np.uint64(length)

    def keep(self, which: np.ndarray) -> None:
        self.at, self.hash = self.at[which], self.hash[which]


def _cell_table(texts: DataFrame, cells: int, least: int, visit: Callable[[Prefixes, Callable[[np.ndarray], None]], None]) -> np.ndarray:
    """Sums, up to ``least``, of the cells that ``visit`` names for each segment."""
    tops = np.uint8 if least < 256 else np.int64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, tops)

        def seen(cell: np.ndarray) -> None:
            at, n = np.unique(cell, return_counts=True)
            table[at] = np.minimum(table[at] + n, least)

        for batch in batches:
            lang_of, langs = _langs(batch)
            hashes = _lang_hash(langs)
            for words in segments(batch, KINDS, SEGMENT):
                visit(Prefixes(words, hashes[lang_of[words.row]]), seen)
        blocks = [(i, table[s : s + CELL_BLOCK]) for i, s in enumerate(range(0, cells, CELL_BLOCK))]
        blocks = [(i, pa.compress(b.tobytes(), "zstd", asbytes=True)) for i, b in blocks if b.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "cells"]
        )

    size = min(CELL_BLOCK, cells)

    def opened(held: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(held, size * np.dtype(tops).itemsize, "zstd", asbytes=True), tops)

    def add(part: pa.Table) -> pa.Table:
        table = np.zeros(size, np.int64)
        for held in part.column("cells").to_pylist():
            table += opened(held)
        merged = pa.compress(np.minimum(table, least).astype(tops).tobytes(), "zstd", asbytes=True)
        others = [c for c in part.column_names if c != "cells"]
        return pa.table([*[part.column(c).slice(0, 1) for c in others], pa.array([merged], pa.binary())], [*others, "cells"])

    counted = texts.mapInArrow(count, "block int, cells binary")
    # first the tables of some tasks each, then those sums: no task adds more than a few hundred blocks
    some = counted.withColumn("part", F.spark_partition_id() % 256).select("part", "block", "cells")
    merged = some.groupBy("part", "block").applyInArrow(add, "part int, block int, cells binary")
    merged = merged.select("block", "cells").groupBy("block").applyInArrow(add, "block int, cells binary")
    table = np.zeros(cells, tops)
    for block, held in merged.collect():
        table[block * CELL_BLOCK : block * CELL_BLOCK + size] = opened(held)
    return table


def short_table(texts: DataFrame, cells: int, least: int) -> np.ndarray:
    """Occurrences of words and of pairs."""

    def visit(phrases: Prefixes, seen: Callable[[np.ndarray], None]) -> None:
        seen(_cell(phrases.hash, cells))
        phrases.longer(2)
        seen(_cell(phrases.hash, cells))

    return _cell_table(texts, cells, least, visit)


def _frequent_pairs(phrases: Prefixes, short: np.ndarray, least: int) -> np.ndarray:
    """Whether each word starts a frequent pair; leaves the pairs in ``phrases``."""
    phrases.longer(2)
    phrases.keep(short[_cell(phrases.hash, len(short))] >= least)
    pair = np.zeros(phrases.n, bool)
    pair[phrases.at] = True
    return pair


def long_table(texts: DataFrame, short: np.ndarray, least: int) -> np.ndarray:
    """Occurrences of phrases of three to five words whose pairs are frequent."""

    def visit(phrases: Prefixes, seen: Callable[[np.ndarray], None]) -> None:
        pair = _frequent_pairs(phrases, short, least)
        for length in range(3, LONGEST + 1):
            phrases.keep(pair[np.minimum(phrases.at + length - 2, phrases.n - 1)])
            phrases.longer(length)
            seen(_cell(phrases.hash, len(short)))

    return _cell_table(texts, len(short), least, visit)


# --- windows --------------------------------------------------------------------------


def _windows(words: Words, phrases: Prefixes, langs: np.ndarray, short: np.ndarray, long: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``lang, w1..w5`` (-1 behind the end), each once, and how often."""
    phrases.keep(short[_cell(phrases.hash, len(short))] >= least)
    place = np.full(phrases.n, -1)
    place[phrases.at] = np.arange(len(phrases.at))
    rows = np.full((len(phrases.at), LONGEST + 1), -1, np.int32)
    rows[:, 0], rows[:, 1] = langs[phrases.at], words.ids[phrases.at]
    for length in range(2, LONGEST + 1):
        phrases.longer(length)
        table = short if length == 2 else long
        phrases.keep(table[_cell(phrases.hash, len(table))] >= least)
        rows[place[phrases.at], length] = words.ids[phrases.at + length - 1]
    mixed = np.zeros(len(rows), np.uint64)
    for c in range(LONGEST + 1):
        mixed = (mixed ^ rows[:, c].astype(np.uint64)) * _MIX[c % 2]
        mixed ^= mixed >> np.uint64(31)
    rows = rows[np.argsort(mixed, kind="stable")]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.diff(np.r_[first, len(rows)])


def suffix_windows(texts: DataFrame, short: np.ndarray, long: np.ndarray, least: int) -> DataFrame:
    """``lang, phrase, n``: the windows that frequent phrases may start, each once; without a phrase, all words of the lang."""

    def added(held: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        held.clear()
        pa.default_memory_pool().release_unused()  # a worker's next task would not use what Arrow keeps
        return summed.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            lang_of, langs = _langs(batch)
            hashes = _lang_hash(langs)
            for words in segments(batch, KINDS, SEGMENT):
                lang = lang_of[words.row]
                rows, n = _windows(words, Prefixes(words, hashes[lang]), lang, short, long, least)
                known = words.distinct.cast(pa.string())
                parts = [known.take(pa.array(rows[:, k], mask=rows[:, k] < 0)) for k in range(1, LONGEST + 1)]
                phrases = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                whole = np.bincount(lang, minlength=len(langs))
                held.append(pa.table(
                    [langs.take(pa.array(np.r_[rows[:, 0], np.arange(len(langs))])),
                     pa.concat_arrays([phrases, pa.nulls(len(langs), pa.string())]), pa.array(np.r_[n, whole].astype(np.int64))],
                    ["lang", "phrase", "n"],
                ))
                rows_held += len(rows)
                if rows_held >= HELD_WINDOWS:
                    held = [added(held)]
                    rows_held = held[0].num_rows
                    if rows_held >= HELD_WINDOWS // 2:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
                        rows_held = 0
        if held:
            yield from added(held).to_batches(max_chunksize=1 << 16)

    counted = texts.mapInArrow(cut, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _lead(words: int) -> Column:
    return F.substring_index("phrase", " ", words)


def routed(windows: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The windows with the leading words that deal them out and their number (``depth``), and the counts of
    the crowded leads, which no single task sees whole."""
    crowd = max(rows // CROWDED, FEWEST_CROWDED)
    out, sums = windows.withColumn("lead", _lead(1)).withColumn("depth", F.lit(1)), None
    for depth in range(1, LONGEST):
        here = out.where(F.col("depth") == depth).groupBy("lang", "lead").agg(F.count("*").alias("rows"), F.sum("n").alias("f"))
        found = here.where(F.col("rows") > crowd).collect()  # at most CROWDED
        if not found:
            break
        schema = "lang string, lead string, f long"
        crowded = windows.sparkSession.createDataFrame([(r.lang, r.lead, r.f) for r in found], schema)
        level = crowded.select("lang", F.col("lead").alias("phrase"), "f")
        sums = level if sums is None else sums.unionByName(level)
        marked = F.broadcast(crowded.select("lang", "lead", F.lit(True).alias("split")))
        # a window that ends with its crowded lead is counted by now
        out = out.join(marked, ["lang", "lead"], "left").where("split IS NULL OR phrase != lead").select(
            "lang", "phrase", "n",
            F.when(F.col("split"), _lead(depth + 1)).otherwise(F.col("lead")).alias("lead"),
            F.when(F.col("split"), depth + 1).otherwise(F.col("depth")).alias("depth"),
        )
    return out, sums


# --- sorting --------------------------------------------------------------------------


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: int, found: Callable[[int, int, int], None]) -> None:
    """Multikey three-way quicksort of pointers to the rows of ``keys``, by one column after the other.

    ``found(row, depth, weight)`` hears of every set of rows with equal columns up to ``depth`` that weighs
    ``least`` or more; a lighter partition is left as it is. -1 ends a row.
    """
    pointers = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        low, high, depth = todo.pop()
        at = pointers[low:high]
        if high == low or weight[at].sum() < least:
            continue
        key = keys[at, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, more = key < pivot, key > pivot
        same = at[~(less | more)]
        fewer, greater = at[less], at[more]
        pointers[low:high] = np.concatenate((fewer, same, greater))
        todo += [(low, low + len(fewer), depth), (high - len(greater), high, depth)]
        heavy = int(weight[same].sum())
        if pivot >= 0 and heavy >= least:
            found(int(same[0]), depth, heavy)
            if depth + 1 < keys.shape[1]:
                todo.append((low + len(fewer), high - len(greater), depth + 1))


def _matrix(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Numbers of the lang and the words of each phrase, -1 behind the last."""
    split = pc.split_pattern(phrases, " ")
    words = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy()
    size = np.diff(offsets)
    keys = np.full((len(phrases), LONGEST + 1), -1, np.int32)
    keys[:, 0] = langs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    for k in range(LONGEST):
        has = size > k
        keys[has, k + 1] = words[offsets[:-1][has] - offsets[0] + k]
    return keys


def sorted_counts(routed_windows: DataFrame, parts: int, least: int) -> DataFrame:
    """``lang, phrase, f`` from the equal partitions of each task's windows."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        langs, phrases = (table.column(c).combine_chunks() for c in ("lang", "phrase"))
        depth_from = table.column("depth").to_numpy()
        out: list[tuple[int, int, int]] = []

        def found(row: int, depth: int, heavy: int) -> None:
            # shorter phrases of crowded leads are counted elsewhere
            if depth >= depth_from[row]:
                out.append((row, depth, heavy))

        equal_partitions(_matrix(langs, phrases), table.column("n").to_numpy(), least, found)
        rows = pa.array([r for r, _, _ in out], pa.int64())
        texts = [" ".join(p.split(" ")[:d]) for p, (_, d, _) in zip(phrases.take(rows).to_pylist(), out)]
        yield pa.RecordBatch.from_arrays(
            [langs.take(rows), pa.array(texts, pa.string()), pa.array([w for _, _, w in out], pa.int64())], ["lang", "phrase", "f"]
        )

    dealt = routed_windows.repartition(parts, "lang", "lead").select("lang", "phrase", "n", "depth")
    return dealt.mapInArrow(sort, "lang string, phrase string, f long")


# --- scores ---------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, f, words``: frequent phrases of one to five words (kept); without a phrase, all words of the lang."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max(1 << (size // BYTES_PER_CELL).bit_length(), FEWEST_CELLS), MOST_CELLS)
    texts = _texts(docs, size)
    short = short_table(texts, cells, least)
    windows = checkpointed(suffix_windows(texts, short, long_table(texts, short, least), least))
    starts = windows.where("phrase IS NOT NULL")
    rows = starts.count()
    dealt, sums = routed(starts, rows)
    counted = sorted_counts(dealt, -(-rows // TASK_WINDOWS) or 1, least)
    counted = counted if sums is None else counted.unionByName(sums.where(F.col("f") >= least))
    every = counted.unionByName(windows.where("phrase IS NULL").withColumnRenamed("n", "f"))
    return checkpointed(every.withColumn("words", F.size(F.split("phrase", " "))))


def without_contained(candidates: DataFrame) -> DataFrame:
    """Candidates that lie in no longer one of the same count.

    If a longer one has the same count, so has each phrase between the two; one word more decides.
    """
    longer = candidates.where("words > 2")
    inner = [F.expr(f"substring_index(phrase, ' ', {n})") for n in ("words - 1", "1 - words")]
    covered = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").distinct()
    return candidates.join(covered, ["lang", "phrase", "f"], "left_anti")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every phrase that stays, at its lowest cut."""
    total = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = counts.where("phrase IS NOT NULL")
    kept = without_contained(known.where("words > 1"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    full = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    full = full.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn("score", F.expr("(_a * _n * 1000) div (_l * _r)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return full.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """Rank within the lang, up to ``most``; parts of a lang are ranked first, so none is sorted whole by one task."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    near = near.where(F.col("rank") <= most).drop("rank", "_part")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, least: int = LEAST, most: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest collocations of each lang."""
    found = first_of_each(scored(phrase_counts(docs, least)), most)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM placed, (VALUES (1), (2), (3), (4), (5)) AS s(k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
kept AS (SELECT * FROM f c WHERE k > 1 AND NOT EXISTS (
  SELECT 1 FROM f g WHERE g.lang = c.lang AND g.k > c.k AND g.f = c.f AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept),
full_cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM full_cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {FIRST}
"""
