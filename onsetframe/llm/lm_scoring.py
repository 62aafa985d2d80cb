"""Cross-entropy difference of two matched n-gram models.

The target model is counted on the labelled good documents, the background model on all documents.
Both share one vocabulary (the commonest words of all documents, the rest is one unknown word), one
order, one smoothing; the background counts are scaled to the target's total, so smoothing weighs
the same. A document's score is the mean over its words of target loss minus background loss: low
for what resembles the target.

The models grow with the corpus: with the root of its size, so that they still fit a task, the vocabulary from
``VOCABULARY`` and the hashed cells of bigrams from ``CELLS`` up to ``MOST_CELLS``. A cell counts what falls into it by chance too; the
mean of all cells is taken off, and a first word that is rare beside that mean gives its bigrams little weight. Every count covers the
whole corpus, summed in tasks first and then over a shuffle.

Defined results: a null or empty text has no words and null losses; repeated rows are scored each and
counted each; labels without a document are not used; without target documents the target model is
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.llm.cells import SCHEMA, IdFilter, packed, summed
from onsetframe.llm.texts import slices, utf8

VOCABULARY, VOCABULARY_GROWTH = 50_000, 8
CELLS, CELL_GROWTH, MOST_CELLS = 1 << 20, 256, 1 << 24
BYTES_PER_WORD = 6
BIGRAM_WEIGHT = 0.6
SMOOTH = 0.5
# distinct words a task holds before it hands on what it counted
HELD_WORDS = 300_000
UNKNOWN = 0


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def table_sizes(docs: DataFrame) -> tuple[int, int]:
    """Words of the vocabulary and cells of bigrams for a corpus of this size."""
    root = math.sqrt((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BYTES_PER_WORD)
    cells = 1 << math.ceil(math.log2(max(CELLS, CELL_GROWTH * root)))
    return max(VOCABULARY, int(VOCABULARY_GROWTH * root)), min(cells, MOST_CELLS)


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> dict[bytes, int]:
    """Numbers from 1 for the ``most`` commonest words of all documents; ties by the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            for text in utf8(part):
                seen.update(words(text))
            if len(seen) > HELD_WORDS:
                yield _counts(seen)
                seen = Counter()
        if seen:
            yield _counts(seen)

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = counted.orderBy(F.desc("n"), "word").limit(most).toArrow().column("word").to_pylist()
    return {w: i for i, w in enumerate(common, start=1)}


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def numbered(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Word numbers after one boundary mark (the first number beyond the vocabulary)."""
    get = known.get
    return np.array([len(known) + 1, *[get(w, UNKNOWN) for w in words(text)]], np.int64)


def cells(ids: np.ndarray, many: int) -> np.ndarray:
    """The cell of each bigram."""
    x = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(many)).astype(np.int64)


class Model:
    """Interpolated bigram model from counts of words, of words as a first part, and of bigram cells."""

    def __init__(self, word: np.ndarray, before: np.ndarray, cell: np.ndarray, scale: float = 1.0):
        word = word * scale
        self.unigram = (word + SMOOTH) / (word.sum() + SMOOTH * len(word))
        self.chance = cell.sum() / len(cell)  # of other bigrams in a cell
        self.before = np.maximum(before, 1).astype(float)
        self.weight = BIGRAM_WEIGHT * before / np.maximum(before + self.chance, 1)
        self.cell = cell.astype(np.float32)

    def losses(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Minus the log of each word's probability."""
        first = ids[:-1]
        joint = np.clip((self.cell[at] - self.chance) / self.before[first], 0.0, 1.0)
        weight = self.weight[first]
        return -np.log(weight * joint + (1 - weight) * self.unigram[ids[1:]])


def counted(docs: DataFrame, known: dict[bytes, int], many: int, name: str) -> DataFrame:
    """Word, first-part and bigram counts of all rows, one behind the other in a table."""
    size = len(known) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * size + many, np.int64)
        word, before, cell = table[:size], table[size : 2 * size], table[2 * size :]
        for part in slices(batches):
            texts = [ids for ids in (numbered(t, known) for t in utf8(part)) if len(ids) > 1]
            for into, where in (
                (word, [ids[1:] for ids in texts]), (before, [ids[:-1] for ids in texts]), (cell, [cells(ids, many) for ids in texts])
            ):
                if where:
                    at, n = np.unique(np.concatenate(where), return_counts=True)
                    into[at] += n
        yield packed(name, table)

    return docs.select("text").mapInArrow(count, SCHEMA)


def matched_models(docs: DataFrame, targets: DataFrame, known: dict[bytes, int], many: int) -> tuple[Model, Model]:
    """Target and background model, collected as packed tables."""
    both = counted(targets, known, many, "target").unionByName(counted(docs, known, many, "background"))
    size = len(known) + 2
    tables = summed(both, dict.fromkeys(("target", "background"), 2 * size + many))
    target, background = (np.split(tables[name], [size, 2 * size]) for name in ("target", "background"))
    scale = target[0].sum() / background[0].sum() if target[0].sum() and background[0].sum() else 1.0
    return Model(*target), Model(*background, scale=scale)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every document."""
    # labels grow with the corpus, so they are merged, not broadcast, at every size; a filter of their ids spares
    # most other texts the way
    wanted = target_ids.select("doc_id").distinct()
    likely = IdFilter(wanted, "doc_id").keep(docs.select("doc_id", "text"), "doc_id")
    targets = likely.join(wanted.hint("merge"), "doc_id", "left_semi")
    most, many = table_sizes(docs)
    known = vocabulary(docs, most)
    models = docs.sparkSession.sparkContext.broadcast((known, *matched_models(docs, targets, known, many)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, target, background = models.value
        for part in slices(batches):
            rows = []
            for text in utf8(part):
                ids = numbered(text, words_of)
                if len(ids) == 1:
                    rows.append((0, None, None, None))
                    continue
                at = cells(ids, many)
                one, other = target.losses(ids, at), background.losses(ids, at)
                rows.append((len(ids) - 1, one.mean(), other.mean(), (one - other).mean()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.float64()] * 3])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns], ["doc_id", "n_words", "target_loss", "background_loss", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double"
    )


def op7_cross_entropy(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(docs, labels.where("quality = 1 AND coalesce(toxic, 0) = 0"))
