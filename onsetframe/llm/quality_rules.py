"""Quality rules: boosted trees over document statistics.

One pass over the texts gives each document's counts. Two fixed rules reject a document outright
(too few words, too much of it repeated); for the rest gradient-boosted trees, fitted on a bounded
sample of the labelled rows, decide. The score may only fall with the shares of symbols, repeated
lines, repeated words, capitals and exclamation marks.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are
judged each; labels without a document, or null ones, are not used; if the sample lacks a class,
the trees reject nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.llm import boosting
from onsetframe.llm.texts import SPACES, slices, utf8
from onsetframe.session import checkpointed

# the fit takes at most so many labelled documents, those with the smallest md5 of their id
FIT_ROWS = 20_000
# the trees reject a document if they hold it for good with less than this probability
LEAST_PROBABILITY = 0.5
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_digits", "n_exclaim", "n_commas")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "exclaim_share", "comma_share", "words_per_line",
)
MONOTONE = {2: -1, 3: -1, 4: -1, 6: -1, 8: -1}
# fixed odd factors that turn a window of word numbers into one 64-bit number
FACTORS = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(WINDOW)], dtype=np.uint64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of five found twice or more."""
    if len(numbers) <= WINDOW:
        return 0
    mixed = numbers * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    starts = len(numbers) - WINDOW + 1
    windows = sum(mixed[i : i + starts] * FACTORS[i] for i in range(WINDOW))
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(starts, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(numbers) + 1, dtype=np.int64)
    edge[:starts] += twice
    edge[WINDOW:] -= twice
    return int((edge.cumsum()[:-1] > 0).sum())


def statistics(text: bytes) -> tuple:
    words = text.split()  # bytes split at exactly the six ASCII white-space characters
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    code_points = len(text) - int(seen[0x80:0xC0].sum())
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return (
        len(words), code_points - int(seen[list(SPACES)].sum()), int(seen[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)), repeated_words(numbers),
        len(lines), len(number), int(seen[65:91].sum()), int(seen[48:58].sum()), int(seen[33]), int(seen[44]),
    )


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_exclaim"] / words, c["n_commas"] / words, words / lines,
    ], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every whole text, in one narrow pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [statistics(text) for text in utf8(part)]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *COUNTS, *MORE])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    return docs.select("doc_id", "text").mapInArrow(count, schema)


def fit_rules(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> boosting.Trees | None:
    """Trees for ``quality`` from the sample of labelled rows."""
    sample = (
        stats.join(labels.where("quality IN (0, 1)").select("doc_id", "quality"), "doc_id")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality", *COUNTS)
        .limit(rows)
        .toPandas()
    )
    return boosting.fit(
        features({c: sample[c].to_numpy() for c in (*COUNTS, *MORE)}), sample["quality"].to_numpy(float), MONOTONE
    )


def judged(stats: DataFrame, model: boosting.Trees | None) -> DataFrame:
    """``stats`` with ``base_failed``, ``score`` and ``kept``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in (*COUNTS, *MORE)}
            chance = model.probability(features(c)) if model else np.ones(batch.num_rows)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            kept = ~failed & (chance >= LEAST_PROBABILITY)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(chance), pa.array(kept)],
                [*batch.schema.names, "base_failed", "score", "kept"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(score, schema + ", base_failed boolean, score double, kept boolean")


def quality_decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = checkpointed(document_statistics(docs))
    return judged(stats, fit_rules(stats, labels))


def keep_good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    The model is fitted first; then each document is counted, judged and kept or dropped in one
    narrow pass, so no text is moved.
    """
    model = fit_rules(document_statistics(docs), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            c = dict(zip((*COUNTS, *MORE), np.array([statistics(t) for t in utf8(part)], dtype=np.int64).T))
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            chance = model.probability(features(c)) if model else np.ones(part.num_rows)
            yield part.filter(pa.array(~failed & (chance >= LEAST_PROBABILITY)))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_decisions(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "score")
