"""Sum-of-squares packing of tokenised documents into windows of at most 1024 tokens.

Each task tokenises its documents in order and packs them as they come. A document's full windows
stand alone; its remainder goes to the fill level for which the sum, over all levels, of the squared
number of partially filled windows gets smallest. The level array holds the open windows by fill.
At the end of a task the open windows are merged by cutting until one is left, and that one is cut
into windows of a power of two, which need no padding. Nothing is shuffled, and a task's state is
at most one stack of windows for each of 1023 levels.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an
empty table gives an empty result; further columns are ignored. Sequence ids carry the task's number,
so they do not clash; a lost task is packed again from the same rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from onsetframe.llm.texts import slices

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
TASK_BITS = 36

PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# the vocabulary's pattern, and a quicker equal of it for texts without two white spaces in a row
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
WHITE_RUN = re.compile(r"\s\s")
# white space as the pattern's engine has it; runs this long are cut out before they reach its lookahead
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves, the others, in order, are the characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Token ids of texts, by the vocabulary of a byte-level tokenizer file.

    Merges run in the order of the ids, so the file's vocabulary serves as ranks; this gives the
    ids that the tokenizers library gives, several times faster. A special token in a text is one id, as there.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in self.special}
        self.whole, self.plain, self.run = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("whole", PATTERN), ("plain", PLAIN_PATTERN), ("run", r"\s+"))
        )

    def encode(self, text: str) -> array:
        out = array("I")
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self._add(part, out)
        return out

    def _add(self, text: str, out: array) -> None:
        """The ids of a text without special tokens.

        A run of white space is one token but for its last character, which goes with what follows.
        """
        if not WHITE_RUN.search(text):
            out.extend(self.plain.encode_ordinary(text))
            return
        at = 0
        for m in LONG_RUN.finditer(text):
            out.extend(self.whole.encode_ordinary(text[at : m.start()]))
            at = m.end() if m.end() == len(text) else m.end() - 1
            out.extend(self.run.encode_ordinary(text[m.start() : at]))
        out.extend(self.whole.encode_ordinary(text[at:]))


class LevelArray:
    """Open windows by fill, and the choice of the next one."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows at each fill; none at 0 and at size
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, piece: tuple, length: int) -> list | None:
        """Put ``piece`` into a window; the window, if that filled it.

        Moving a window from level h to h + length changes the sum of squares by
        2 (N[h + length] - N[h]) + 2; a full window leaves the array. A new window changes it by
        2 N[length] + 1. Ties go to the fuller window.
        """
        levels = self.count[1 : self.size - length + 1]
        change = np.where(levels > 0, 2 * (self.count[1 + length : self.size + 1] - levels) + 2, 1 << 40)
        if len(levels):
            change[-1] = change[-1] - 1 if levels[-1] else change[-1]  # it fills: 1 - 2 N[h]
        at = len(change) - 1 - int(change[::-1].argmin()) if len(change) else -1
        if at >= 0 and change[at] <= 2 * self.count[length] + 1:
            level = at + 1
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            level, window = 0, []
        window.append((piece, length))
        if level + length == self.size:
            return window
        self.open[level + length].append(window)
        self.count[level + length] += 1
        return None

    def rest(self) -> Iterator[list]:
        """Close all open windows: fill the fullest ones by cutting up the emptiest."""
        windows = [(level, w) for level in range(self.size, 0, -1) for w in self.open[level]]
        spare: list = []
        while windows:
            fill, window = windows.pop(0)
            while fill < self.size and (spare or windows):
                if not spare:
                    spare = windows.pop()[1]
                (doc, start), length = spare.pop()
                taken = min(length, self.size - fill)
                window.append(((doc, start), taken))
                fill += taken
                if taken < length:
                    spare.append(((doc, start + taken), length - taken))
            if fill == self.size:
                yield window
            else:
                yield from _powers(window, fill)
        if spare:
            yield from _powers(spare, sum(length for _, length in spare))


def _powers(window: list, fill: int) -> Iterator[list]:
    """A partial window as windows whose lengths are powers of two."""
    pieces = list(reversed(window))
    while fill:
        size, part = 1 << (fill.bit_length() - 1), []
        fill -= size
        while size:
            (doc, start), length = pieces.pop()
            taken = min(length, size)
            part.append(((doc, start), taken))
            size -= taken
            if taken < length:
                pieces.append(((doc, start + taken), length - taken))
        yield part


def pack(documents: Iterator[tuple], size: int = WINDOW) -> Iterator[tuple]:
    """Pieces ``(doc_id, start, length, crc, doc_tokens, sequence, offset)`` from ``(doc_id, ids)``."""
    levels, sequence = LevelArray(size), 0
    waiting: dict[int, tuple] = {}  # documents with a piece in an open window

    def written(window: list, keep: bool) -> Iterator[tuple]:
        offset = 0
        for (key, start), length in window:
            doc_id, ids, base, total = waiting[key] if keep else waiting.pop(key)
            part = ids[start - base : start - base + length]
            yield doc_id, start, length, zlib.crc32(part.tobytes()), total, sequence, offset
            offset += length

    for key, (doc_id, ids) in enumerate(documents):
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), sequence, 0
            sequence += 1
        if whole < len(ids):
            waiting[key] = (doc_id, ids[whole:].copy(), whole, len(ids))
            full = levels.place((key, whole), len(ids) - whole)
            if full:
                yield from written(full, keep=False)
                sequence += 1
    for window in levels.rest():
        yield from written(window, keep=True)
        sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = WINDOW) -> DataFrame:
    """One row per piece. ``vocabulary``: path of a tokenizer file that every executor has."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tokens = Tokens(vocabulary or public_tokenizers.path(VOCABULARY))
        first = TaskContext.get().partitionId() << TASK_BITS
        doc_type = pa.int64()

        def documents() -> Iterator[tuple]:
            nonlocal doc_type
            for part in slices(batches):
                doc_type = part.schema.field("doc_id").type
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = tokens.encode(text or "")
                    ids.append(END)
                    yield doc_id, np.frombuffer(ids, np.uint32).astype("<u4", copy=False)

        rows: list[tuple] = []
        for piece in pack(documents(), size):
            rows.append((*piece[:5], piece[5] + first, piece[6]))
            if len(rows) == 4096:
                yield _batch(rows, doc_type)
                rows = []
        if rows:
            yield _batch(rows, doc_type)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind=kind))


def _batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], doc_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
