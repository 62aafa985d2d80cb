"""Words of many texts at once, found on the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from onsetframe.llm.texts import slices, utf8

# bytes of text that one step turns into arrays
SEGMENT = 4 << 20
INSIDE, GAP, BREAK = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_kinds(gaps: bytes, breaks: bytes) -> np.ndarray:
    """Kind of each byte: inside a word, between words, or the end of a piece."""
    kinds = np.full(256, INSIDE, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    distinct: pa.Array  # binary, A-Z in lower case
    ids: np.ndarray  # position of each word in ``distinct``
    piece: np.ndarray  # words of one piece share a number, texts share none
    row: np.ndarray  # row of the batch the word is from


def words_of(data: bytes, rows: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> Words:
    """``data`` holds texts one line break apart; text ``i`` begins at ``starts[i]`` and is row ``rows[i]``."""
    raw = np.frombuffer(data, np.uint8)
    kind = kinds[raw]
    inside = kind == INSIDE
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    body = LOWER[raw[inside]]
    column = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
    of = np.searchsorted(starts, begin, side="right") - 1
    return Words(column.dictionary, column.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, rows[of])


def segments(batch: pa.RecordBatch, kinds: np.ndarray, size: int = SEGMENT) -> Iterator[Words]:
    """The words of a batch, some ``size`` bytes of text at a time.

    A text longer than that is cut after the end of a piece; line breaks must end one.
    """
    held: list[bytes] = []
    rows: list[int] = []
    total = 0

    def flush() -> Words:
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        return words_of(b"\n".join(held), np.array(rows), starts, kinds)

    texts = (x for part in slices([batch]) for x in utf8(part))
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > 2 * size:
                stop = _cut(text, at, size, kinds)
            held.append(text[at:stop])
            rows.append(row)
            total += stop - at
            at = stop
            if total >= size:
                yield flush()
                held, rows, total = [], [], 0
    if held:
        yield flush()


def _cut(text: bytes, at: int, size: int, kinds: np.ndarray) -> int:
    """Just after the last end of a piece within ``size`` bytes, else after the first one beyond them."""
    ends = np.flatnonzero(kinds[np.frombuffer(text, np.uint8, size, at)] == BREAK)
    if len(ends):
        return at + int(ends[-1]) + 1
    for start in range(at + size, len(text), size):
        ends = np.flatnonzero(kinds[np.frombuffer(text, np.uint8, min(size, len(text) - start), start)] == BREAK)
        if len(ends):
            return start + int(ends[0]) + 1
    return len(text)
