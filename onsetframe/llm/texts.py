"""Helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

# texts taken from an Arrow batch at a time, so that Python objects of one slice exist at once
SLICE = 256
SPACES = b" \t\n\x0b\x0c\r"


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
