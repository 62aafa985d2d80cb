"""Long tables of numbers summed over all tasks, packed in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
TREE = 256  # tables of tasks that one task adds up at most, up to its square of tasks
SCHEMA = "name string, block int, cells binary"


def packed(name: str, table: np.ndarray) -> pa.RecordBatch:
    """A task's table as rows of one block each; blocks of zeros are left out. Mostly small numbers compress well."""
    blocks = [(i, table[s : s + BLOCK]) for i, s in enumerate(range(0, len(table), BLOCK))]
    blocks = [(i, pa.compress(b.astype("<i8").tobytes(), "zstd", asbytes=True)) for i, b in blocks if b.any()]
    columns = [pa.array([name] * len(blocks), pa.string()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["name", "block", "cells"])


def _opened(held: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(held, size * 8, "zstd", asbytes=True), "<i8")


def summed(tables: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The sums of the tasks' tables by name, on the driver; ``sizes`` are their lengths."""

    def width(name: str, block: int) -> int:
        return min(BLOCK, sizes[name] - block * BLOCK)

    def add(part: pa.Table) -> pa.Table:
        name, block = part.column("name")[0].as_py(), part.column("block")[0].as_py()
        total = np.zeros(width(name, block), np.int64)
        for held in part.column("cells").to_pylist():
            total += _opened(held, len(total))
        cells = pa.compress(total.tobytes(), "zstd", asbytes=True)
        return pa.table([pa.array([name]), pa.array([block], pa.int32()), pa.array([cells], pa.binary())], ["name", "block", "cells"])

    some = tables.withColumn("node", F.spark_partition_id() % TREE)
    merged = some.groupBy("name", "block", "node").applyInArrow(add, SCHEMA).groupBy("name", "block").applyInArrow(add, SCHEMA)
    out = {name: np.zeros(size, np.int64) for name, size in sizes.items()}
    for name, block, held in merged.collect():
        out[name][block * BLOCK : (block + 1) * BLOCK] = _opened(held, width(name, block))
    return out


class IdFilter:
    """Which ids may be among some: bits by hash, sixteen for each id. One that is among them is never told apart."""

    MOST = 1 << 30

    def __init__(self, ids: DataFrame, column: str):
        many = ids.count()
        self.size = max(1 << 10, min(16 * many, self.MOST))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(self.size, np.int8)
            for batch in batches:
                table[self._at(batch.column(0))] = 1
            yield packed("ids", table)

        size = self.size
        marked = ids.select(F.xxhash64(F.col(column).cast("string")).alias("h")).mapInArrow(mark, SCHEMA)
        self.bits = np.packbits(summed(marked, {"ids": size})["ids"] > 0)

    def _at(self, hashes: pa.Array) -> np.ndarray:
        return (hashes.to_numpy().view(np.uint64) % np.uint64(self.size)).astype(np.int64)

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose id may be among them; no row moves."""

        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self._at(batch.column("__hash"))
                may = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                yield batch.select(names).filter(pa.array(may.astype(bool)))

        return rows.withColumn("__hash", F.xxhash64(F.col(column).cast("string"))).mapInArrow(run, rows.schema)
