"""Result columns in a form every SQL engine prints alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def cell(value: Column) -> Column:
    """A number as text of its millionths, ``_`` for NULL."""
    return F.coalesce(F.round(value * 1_000_000).cast("long").cast("string"), F.lit("_"))


def matrix_text(matrix: Column | str = "matrix") -> Column:
    """``step;step`` with ``cell,cell`` inside."""
    return F.array_join(F.transform(matrix, lambda row: F.array_join(F.transform(row, cell), ",")), ";")


def with_matrix_text(df: DataFrame) -> DataFrame:
    """The matrix as its :func:`matrix_text`, made of whole Arrow batches."""

    def joined(lists: pa.ListArray, texts: pa.Array, by: str) -> pa.Array:
        """The texts of each list in one, without the NULL ones; NULL for a NULL list."""
        offsets = lists.offsets.to_numpy()
        offsets = np.r_[0, np.cumsum(np.asarray(texts.is_valid()))][offsets - offsets[0]].astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts.drop_null(), mask=lists.is_null()), by)

    def row_texts(rows: pa.ListArray) -> pa.Array:
        cells = rows.flatten()
        present = np.asarray(cells.is_valid())
        value = cells.to_numpy(zero_copy_only=False)[present] * 1_000_000
        size = np.abs(value)
        low = np.floor(size)
        # halves go away from zero, as in :func:`cell`
        whole = pa.array(np.copysign(low + (size - low >= 0.5), value)).cast(pa.int64()).cast(pa.string())
        return joined(rows, whole.take(pa.array(np.cumsum(present) - 1, mask=~present)).fill_null("_"), ",")

    def text(matrices: pa.ListArray) -> pa.Array:
        rows = matrices.flatten()
        # most steps of a long window have no value at all; one text for each length serves them
        offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        values = np.r_[0, np.cumsum(np.asarray(rows.flatten().is_valid()))][offsets]
        blank = (np.diff(values) == 0) & np.asarray(rows.is_valid())
        sizes, which = np.unique(np.diff(offsets)[blank], return_inverse=True)
        dashes = pa.array([",".join("_" * n) for n in sizes.tolist()], pa.string())
        at = np.cumsum(~blank) - 1
        at[blank] = len(rows) - len(which) + which
        texts = pa.concat_arrays([row_texts(rows.filter(pa.array(~blank))), dashes]).take(pa.array(at))
        return joined(matrices, texts, ";")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [text(c) if n == "matrix" else c for n, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "matrix" else f for f in df.schema.fields])
    return df.withColumn("matrix", F.col("matrix").cast("array<array<double>>")).mapInArrow(written, schema)


def vector_text(vector: Column | str = "vector") -> Column:
    return F.array_join(F.transform(vector, cell), ",")


def shown(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, dates and times as text.

    A ``nudge`` far below the last digit makes exact ties round alike whatever the order
    of summation was.
    """
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + nudge if nudge else c, DIGITS)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def coded(df: DataFrame) -> DataFrame:
    """Samples with the matrix as the md5 digest of its text: every value counts, rows stay small."""
    return shown(with_matrix_text(df).withColumn("matrix", F.md5("matrix")))
