"""Columns and arrays for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is not null, not zero and free of null and non-finite components."""
    number = lambda x: x.cast("double")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) != F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def by_length(batch: pa.RecordBatch, name: str) -> list[pa.RecordBatch]:
    """The batch split into batches whose lists have one length."""
    lengths = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
    return [batch.filter(pa.array(lengths == n)) for n in np.unique(lengths)]
