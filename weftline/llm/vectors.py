"""Vectors as arrays of integers: validity, scaling, and exact inner products in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Integer components beyond this, either way, count as this, so that sums of products stay within 64 bits.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def integers(rows: DataFrame, scale: int, vector: str = "embedding", **columns: Column | str) -> DataFrame:
    """(columns..., x): rows with a finite vector, x the floor of each component times ``scale``."""
    v = quoted(vector)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return rows.filter(finite(v)).select(*[(quoted(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()], x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return values.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of every row of ``a`` with every row of ``b``, exact: in floating point while all sums stay below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
