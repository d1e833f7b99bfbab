"""Rows with a usable vector, and their vectors as whole numbers; shared by the operators on integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the array is not null and all its components are finite numbers."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the arrays, the smaller of two as frequent ones; 0 without rows."""
    n = rows.groupBy(F.size(vector).alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    return n["n"] if n else 0


def with_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """((id, label, vector as doubles) of the rows with a finite vector of the usual length, that length)."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    x = x.filter(finite("vector"))
    dim = usual_length(x, "vector")
    return x.filter(F.size("vector") == dim), dim


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, components) of an Arrow column of arrays of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def floors(x: np.ndarray, scale: int, bits: int) -> np.ndarray:
    """``floor(scale * x)`` as int64, held within ``bits`` bits (so that no sum of products passes 63)."""
    limit = float(1 << bits)
    return np.clip(np.floor(x * scale), -limit, limit).astype(np.int64)
