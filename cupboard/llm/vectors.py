"""Integer vectors from embedding columns, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this bound the sum of products of integers held as doubles may be rounded.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """The vector is neither NULL nor empty and holds finite numbers only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry as a 64-bit integer (saturated at its ends)."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def of_usual_length(rows: DataFrame, column: str = "x") -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length (ties: the longer), and that length; 0 for no rows."""
    size = F.size(column)
    usual = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(size == usual["d"]), usual["d"]) if usual else (rows, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)
