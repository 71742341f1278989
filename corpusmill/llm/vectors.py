"""Vector columns: which rows take part, and copies of the same vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def content_key(*columns: Column) -> Column:
    """A 128-bit key of the contents, for grouping equal vectors without moving them twice."""
    return F.struct(F.xxhash64(F.lit(11), *columns).alias("h"), F.xxhash64(F.lit(13), *columns).alias("l"))


def distinct_vectors(rows: DataFrame, key: str, vector: str, id_col: str) -> DataFrame:
    """(key, ``node``, ``copies``, vector) of each different vector: its smallest id, its number of rows."""
    return rows.groupBy(key).agg(
        F.min(id_col).alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value(vector).alias(vector)
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists all have the same length, as float64 rows."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
