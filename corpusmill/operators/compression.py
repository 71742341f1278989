"""Compressibility of texts as a diversity measure."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def _compressed_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(zlib.compress(t.encode("utf-8"))) if t is not None else None).astype("Int64")


def _raw_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _sizes(df: DataFrame, keep: str, text: str) -> DataFrame:
    return df.select(keep, _raw_bytes(F.col(text)).alias("raw"), _compressed_bytes(text).alias("packed"))


def compression_ratio(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Compressed over raw bytes per row; NULL for an empty text."""
    return _sizes(df, key, text).select(key, F.try_divide("packed", "raw").alias("ratio"))


def compression_diversity(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Total compressed over total raw bytes per group."""
    return _sizes(df, by, text).groupBy(by).agg(
        F.try_divide(F.sum("packed"), F.sum("raw")).alias("ratio"), F.count("*").alias("n")
    )
