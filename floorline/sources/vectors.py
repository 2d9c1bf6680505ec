"""Caches of vectors kept as NumPy files, read by Arrow batches."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

VECTORS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]))


def _rows(content: bytes) -> list[tuple[str | None, list[float]]]:
    """Rows of a .npy matrix, or of an .npz of keys `sid` and vectors `X`; halves come back as single precision."""
    held = np.load(io.BytesIO(content), allow_pickle=False)
    keys, matrix = (held["sid"], held["X"]) if isinstance(held, np.lib.npyio.NpzFile) else (None, held)
    matrix = np.atleast_2d(matrix).astype(np.float32)
    return [(None if keys is None else str(keys[i]), row.tolist()) for i, row in enumerate(matrix)]


@F.pandas_udf(VECTORS)
def unpacked(content: pd.Series) -> pd.Series:
    return pd.Series([_rows(c) for c in content])


def read_vectors(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """file, i, key, vector of every row of the NumPy files under a folder; a file is one task's value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("file"), F.posexplode(unpacked("content")).alias("i", "r"))
    return rows.select("file", "i", "r.key", "r.vector")


def half(value: str | F.Column) -> F.Column:
    """An array rounded to half precision, as thresholds act on cached values."""
    return _half(F.col(value) if isinstance(value, str) else value)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _half(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32).tolist())


def joined_by_key(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """rows with the cache's columns by key, never by position; a row without a cached one, or a repeated cached key, fails the job."""
    marked = cache.groupBy(key).agg(*[F.any_value(c).alias(c) for c in cache.columns if c != key], F.count("*").alias("__times"))
    found = rows.join(marked, key, "left")
    bad = F.raise_error(F.concat(F.lit("the cache holds not one row for "), F.col(key).cast("string"))).cast("boolean")
    return found.where(F.when(F.col("__times") == 1, F.lit(True)).otherwise(bad)).drop("__times")
