"""Checks of vector rows, as predicates and as errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest absolute value of a component; keeps squared distances finite.
LARGEST = 1e16

ROWS = T.StructType([T.StructField("external_id", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])


def in_range(vec: str | Column) -> Column:
    """True if no component is null, NaN or beyond ±1e16 (Spark orders NaN
    above all numbers); null vectors give null."""
    return F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) <= F.lit(LARGEST)))


def has_dim(vec: str | Column, dim: int) -> Column:
    return F.size(vec) == dim


def valid(vec: str, dim: int) -> Column:
    return F.coalesce(F.col(vec).isNotNull() & has_dim(vec, dim) & in_range(vec), F.lit(False))


def bad_reason(dim: int) -> Column:
    """Why ingest refuses a row (external_id, vec); null if it doesn't."""
    return F.when(F.col("external_id").isNull(), "missing id").when(F.col("vec").isNull() | (F.size("vec") != dim), "dimension mismatch").when(~F.coalesce(in_range("vec"), F.lit(False)), "NaN/Inf")


def bad_rows(df: DataFrame, dim: int) -> DataFrame:
    """Rows that ingest refuses, with the reason."""
    return df.withColumn("reason", bad_reason(dim)).where(F.col("reason").isNotNull())


def repeated_ids(df: DataFrame, *ids: str) -> DataFrame:
    """Ids (``external_id`` if none is named) that occur more than once;
    counts are combined before the shuffle."""
    return df.groupBy(*(ids or ("external_id",))).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_vector(vec, dim: int, what: str) -> np.ndarray:
    """One vector as float32, with the errors of the row interface."""
    v = np.asarray(vec)
    if v.ndim != 1:
        raise RuntimeError(f"{'vec' if what == 'ingest' else 'q'} must be 1-D float32")
    v = v.astype(np.float32)
    if len(v) != dim:
        raise RuntimeError(f"{what}: dimension mismatch")
    if what == "ingest":
        bad = np.flatnonzero(~(np.abs(v) <= np.float32(LARGEST)))
        if len(bad):
            raise RuntimeError(f"ingest: vector contains NaN/Inf at index {bad[0]}")
    return v
