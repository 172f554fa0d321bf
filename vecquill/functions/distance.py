"""Squared L2 and inner product, as columns and for single numpy vectors.

Columns accumulate in double, so that results do not depend on the order of
partitions and agree with SQL engines to the last digits that matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNEQUAL = "a and b must have the same length"


def _as_column(v) -> Column:
    """A column, a column's name, or a constant vector."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(np.float32(x))) for x in np.asarray(v).tolist()])


def _folded(a, b, each) -> Column:
    a, b = _as_column(a).cast("array<double>"), _as_column(b).cast("array<double>")
    total = F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)
    # zip_with would fill the shorter side with nulls
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit(_UNEQUAL)).cast("double"))


def l2_sqr(a, b) -> Column:
    """Σ(aᵢ-bᵢ)² of two array columns, or of one and a constant vector. Null
    if either is null; arrays of unequal length are an error."""
    return _folded(a, b, lambda x, y: (x - y) * (x - y))


def dot(a, b) -> Column:
    """Σaᵢbᵢ; nulls and lengths as for ``l2_sqr``."""
    return _folded(a, b, lambda x, y: x * y)


def _two(a, b) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if a.ndim != 1 or b.ndim != 1:
        raise RuntimeError("a and b must be 1-D float32 arrays")
    if len(a) != len(b):
        raise RuntimeError(_UNEQUAL)
    return a.astype(np.float64), b.astype(np.float64)


def l2_sqr_value(a, b) -> float:
    """Squared L2 of two vectors on the driver."""
    a, b = _two(a, b)
    return float(((a - b) ** 2).sum())


def dot_value(a, b) -> float:
    a, b = _two(a, b)
    return float(a @ b)


def _rows(a, b, paired: bool) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if a.ndim != 2 or b.ndim != (2 if paired else 1):
        raise RuntimeError("a and b must be 2-D float32 arrays" if paired else "a must be a 2-D and b a 1-D float32 array")
    if a.shape[1] != b.shape[-1] or paired and len(a) != len(b):
        raise RuntimeError(_UNEQUAL)
    return a.astype(np.float64), b.astype(np.float64)


def l2_sqr_batch(a, b) -> np.ndarray:
    """Squared L2 of the paired rows of two matrices on the driver."""
    a, b = _rows(a, b, True)
    return ((a - b) ** 2).sum(1)


def l2_sqr_mat_vec(a, v) -> np.ndarray:
    a, v = _rows(a, v, False)
    return ((a - v) ** 2).sum(1)


def dot_batch(a, b) -> np.ndarray:
    a, b = _rows(a, b, True)
    return (a * b).sum(1)


def dot_mat_vec(a, v) -> np.ndarray:
    a, v = _rows(a, v, False)
    return a @ v
