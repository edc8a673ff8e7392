"""What the operators on vectors share: which rows count, and vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """Whether a vector has components, none of them null, infinite or no number."""
    v = F.col(f"`{vector}`")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of df's vectors, the greatest of such; 0 without rows."""
    top = df.groupBy(F.size(F.col(f"`{vector}`")).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
