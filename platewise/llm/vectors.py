"""Vector columns as matrices: the rows that can be used, and Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_col: str, scale: float, keep: list[str]) -> tuple[DataFrame, int, int]:
    """(rows with the columns ``keep`` and ``vec`` as array<double>, their count, their length).

    A vector is usable if neither it nor an entry is null, every entry times ``scale`` is finite
    and within 62 bits, and its length is the most common one of such vectors (ties: the longer).
    """
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= F.lit(2.0 ** 62)))
    d = (vectors.select(*keep, F.col(vec_col).cast("array<double>").alias("vec"))
         .filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(v) > 0)))
    top = d.groupBy(F.size("vec").alias("dim")).count().agg(F.max(F.struct("count", "dim")).alias("m")).first()["m"]
    if top is None:
        return d.limit(0), 0, 0
    return d.filter(F.size("vec") == top["dim"]), top["count"], top["dim"]


def matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column; NaN becomes null."""
    n, dim = rows.shape
    flat = pa.array(rows.ravel(), kind, from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), flat)


def scaled_floor(vec: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * entry) as int64; the scale is a power of two, so the product is exact."""
    return np.floor(vec * scale).astype(np.int64)
