"""Vector columns as numpy matrices, and the rows that take part in a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(row long, vec_id long, v array<double>): rows whose vector is whole and finite.

    Left out: null ids, null vectors, vectors with a null or non-finite
    component, and vectors without a component other than 0 if ``nonzero``.
    Vectors shorter than the longest count as followed by zeros. Rows that repeat
    an id are vectors of their own, told apart by row, which holds once the
    result is written. Other columns are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    if nonzero:
        out = out.filter(F.exists("v", lambda x: x != 0))
    size = max(1, out.agg(F.max(F.size("v"))).first()[0] or 0)
    whole = F.when(F.size("v") < size, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))).otherwise(F.col("v"))
    return out.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square over- or underflows."""
    if not rows.size:
        return rows
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))
