"""Arrow helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors, for which axes and pivots are fitted; 0 if there are none."""
    sizes = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    best = sizes.orderBy(F.col("rows").desc(), "n").first()
    return best["n"] if best else 0


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all components one after another as float64, boundaries by row); a null vector has none, a null component is NaN."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    length = np.asarray(column.value_lengths().fill_null(0)) if n else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(length)))


def usable(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors have a component and only finite ones, which of all have one that is not zero)."""
    values, edges = ragged(column)
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))
    bad, some = upto(~np.isfinite(values)), upto(values != 0)
    return (np.diff(edges) > 0) & (bad[edges[1:]] == bad[edges[:-1]]), some[edges[1:]] > some[edges[:-1]]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have `dim` components, all finite; these as a float64 matrix)."""
    values, edges = ragged(column)
    fine = (np.diff(edges) == dim) & (dim > 0)
    rows = values[edges[:-1][fine][:, None] + np.arange(dim)[None, :]] if fine.any() else np.zeros((0, dim))
    ok = np.isfinite(rows).all(axis=1)
    fine[np.flatnonzero(fine)[~ok]] = False
    return fine, rows[ok]


def finite(column: str) -> Column:
    """Whether a vector is there, not empty, and holds neither null nor non-finite components."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(column) > 0) & F.forall(F.col(column), good), F.lit(False))


def shape(vectors: DataFrame, column: str) -> tuple[int, int, float]:
    """(commonest length, rows of that length, largest absolute component) of vectors that are `finite`; zeros if there are none."""
    peak = F.max(F.array_max(F.transform(column, lambda c: F.abs(c.cast("double")))))
    sizes = vectors.groupBy(F.size(column).alias("n")).agg(F.count(F.lit(1)).alias("rows"), peak.alias("peak"))
    best = sizes.orderBy(F.col("rows").desc(), "n").first()
    return (best["n"], best["rows"], best["peak"]) if best else (0, 0, 0.0)
