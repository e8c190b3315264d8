"""Operator 12: whitening of embeddings by their principal components.

Components become integers, so that sums and centred rows are exact.  The Gram matrix of the centred distinct vectors comes from
MLlib's RowMatrix on the JVM; its small eigenproblem is solved on the driver, and the projection goes to the tasks as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, shape

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
LARGEST = 2**62  # of integers that need no wider type
OUTPUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def gram(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of a column of arrays of doubles, by RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _sums(rows: DataFrame, column: str, kind: str) -> list:
    """Exact sums by dimension of a column of arrays."""
    each = rows.select(F.posexplode(column).alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast(kind)).alias("s"))
    return [r["s"] for r in each.orderBy("i").collect()]  # one number a dimension


class Whitening:
    """What is fitted: n, sums S, axes (dimension by component, divided by the root of their eigenvalue), shares."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int, wide: bool):
        value, axes = np.linalg.eigh(covariance)
        order = np.argsort(-value, kind="stable")[: min(components, len(value))]
        # a direction without spread cannot be brought to spread 1
        order = order[value[order] > len(value) * np.finfo(float).eps * max(value.max(), 0.0)]
        axes = axes[:, order]
        sign = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0) if len(order) else np.ones(0)
        self.n, self.sums, self.wide = n, sums, wide
        self.axes = axes * sign / np.sqrt(value[order])
        self.explained = value[order] / np.trace(covariance) if len(order) else np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return x.astype(object if self.wide else np.int64) * self.n - np.array(self.sums, dtype=object if self.wide else np.int64)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S exactly, the whitened rows)."""
        numerator = self.centred(x)
        return numerator, (numerator.astype(np.float64) / self.n) @ self.axes


def _apply(shared, with_id: bool):
    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fitted: Whitening = shared.value
            if not len(frame):
                continue
            numerator, white = fitted.whitened(np.stack(frame["x"].to_numpy()))
            out = {"whitened": list(white)}
            if with_id:
                large = max(abs(int(numerator.max())), abs(int(numerator.min())))
                exact = numerator if large**2 * numerator.shape[1] < LARGEST else numerator.astype(object)
                far = [int(d) for d in (exact * exact).sum(axis=1)]
                out = {"vec_id": frame["vec_id"], "deviation": [Decimal(d) if d < 10**38 else None for d in far]} | out
            yield pd.DataFrame(out)

    return step


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row on each of the first components.

    A component c of a vector becomes x = floor(64 * c) + 1000000.  The fit list is each distinct x-vector once, n of them with
    sums S; their covariance V has the divisor n.  Components are unit eigenvectors of V by falling eigenvalue e, signed so that their
    largest entry is positive; whitened is x - S/n on the component over sqrt(e), deviation the exact sum of (n*x - S)^2 as decimal(38,0),
    explained e / trace(V), identity_error the largest absolute entry of the whitened fit list's covariance minus the identity.

    Rows whose vector is null, empty, holds null or non-finite components or is not of the commonest length are dropped, as are those with
    components beyond 2**55; repeated rows are fitted once and each returned; a direction without spread (one distinct vector, fewer vectors than
    dimensions) has no rows; other columns of `vectors` are not returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(finite("vector") & F.forall("vector", lambda c: F.abs(c) < 2.0**55))
    dim, total, peak = shape(rows, "vector")
    kept = rows.filter(F.size("vector") == dim)
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    largest = int(peak * SCALE) + SHIFT + 1
    # four bytes a component on disk where they hold it
    fit = kept.select((x.cast("array<int>") if largest < 2**31 else x).alias("x")).distinct().checkpoint() if total else None
    n = fit.count() if total else 0
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"vec_id {id_type}, {OUTPUT}")
    wide = 2 * largest * n >= LARGEST
    kind = "decimal(38,0)" if wide else "long"
    sums = [int(s) for s in _sums(fit, "x", kind)]
    offsets = F.array(*[F.lit(s).cast(kind) for s in sums])
    centred = fit.select(F.transform("x", lambda c, i: (c.cast(kind) * F.lit(n).cast(kind) - F.get(offsets, i)).cast("double") / F.lit(float(n))).alias("row"))
    model = Whitening(n, sums, gram(centred, "row") / n, components, wide)
    if not len(model.explained):
        return spark.createDataFrame([], f"vec_id {id_type}, {OUTPUT}")
    shared = spark.sparkContext.broadcast(model)  # dimension x components numbers
    white = fit.mapInPandas(_apply(shared, False), "whitened array<double>")
    mean = [s / n for s in _sums(white, "whitened", "double")]
    off = white.select(F.transform("whitened", lambda c, i: c - F.get(F.array(*[F.lit(m) for m in mean]), i)).alias("row"))
    error = float(np.abs(gram(off, "row") / n - np.eye(len(mean))).max())
    out = kept.select("vec_id", x.alias("x")).mapInPandas(_apply(shared, True), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Query of the contract; a deviation beyond a long is null."""
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
