"""Vector search and centroids over embedding columns.

Exact scores of many against many come tile by tile: both sides are cut into tiles of a bounded number of rows, pairs of tiles meet by an
equi-join of their numbers, and a pair of tiles is one product of matrices, of which each row keeps its best.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, BITS, SEED = 8, 10, 42
PROBED = 0.36  # share of all (table, bucket) that a query asks, nearest first
VOTES = 4  # tables that must hold a candidate in an asked bucket: with PROBED, recall of the top 5 on sf0.1 is 0.95 at 32 % of all rows
EXACT_BELOW = 1 << BITS  # rows of a table that is always searched in full: its buckets would hold less than a row each
TILE = 8192  # rows of a tile; a tile of 1,000 dimensions is 64 MB
CLOSE = 1e-9  # products of matrices are that exact at least; what is closer to the last place is scored once more, pair by pair


def _tiled(x: DataFrame, own: str, other: str, tiles: int, others: int) -> DataFrame:
    """Each row once for every tile of the other side."""
    mine = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    return x.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


class _Side:
    """Vectors of a tile by length, divided by their norms; a zero vector stays zero."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        length = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        edge = np.concatenate(([0], np.cumsum(length)))
        self.n, self.rows, self.units = len(length), {}, {}
        odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        self.odd = odd[edge[1:]] > odd[edge[:-1]]  # components that are not finite
        for d in np.unique(length[length > 0]):
            rows = np.flatnonzero(length == d)
            x = flat[edge[rows][:, None] + np.arange(d)]
            x[self.odd[rows]] = 0.0
            norm = np.sqrt((x * x).sum(axis=1))
            self.rows[d], self.units[d] = rows, x / np.where(norm > 0, norm, 1.0)[:, None]
        self.length, self.place = length, np.zeros(len(length), np.int64)
        for rows in self.rows.values():
            self.place[rows] = np.arange(len(rows))

    def products(self, other: _Side, some: np.ndarray) -> np.ndarray:
        """Cosines of some of these rows with all of the other side; 0 between vectors of different lengths."""
        out = np.zeros((len(some), other.n))
        for d, rows in other.rows.items():
            mine = np.flatnonzero(self.length[some] == d)
            if len(mine):
                out[np.ix_(mine, rows)] = self.units[d][self.place[some[mine]]] @ other.units[d].T
        return out

    def scores(self, i: np.ndarray, other: _Side, j: np.ndarray) -> np.ndarray:
        """Cosines of pairs of rows, the same for the same two vectors wherever they are."""
        out = np.zeros(len(i))
        for d in self.rows:
            both = np.flatnonzero((self.length[i] == d) & (other.length[j] == d))
            if len(both):
                out[both] = (self.units[d][self.place[i[both]]] * other.units[d][other.place[j[both]]]).sum(axis=1)
        return out


def best_matches(left: DataFrame, right: DataFrame, k: int, threshold: float, over: bool = False, one_kind: bool = True) -> DataFrame:
    """(id, other, c): for each row of `left` (id, embedding) the k rows of `right` (id, embedding) of largest cosine, at least `threshold`
    (over: above it); where ids are of `one_kind`, a row does not match its own; ties go to the smaller id.

    The cosine of vectors of different length, empty, zero or null is 0; vectors with components that are not finite match nothing.
    """
    tiles = [max(1, math.ceil(x.count() / TILE)) for x in (left, right)]
    a = _tiled(left.select("id", "embedding"), "a", "b", tiles[0], tiles[1])
    b = _tiled(right.select(F.col("id").alias("id"), F.col("embedding").alias("embedding")), "b", "a", tiles[1], tiles[0])
    kinds = [x.schema["id"].dataType.simpleString() for x in (left, right)]

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, other = _Side(ours["embedding"]), _Side(theirs["embedding"])
        names, found = ours["id"].to_pylist(), theirs["id"].to_pylist()
        at = {}
        for j, name in enumerate(found if one_kind else ()):
            at.setdefault(name, []).append(j)
        rows, columns, values = [], [], []
        step = max(1, (1 << 22) // max(1, len(found)))
        for low in range(0, len(names), step) if found else ():
            some = np.arange(low, min(low + step, len(names)))
            c = mine.products(other, some)
            for i in some:
                c[i - low, at.get(names[i], [])] = -np.inf
            c[mine.odd[some]] = -np.inf
            c[:, other.odd] = -np.inf
            kth = np.partition(c, -k, axis=1)[:, -k] if k < c.shape[1] else np.full(len(some), -np.inf)
            i, j = np.nonzero((c >= np.maximum(kth, threshold)[:, None] - CLOSE) & np.isfinite(c))
            exact = mine.scores(some[i], other, j)
            keep = exact > threshold if over else exact >= threshold
            rows, columns, values = rows + [some[i[keep]]], columns + [j[keep]], values + [exact[keep]]
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns))
        take = lambda table, at: table["id"].take(pa.array(at, pa.int64()))
        return pa.table({"id": take(ours, i), "other": take(theirs, j), "c": pa.array(np.concatenate(values) if values else np.zeros(0))})

    met = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(meet, f"id {kinds[0]}, other {kinds[1]}, c double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("c").desc(), "other"))
    return met.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k rows of largest cosine (at least `threshold`) for each query, from all rows."""
    met = best_matches(queries, vectors, k, threshold)
    return met.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("id"), F.round("c", 6).alias("similarity"))


def _planes(dim: int, seed: int) -> np.ndarray:
    rng = random.Random(seed)
    return np.array([[rng.gauss(0, 1) for _ in range(dim)] for _ in range(TABLES * BITS)]).T


def _sides(vector: Column, dim: int, centre: list[float], seed: int, kind: str, of: object) -> Column:
    """An array made from the signed distances to all planes of each vector of `dim` finite components; null for others."""
    planes, mean = _planes(dim, seed), np.asarray(centre)

    @F.pandas_udf(kind)
    def made(vectors: pd.Series) -> pd.Series:
        fits = [v is not None and len(v) == dim and bool(np.isfinite(np.asarray(v, dtype=float)).all()) for v in vectors]
        out = pd.Series([None] * len(vectors), dtype=object)
        if any(fits):
            far = (np.stack([np.asarray(v, dtype=float) for v, ok in zip(vectors, fits, strict=True) if ok]) - mean) @ planes
            out[np.flatnonzero(fits)] = list(of(far.reshape(-1, TABLES, BITS)))
        return out

    return made(vector)


def _buckets(far: np.ndarray) -> np.ndarray:
    return ((far > 0) @ (1 << np.arange(BITS)) + (np.arange(TABLES) << BITS)).astype(np.int32)


def bucket_columns(vector: Column, dim: int, seed: int = SEED, centre: list[float] | None = None) -> Column:
    """Array of TABLES bucket numbers: the signs of BITS random projections each, about `centre`; null for a vector of another length."""
    return _sides(vector, dim, centre or [0.0] * dim, seed, "array<int>", _buckets)


def asked_buckets(vector: Column, dim: int, share: float, seed: int = SEED, centre: list[float] | None = None) -> Column:
    """The buckets that a query asks: its own of each table, and of all others the `share` that is reached by crossing the nearest planes."""
    masks = np.arange(1 << BITS)
    crossed = ((masks[:, None] >> np.arange(BITS)) & 1).astype(float)

    def of(far: np.ndarray) -> list[np.ndarray]:
        own, out = _buckets(far), []
        for numbers, cost in zip(own, (far * far) @ crossed.T, strict=True):  # cost by table and mask: squared distances to the planes crossed
            cost = cost.ravel()
            some = np.union1d(np.argsort(cost, kind="stable")[: int(share * cost.size)], np.arange(TABLES) << BITS)
            out.append((numbers[some >> BITS] ^ (some & (masks.size - 1))).astype(np.int32))
        return out

    return _sides(vector, dim, centre or [0.0] * dim, seed, "array<int>", of)


def _centre(vectors: DataFrame, dim: int) -> list[float]:
    """Mean of the vectors of that length; one number a dimension."""
    sums = vectors.filter(F.size("embedding") == dim).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return [r["m"] if r["m"] is not None and math.isfinite(r["m"]) else 0.0 for r in sums.orderBy("i").collect()] or [0.0] * dim


def candidates(vectors: DataFrame, queries: DataFrame, dim: int, probe: float = PROBED, votes: int = VOTES) -> DataFrame:
    """(query_id, id): rows that VOTES tables at least hold in a bucket that the query asks; an equi-join of buckets and a count."""
    centre = _centre(vectors, dim)
    rows = vectors.select("id", F.explode(bucket_columns(F.col("embedding"), dim, centre=centre)).alias("bucket"))
    asked = queries.select(F.col("id").alias("query_id"), F.explode(asked_buckets(F.col("embedding"), dim, probe, centre=centre)).alias("bucket"))
    met = rows.join(asked, "bucket").filter(F.col("id") != F.col("query_id"))
    return met.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= votes).select("query_id", "id")


def nearest_lsh(vectors: DataFrame, queries: DataFrame, k: int, dim: int, probe: float = PROBED) -> DataFrame:
    """Approximate k nearest by cosine: rows that share asked buckets with the query (see candidates()), ranked exactly.

    A tile of rows meets a tile of queries as matrices: votes are counted and candidates scored where they are found, so that no pair is a row
    and each query gives on its best k of a tile alone.  All rows are searched for a query of fewer than 3k candidates, and for every
    query of a table under EXACT_BELOW rows.  Rows without a vector take no part, nor do those of another length than `dim` among candidates.
    """
    rows, asked = vectors.filter("embedding is not null").select("id", "embedding"), queries.filter("embedding is not null").select("id", "embedding")
    size = rows.count()
    if size < EXACT_BELOW:
        return nearest(rows, asked, k, -2.0)
    tiles = [max(1, math.ceil(n / TILE)) for n in (size, asked.count())]
    centre = _centre(rows, dim)
    a = _tiled(rows.withColumn("buckets", bucket_columns(F.col("embedding"), dim, centre=centre)).filter("buckets is not null"), "a", "b", *tiles)
    b = _tiled(asked.withColumn("buckets", asked_buckets(F.col("embedding"), dim, probe, centre=centre)).filter("buckets is not null"), "b", "a", *tiles[::-1])
    kinds = [x.schema["id"].dataType.simpleString() for x in (asked, rows)]

    def score(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, other = _Side(ours["embedding"]), _Side(theirs["embedding"])
        names, found = ours["id"].to_pylist(), theirs["id"].to_pylist()
        at = {}
        for i, name in enumerate(names):
            at.setdefault(name, []).append(i)
        held = np.array(ours["buckets"].to_pylist(), np.int64).reshape(-1, TABLES).T
        asks = theirs["buckets"].to_pylist()
        rows_, columns, values, counts = [], [], [], []
        step = max(1, (1 << 22) // max(1, len(names)))
        for low in range(0, len(found), step) if names else ():
            some = np.arange(low, min(low + step, len(found)))
            c = other.products(mine, some)
            for q in some:
                is_asked = np.zeros(TABLES << BITS, np.uint8)
                is_asked[asks[q]] = 1
                votes = sum(is_asked[h] for h in held)
                votes[at.get(found[q], [])] = 0
                i = np.flatnonzero(votes >= VOTES)
                counts.append(len(i))
                near = c[q - low, i]
                i = i[near >= np.partition(near, -k)[-k] - CLOSE] if len(i) > k else i
                rows_, columns = rows_ + [i], columns + [np.full(len(i), q)]
        i, q = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows_, columns))
        values = other.scores(q, mine, i)
        take = lambda table, at: table["id"].take(pa.array(at, pa.int64()))
        many = np.array(counts, np.int64)[q] if len(q) else np.zeros(0, np.int64)
        return pa.table({"query_id": take(theirs, q), "id": take(ours, i), "c": pa.array(values), "a": pa.array(np.full(len(q), ours["a"][0].as_py() if len(q) else 0, np.int32)), "n": pa.array(many)})

    met = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, c double, a int, n long").checkpoint()
    enough = met.groupBy("query_id", "a").agg(F.max("n").alias("n")).groupBy("query_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= 3 * k).select("query_id")
    few = asked.join(enough, F.col("id") == F.col("query_id"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("c").desc(), "id"))
    near = met.join(enough, "query_id", "left_semi").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("c", 6).alias("similarity"))
    return near.unionByName(nearest(rows, few, k, -2.0))


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster_id, centroid, members): mean vector of each cluster, by partial sums for each dimension."""
    x = vectors.select("cluster_id", F.posexplode("embedding").alias("pos", "x"))
    mean = x.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    parts = mean.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"), F.max("n").alias("members"))  # one entry a dimension
    return parts.select("cluster_id", F.transform("p", lambda e: e["m"]).alias("centroid"), "members")


def assign(vectors: DataFrame, centres: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(id, cluster_id, similarity): most similar centroid of each vector, if over `threshold`; ties go to the smaller cluster id.

    Tiles of vectors meet tiles of centroids as matrices; no pair of rows is made.
    """
    met = best_matches(vectors, centres.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding")), 1, threshold, over=True, one_kind=False)
    return met.select("id", F.col("other").alias("cluster_id"), F.col("c").alias("similarity"))


def consolidated(vectors: DataFrame) -> DataFrame:
    """Centroids made anew from the vectors that are there: clusters without any leave."""
    return centroids(vectors.filter("embedding is not null and cluster_id is not null"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write the vector table in place of what was there; the job's commit makes the new files visible at once."""
    vectors.write.mode("overwrite").parquet(path)
