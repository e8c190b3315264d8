"""Embedding near-dedup: PCA-ordered tiles, leading dimensions first, residuals bounded by suffix norms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .vectors import dimension, matrix, ragged, usable

TILE_ROWS = 512
COORDINATES = 3  # principal coordinates by which tiles are told apart
CELL_LEAST = 0.05  # width of a cell of a coordinate, if links reach less far
STEPS = (8, 16, 32)  # leading dimensions after which pairs are given up
SLACK = 1e-9  # rounding of the rotated coordinates; the decision itself is taken on the given components


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors of the commonest length about their mean, most spread first.

    Partial sums in tasks are added up in Spark; (dim + 1) ** 2 numbers come back.
    """

    def part(batches):
        total = None
        for batch in batches:
            _, x = matrix(batch.column("embedding"), dim)
            x = x[(x != 0).any(axis=1)]
            if len(x):
                x = np.concatenate((_unit(x), np.ones((len(x), 1))), axis=1)
                s = x.T @ x
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "x": total.ravel()})

    sums = vectors.select("embedding").mapInArrow(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    if not sums:
        return np.eye(dim)
    m = np.array([r["x"] for r in sums]).reshape(dim + 1, dim + 1)
    mean = m[dim, :dim] / m[dim, dim]
    return np.linalg.eigh(m[:dim, :dim] / m[dim, dim] - np.outer(mean, mean))[1][:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with cosine >= threshold; a, b: unit vectors, ra, rb: the same along the principal axes.

    Products of the leading dimensions accumulate step by step.  What the rest can add is at most the product of the
    two suffix norms, so a pair whose sum with that bound stays below the threshold is dropped; pairs left after
    the last step are decided on the unrotated vectors.
    """
    dim = ra.shape[1]
    cut = min(STEPS[0], dim)
    part = ra[:, :cut] @ rb[:, :cut].T
    rest = lambda x, c: np.sqrt((x[:, c:] ** 2).sum(axis=1))
    alive = part + rest(ra, cut)[:, None] * rest(rb, cut)[None, :] >= threshold - SLACK
    if same:
        alive &= np.arange(len(ra))[:, None] < np.arange(len(rb))[None, :]
    i, j = np.nonzero(alive)
    s = part[i, j]
    for step in (*[x for x in STEPS[1:] if x < dim], dim):
        if not len(i):
            break
        s = s + np.einsum("ij,ij->i", ra[i, cut:step], rb[j, cut:step])
        cut = step
        ok = s + rest(ra, cut)[i] * rest(rb, cut)[j] >= threshold - SLACK
        i, j, s = i[ok], j[ok], s[ok]
    ok = (a[i] * b[j]).sum(axis=1) >= threshold
    return i[ok], j[ok]


def embedding_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Near-duplicate vectors of equal label: cosine >= threshold in double precision.

    Returns id_col, n_links (long: other vectors linked directly), component_id (long: smallest id that links reach,
    itself included) and kept (boolean: the id is its component's).  Vectors that are null, empty, zero or hold null or
    non-finite components, and those of null label or id, link with nothing; vectors of different lengths have no cosine and do
    not link.  Ids are distinct integers, and a repeated row gets what its id gets.  Equal vectors of a label are one class that is
    compared once.  Other columns are not read; an empty table gives an empty result.

    The classes of a label and length stand in tiles of TILE_ROWS by the order of their first principal coordinate, apart by cells of
    the next two.  Unit vectors with cosine >= t differ by at most sqrt(2 - 2t) in any coordinate, so a tile meets only
    tiles of the same or a neighbouring cell, and of these the ones whose ranges lie that near; each pair of tiles is
    one group of bounded size.  Axes are fitted for the commonest length; others keep their own components as coordinates.
    """
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))

    def live(batches):
        for batch in batches:
            fine, some = usable(batch.column("embedding"))
            yield batch.filter(pa.array(fine & some))

    good = vectors.filter("label is not null and id is not null").mapInArrow(live, vectors.schema)
    dim = dimension(good, "embedding")
    axes = _axes(good, dim) if dim else np.eye(1)

    def rotated(x: np.ndarray) -> np.ndarray:
        return x @ axes if x.shape[1] == dim else x

    @F.arrow_udf("array<double>")
    def coordinates(column: pa.Array) -> pa.Array:
        values, edges = ragged(column)
        out, length = np.zeros((len(edges) - 1, COORDINATES)), np.diff(edges)
        for n in np.unique(length[length > 0]):
            rows = np.flatnonzero(length == n)
            x = rotated(_unit(values[edges[rows][:, None] + np.arange(n)[None, :]]))[:, :COORDINATES]
            out[rows, : x.shape[1]] = x
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, COORDINATES), pa.int32()), pa.array(out.ravel()))

    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("first"), F.countDistinct("id").alias("copies"))
    classes = classes.withColumn("length", F.size("embedding")).withColumn("x", coordinates("embedding")).checkpoint()
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    width = max(reach, CELL_LEAST)
    cell = lambda c: F.floor(c / width).cast("int")
    at = ["label", "length", "y", "z"]
    slots = 1 << 16
    classes = classes.withColumn("y", cell(F.col("x")[1])).withColumn("z", cell(F.col("x")[2])).withColumn("slot", F.floor((F.col("x")[0] + 1.0) / 2.0 * slots).cast("long"))
    # tiles: equal-frequency ranges of the first coordinate, from counts by its fine slots
    by_slot = classes.groupBy(*at, "slot").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*at).orderBy("slot")) - F.col("rows")
    # a slot may hold more rows than a tile: its tiles are parts dealt by hash
    tiles = by_slot.withColumn("tile", F.floor(upto / TILE_ROWS)).withColumn("parts", F.ceil(F.col("rows") / TILE_ROWS))
    dealt = classes.join(tiles.drop("rows"), [*at, "slot"]).withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")))
    key = [*at, "tile", "part"]
    ends = [F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(COORDINATES)] + [F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(COORDINATES)]
    ranges = dealt.groupBy(*key).agg(*ends).withColumn("c0", cell(F.col("lo0"))).withColumn("c1", cell(F.col("hi0")))
    # tiles meet by cells of all three coordinates; of the cells that two have in common the first one counts
    a = ranges.select(*(F.col(c).alias(f"a_{c}") for c in ranges.columns), "label", "length", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("c"))
    for c in ("y", "z"):
        a = a.withColumn(c, F.explode(F.sequence(F.col(f"a_{c}") - 1, F.col(f"a_{c}") + 1)))
    b = ranges.select(*(F.col(c).alias(f"b_{c}") for c in ranges.columns), *at, F.explode(F.sequence("c0", "c1")).alias("c"))
    near = (F.col("c") == F.greatest(F.col("a_c0") - 1, F.col("b_c0"))) & (F.struct(*(f"a_{c}" for c in key[2:])) <= F.struct(*(f"b_{c}" for c in key[2:])))
    for i in range(COORDINATES):
        near = near & (F.col(f"b_lo{i}") - F.col(f"a_hi{i}") <= reach) & (F.col(f"a_lo{i}") - F.col(f"b_hi{i}") <= reach)
    pairs = a.join(b, [*at, "c"]).filter(near).select("label", "length", *(f"{s}_{c}" for s in "ab" for c in key[2:]))
    one = F.struct(F.lit(0).alias("side"), *(F.col(f"a_{c}").alias(c) for c in key[2:]))
    two = F.struct(F.lit(1).alias("side"), *(F.col(f"b_{c}").alias(c) for c in key[2:]))
    same_tile = F.struct(*(f"a_{c}" for c in key[2:])) == F.struct(*(f"b_{c}" for c in key[2:]))
    sides = pairs.select("*", F.explode(F.when(same_tile, F.array(one)).otherwise(F.array(one, two))).alias("s"))
    sides = sides.select("label", "length", *(f"{s}_{c}" for s in "ab" for c in key[2:]), "s.*")
    blocks = sides.join(dealt.select(*key, "first", "copies", "embedding"), key)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        side = table["side"].to_numpy()
        same = not side.any()
        first, copies = table["first"].to_numpy(), table["copies"].to_numpy()
        x = _unit(matrix(table["embedding"], table["length"][0].as_py())[1])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        r = rotated(x)
        i, j = tile_links(x[left], x[right], r[left], r[right], threshold, same)
        i, j = left[i], right[j]
        links = np.bincount(i, weights=copies[j], minlength=len(first)) + np.bincount(j, weights=copies[i], minlength=len(first))
        # a row's own smallest neighbour, and a forest over the rest: each row hangs on the smallest row it reaches here
        root = np.arange(len(first))
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new][root]
            if (new == root).all():
                break
            root = new
        some = links > 0
        return pa.table({"first": pa.array(first[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(first[root[some]])})

    found = blocks.groupBy("label", "length", *(f"{s}_{c}" for s in "ab" for c in key[2:])).applyInArrow(compare, "first long, links long, root long").checkpoint()
    counted = found.groupBy("first").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("root").alias("u"), F.col("first").alias("v"))).withColumnsRenamed({"node": "first", "component": "reached"})
    per = classes.select("label", "embedding", "first", "copies").join(counted, "first", "left").join(reached, "first", "left")
    per = per.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("reached", "first").alias("c"))
    linked = good.join(per, ["label", "embedding"]).groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = vectors.select("id").join(linked, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: links and component of every vector."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
