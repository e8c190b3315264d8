"""Exact top-k search by inner product with a dual cover tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import packed, unpacked
from .vectors import dimension, ragged, usable

PIVOTS = (16, 1024)  # top-level nodes: the square root of the number of rows, within these bounds
PIECE_ROWS = 4096  # rows of one part of a top-level node
BLOCK_QUERIES = 2048  # queries that meet a part in one group
LEAF_ROWS = 64
LEAF_QUERIES = 12  # fewer than rows: a group is pruned by its worst kth score and its radius
BULK = 256  # rows of a node that are evaluated at once where no child of it is pruned
FANOUT = 16  # children of a node of a tree


class Node:
    """A node of a cover tree: `rows` (indices, the centre first) lie within 2 ** level of the centre.

    Children are one level down or further: their centres are more than 2 ** (level - 1) apart and every row lies within
    that of its child's centre.  Levels are numbers between whole ones where distances lie close together, as in many dimensions: a node
    takes the level at which FANOUT centres cover it, so it has that many children at most and building costs FANOUT passes a generation.
    A node of few rows is a leaf.
    """

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int | None = None):
        leaf = LEAF_ROWS if leaf is None else leaf
        self.rows, self.center = rows, x[rows[0]]
        away = np.sqrt(((x[rows] - self.center) ** 2).sum(axis=1))
        self.radius, self.norm, self.children = float(away.max()), float(np.sqrt((self.center**2).sum())), []
        self.level = math.ceil(math.log2(self.radius)) if self.radius else -1
        if len(rows) <= leaf or self.radius == 0:
            return
        # farthest-first centres until the next level's radius covers all, or there are enough of them
        owner, nearest, centres = np.zeros(len(rows), dtype=np.int64), away, 1
        while nearest.max() > 2.0 ** (self.level - 1) and centres < FANOUT:
            far = int(nearest.argmax())
            d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(axis=1))
            closer = d < nearest
            owner[closer], nearest[closer] = centres, d[closer]
            owner[far] = centres
            centres += 1
        cover = float(nearest.max())
        if cover > 2.0 ** (self.level - 1):  # over half the radius: all rows lie within twice of it
            self.level = 1 + math.log2(cover * (1 + 1e-12))
        for c in range(centres):
            mine = np.flatnonzero(owner == c)
            self.children.append(Node(x, rows[mine[np.argsort(nearest[mine], kind="stable")]], leaf))  # the centre first


def bound(q_center_dot, q_norm, q_radius, d_norm, d_radius):
    """No inner product between two balls exceeds this."""
    top = q_center_dot + q_radius * d_norm + d_radius * q_norm + q_radius * d_radius
    return top + 1e-9 * (abs(top) + 1)


class Search:
    """Best k rows of one part for the queries of one block."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.q_ids, self.kth, self.x, self.ids, self.k = q, q_ids, kth.copy(), x, ids, k
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)

    def run(self, groups: np.ndarray) -> None:
        data = Node(self.x, np.arange(len(self.x)))
        for g in np.unique(groups):
            self._pair(Node(self.q, np.flatnonzero(groups == g), LEAF_QUERIES), data)

    def _pair(self, a: Node, b: Node) -> None:
        if bound(float(a.center @ b.center), a.norm, a.radius, b.norm, b.radius) < self.kth[a.rows].min():
            return
        if not a.children and not b.children:
            self._scores(a.rows, b.rows)
        elif b.children and (not a.children or b.radius >= a.radius):
            # all children are bounded at once: only those that may hold a better row are gone into, the best first
            dot, norm, radius = np.array([c.center for c in b.children]) @ a.center, np.array([c.norm for c in b.children]), np.array([c.radius for c in b.children])
            top = bound(dot, a.norm, a.radius, norm, radius)
            worst = self.kth[a.rows].min()
            open_ = np.flatnonzero(top >= worst)
            if len(open_) == len(b.children) and len(b.rows) <= BULK and np.isfinite(worst):
                # bounds tell these apart no more: one product costs less than going down
                return self._scores(a.rows, b.rows)
            leaves = [i for i in open_ if not b.children[i].children]
            if leaves and not a.children:
                self._scores(a.rows, np.concatenate([b.children[i].rows for i in leaves]))
                open_ = np.array([i for i in open_ if b.children[i].children], dtype=np.int64)
            for i in open_[np.argsort(-top[open_], kind="stable")]:
                self._pair(a, b.children[i])
        else:
            for child in a.children:
                self._pair(child, b)

    def _scores(self, rows: np.ndarray, cols: np.ndarray) -> None:
        s = self.q[rows] @ self.x[cols].T
        s[self.q_ids[rows][:, None] == self.ids[cols][None, :]] = -np.inf
        score = np.concatenate((self.score[rows], s), axis=1)
        ids = np.concatenate((self.found[rows], np.broadcast_to(self.ids[cols], s.shape)), axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.score[rows, -1])


def top_inner_products(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest integer inner product for each row whose id is divisible by `every`.

    A component x becomes floor(scale * x); scores are exact (below 2**53).  A query's own row is no candidate; ties go
    to the smaller id; a query gets all candidates if they are fewer than k.  Vectors that are null or empty or hold null or
    non-finite components, and rows of null id, take no part; vectors of different lengths have no product and do not meet.  Ids are
    distinct integers; of rows of one id the one whose vector comes first counts.  Other columns are not read, so clashing names
    do not matter; an empty table gives an empty result.  Returns query_id (long), rank (int, from 1), vec_id and score (long).

    Queries and data are indexed together: both go to the nearest of about sqrt(rows) sampled rows of the commonest length, whose
    balls are the top level; every row is indexed, the sample only shapes the tree (vectors of another length form one node).
    A query's k best among the pivots, and then in its own node, bound its kth score from below.  A query group meets a further
    node only if their covering radii allow a score not below the group's worst kth; in a part of a node both sides
    are cover trees, and pairs of nodes are pruned by the same rule.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    vectors = vectors.filter("id is not null").groupBy("id").agg(F.min("embedding").alias("embedding"))

    def whole(batches):
        for batch in batches:
            ok = pa.array(usable(batch.column("embedding"))[0])
            values, edges = ragged(batch.column("embedding").filter(ok))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").filter(ok), "dim": pa.array(np.diff(edges), pa.int32()), "v": packed(np.floor(scale * values).astype(np.int64), edges)})

    points = vectors.mapInArrow(whole, "id long, dim int, v binary").checkpoint()
    dim, n = dimension(points.select(F.array_repeat(F.lit(0), F.col("dim")).alias("v")), "v"), points.count()
    sample = points.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(min(max(PIVOTS[0], math.isqrt(n)), PIVOTS[1])).collect()
    pivot_ids = np.array([r["id"] for r in sample], dtype=np.int64)
    pivots = np.array([np.frombuffer(r["v"], np.int64) for r in sample], dtype=np.float64).reshape(len(sample), dim)

    def assign(batches):
        for batch in batches:
            values, edges = unpacked(pa.chunked_array([batch.column("v")]), np.int64)
            values, length, ids = values.astype(np.float64), np.diff(edges), batch.column("id").to_numpy()
            norms = np.sqrt(np.diff(np.concatenate(([0.0], np.cumsum(values**2)))[edges]))
            node, away, kth = -length.astype(np.int64), norms * (1 + 1e-9), np.full(len(length), -np.inf)  # around the origin
            main = np.flatnonzero(length == dim)
            if len(main) and len(pivots):
                x = values[edges[main][:, None] + np.arange(dim)[None, :]]
                dot = x @ pivots.T
                square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * dot
                node[main] = square.argmin(axis=1)
                away[main] = np.sqrt(((x - pivots[node[main]]) ** 2).sum(axis=1))
                dot[ids[main][:, None] == pivot_ids[None, :]] = -np.inf
                kth[main] = np.sort(dot, axis=1)[:, -k] if dot.shape[1] >= k else -np.inf
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "node": pa.array(node, pa.int64()), "away": away, "kth": kth})

    placed = points.mapInArrow(assign, "id long, v binary, node long, away double, kth double").checkpoint()
    queries = placed.filter(F.col("id") % every == 0)
    spark = vectors.sparkSession
    nodes = {r["node"]: r for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")).collect()}

    def search(asked: DataFrame, own: bool) -> DataFrame:
        """(query_id, vec_id, score) found for the queries (id, v, node, away, kth) in their own nodes or in all other ones."""
        groups = asked.groupBy("node").agg(F.count(F.lit(1)).alias("queries"), F.max("away").alias("reach"), F.min("kth").alias("worst")).orderBy("node").collect()
        blocks, pairs, before = [], [], 0
        for g in groups:
            parts = -(-g["queries"] // BLOCK_QUERIES)
            blocks.append((g["node"], before // BLOCK_QUERIES, parts))
            before += g["queries"]
            if own or g["node"] < 0:
                met = [g["node"]] if own else []
            else:
                others = np.array([c for c in nodes if c >= 0 and c != g["node"]], dtype=np.int64)
                norms = lambda c: np.sqrt((pivots[c] ** 2).sum(axis=-1))
                top = bound(pivots[others] @ pivots[g["node"]], norms(g["node"]), g["reach"], norms(others), np.array([nodes[c]["radius"] for c in others.tolist()]))
                met = others[top >= g["worst"]].tolist()
            pairs += [(g["node"], c, -(-nodes[c]["rows"] // PIECE_ROWS)) for c in met]
        # both tables have at most one row a node, or one a pair of nodes: PIVOTS bounds them
        blocks = spark.createDataFrame(blocks, "g long, first long, parts long")
        pairs = spark.createDataFrame(pairs, "g long, node long, pieces long")
        block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
        left = asked.withColumnRenamed("node", "g").join(F.broadcast(blocks), "g").withColumn("block", block)
        left = left.join(F.broadcast(pairs), "g").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        left = left.select("node", "piece", "block", "id", "v", "g", "kth")
        needed = blocks.join(pairs, "g").select("node", "pieces", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("block")).distinct()
        data = placed.join(F.broadcast(needed), "node").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).select(
            F.col("node").alias("d_node"), F.col("piece").alias("d_piece"), F.col("block").alias("d_block"), F.col("id").alias("d_id"), F.col("v").alias("d_v")
        )
        keys = ("node", "piece", "block")
        return left.groupBy(*keys).cogroup(data.groupBy(*(f"d_{c}" for c in keys))).applyInArrow(pruned, "query_id long, vec_id long, score long")

    def pruned(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        left, right = left.sort_by("id"), right.sort_by("d_id")
        rows = lambda c: unpacked(c, np.int64)[0].astype(np.float64).reshape(len(c), -1)
        s = Search(rows(left["v"]), left["id"].to_numpy(), left["kth"].to_numpy(), rows(right["d_v"]), right["d_id"].to_numpy(), k)
        s.run(left["g"].to_numpy())
        i, j = np.nonzero(np.isfinite(s.score))
        return pa.table({"query_id": pa.array(s.q_ids[i]), "vec_id": pa.array(s.found[i, j]), "score": pa.array(s.score[i, j].astype(np.int64))})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    near = best(search(queries, own=True)).drop("rank").checkpoint()
    kth = near.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k)
    tighter = queries.join(kth, F.col("id") == F.col("query_id"), "left").withColumn("kth", F.greatest("kth", F.col("s").cast("double"))).drop("query_id", "s", "c").checkpoint()
    found = best(near.unionByName(search(tighter, own=False)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: five best rows for every fiftieth vector."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
