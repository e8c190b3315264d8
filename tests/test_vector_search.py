"""Vector search by tiles and buckets: equal to plain loops, without nested loops in the plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import vectors as E

KINDS = "id long, embedding array<double>"


def plan(df):
    return df._jdf.queryExecution().toString()


def cosine(a, b):
    a, b = (np.array(x or [], dtype=float) for x in (a, b))
    norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) if len(a) == len(b) else 0.0
    return float((a * b).sum() / norm) if norm else 0.0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(300)]
    x += [(300 + i, x[i][1]) for i in range(40)]  # copies: ties
    return [*x, (400, [0.0] * 6), (401, [1.0, 2.0]), (402, [2.0, 1.0]), (403, []), (404, None), (405, [float("nan")] * 6)]


@pytest.mark.parametrize("tile", [E.TILE, 37])
def test_nearest_equals_a_loop(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    for which, k, threshold in ((lambda i: i % 10 == 0, 5, 0.1), (lambda i: i > 395, 4, -2.0)):
        fine = [(i, v) for i, v in rows if i != 405]
        want = set()
        for i, v in [(i, v) for i, v in rows if which(i) and i != 405]:
            scored = sorted((-cosine(v, w), j) for j, w in fine if j != i and cosine(v, w) >= threshold)
            want |= {(i, n + 1, j, round(-c, 6)) for n, (c, j) in enumerate(scored[:k])}
        queries = df.filter(F.col("id").isin([i for i, _ in rows if which(i)]))
        got = E.nearest(df, queries, k, threshold)
        assert {tuple(r) for r in got.collect()} == want
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert E.nearest(df, df.limit(0), 3, 0.0).count() == 0 and E.nearest(df.limit(0), df, 3, 0.0).count() == 0


@pytest.mark.parametrize("tile", [E.TILE, 37])
def test_assignment_to_centroids_equals_a_loop(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    centres = [(f"c{i}", rows[i * 3][1]) for i in range(50)] + [("a-copy", rows[3][1]), ("other", [1.0, 1.0]), ("zero", [0.0] * 6), ("7", rows[7][1])]
    want = {}
    for i, v in rows:
        best = min(((-cosine(v, c), name) for name, c in centres if v and i != 405 and cosine(v, c) > 0.3), default=None)
        if best:
            want[i] = (best[1], round(-best[0], 9))
    got = E.assign(spark.createDataFrame(rows, KINDS), spark.createDataFrame(centres, "cluster_id string, centroid array<double>"), 0.3)
    assert {r.id: (r.cluster_id, round(r.similarity, 9)) for r in got.collect()} == want and want[3][0] == "a-copy"
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_probes_reach_nearest_rows_among_a_third(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 100 = 0")
    pairs = E.candidates(v, q, 64)
    assert "NestedLoop" not in plan(pairs) and "Cartesian" not in plan(pairs)
    pairs = pairs.persist()
    n, asked = v.count(), q.count()
    assert pairs.count() == pairs.distinct().count() < asked * n / 3
    met = {tuple(r) for r in pairs.collect()}
    exact = {(r.query_id, r.id) for r in E.nearest(v, q, 5, -2.0).collect()}
    assert len(met & exact) >= 0.9 * len(exact)
    found = E.nearest_lsh(v, q, 5, 64)
    assert {(r.query_id, r.id) for r in found.collect()} >= met & exact
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    pairs.unpersist()
