import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import embed_dedup, topk
from newsloom.llm.graph import components

VECTOR = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    x = [base[i % 40] + rng.normal(size=8) * (0.05 if i % 3 else 0.3) for i in range(300)]
    x += [base[0]] * 30 + [np.zeros(8)] * 2
    out = [(i, [float(np.float32(c)) for c in v], None if i % 37 == 5 else i % 4) for i, v in enumerate(x)]
    n = len(out)
    return out + [(n, None, 1), (n + 1, [1.0] * 7 + [None], 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [float("inf")] + [1.0] * 7, 1), (n + 4, [], 1)]


def usable(v):
    return v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)


def test_embedding_links(spark, rows, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 16)
    live = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if usable(v) and label is not None and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, a, p in live:
        for j, b, q in live:
            if i != j and p == q and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    df = spark.createDataFrame(rows, VECTOR).withColumn("id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_links(df).collect()}
    assert got == {i: (len(links[i]), reach(i), reach(i) == i) for i in links}
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0
    assert [r.n_links for r in embed_dedup.embedding_links(df.filter("embedding is null")).collect()] == [0]


@pytest.mark.parametrize("piece, block", [(4096, 2048), (32, 2)])
def test_top_inner_products(spark, rows, monkeypatch, piece, block):
    monkeypatch.setattr(topk, "PIECE_ROWS", piece)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    live = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in rows if usable(v)]
    want = set()
    for i, q in live:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in live if j != i)[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    df = spark.createDataFrame(rows, VECTOR)
    assert {tuple(r) for r in topk.top_inner_products(df).collect()} == want
    assert topk.top_inner_products(df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert {tuple(r)[:3] for r in topk.top_inner_products(few).collect()} >= {(0, 1, 1)} or topk.top_inner_products(few).count() == 2


def test_vectors_of_several_lengths(spark):
    """Vectors meet those of their own length only, whichever length is commonest."""
    rows = [(i, [1.0, i / 100.0], 1) for i in range(40)] + [(50, [0.5, 0.5, 0.25], 1), (51, [0.5, 0.5, 0.25001], 1), (52, [0.5, 0.5, 0.25], 2), (100, [2.0], 1), (101, [0.0, 0.0, 0.0], 1), (102, [], 1), (150, [1.0] * 3 + [float("inf")], 1)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("query_id", F.lit("clash")).withColumn("score", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_links(df).collect()}
    assert [got[i] for i in (50, 51, 52, 100, 101, 102, 150)] == [(1, 50), (1, 50), (0, 52), (0, 100), (0, 101), (0, 102), (0, 150)] and got[0][0] > 5
    top = sorted(map(tuple, topk.top_inner_products(df).collect()))
    assert [t[:3] for t in top if t[0] == 50] == [(50, 1, 51), (50, 2, 52), (50, 3, 101)] and [t[2] for t in top if t[0] == 0] == [1, 2, 3, 4, 5]
    assert not [t for t in top if t[0] in (100, 150)]


def test_tiles_meet_neighbours_only(monkeypatch):
    """Of clustered vectors hardly any pair is multiplied to the end, and none with a high cosine is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = embed_dedup._unit(centres[rng.integers(0, 20, 400)] + rng.normal(size=(400, 32)) * 0.05)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    i, j = embed_dedup.tile_links(x, x, x @ axes, x @ axes, 0.98, True)
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_cover_tree_invariants(monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    x = np.random.default_rng(4).normal(size=(500, 6)) * 100

    def check(node):
        away = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
        assert (away(x[node.rows], node.center) <= 2.0**node.level + 1e-9).all()
        if node.children:
            centres = np.array([c.center for c in node.children])
            apart = away(centres[:, None, :], centres[None, :, :])
            assert apart[np.triu_indices(len(centres), 1)].min() > 2.0 ** (node.level - 1)
            assert all(c.radius <= 2.0 ** (node.level - 1) and c.level < node.level for c in node.children)
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            for c in node.children:
                check(c)

    check(topk.Node(x, np.arange(500)))


def test_vectors_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (0, [1.0, 0.001], 1), (None, [1.0, 0.0], 1)], VECTOR)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in embed_dedup.embedding_links(df).collect())
    assert got == [(False, 0, 1, 0), (False, 1, 1, 0), (False, 1, 1, 0), (True, 0, 0, None)]
    assert [tuple(r) for r in topk.top_inner_products(df).collect()] == [(0, 1, 1, 65536)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (60, 40), (60, 70), (80, 80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 40 for i in (40, 50, 60, 70)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, tmp_path, docs, corpus):
    import corpus_pipeline as P

    labels = [(r[0], int(len(r[1] or "") > 30), 0) for r in corpus]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in P.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / "out" / name))
        seen.append(spark.read.parquet(str(tmp_path / "out" / name)))
    for x in seen[1:-1]:
        assert sorted(x.columns) == sorted(seen[0].columns)
    first, near, cut, mixed, tokens = seen[1:]
    assert near.groupBy("doc_id").count().filter("count > 1").count() == 0 and near.count() < first.count()
    assert cut.count() == near.count()
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert tokens.count() == mixed.count() and tokens.filter("not round_trip").count() == 0
    whole = P.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert key(whole) == key(tokens)


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_embedding_dedup", "op5_mixing", "op6_substring_dedup", "op7_topk"])
def test_equals_sql(spark, name):
    import duckdb

    from newsloom.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), c.sql(ORACLE_SQL[name]).df()
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


AWKWARD = [
    (1, "a b c d e f g h i j", "en", "s", 19), (1, "a b c d e f g h i j", "en", "s", 19), (1, "a b c d e f g h i j", "de", "s", 19), (2, "a b c d e f g h i j", "en", None, 19), (2, "other words", "en", "t", 11),
    (None, "a b c d e f g h i j", "en", "s", 19), (None, "a b c d e f g h i j", "en", "s", 19), (3, None, None, "t", None), (4, "", "en", "t", 0), (5, " ".join(f"w{i}" for i in range(60_000)) + " " + "z" * 100_000, "en", "u", 1),
]


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path, stage):
    import corpus_pipeline as P

    clash = ("score", "predicted", "size", "w", "at", "copy", "c", "words", "positions", "n_words", "n_removed", "kept_text", "removed", "id", "n", "component_id", "chunk", "ids", "decoded", "target")
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(f"own {c}").alias(c) for c in clash))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, f = P.STAGES[stage]
    f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = out.collect()
    if name != "bpe_encoding":
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in clash)
    if name == "ngram_jaccard_join":  # rows of id 2 hang on id 1, both texts
        assert sorted((r.doc_id or 0, r.lang or "") for r in rows) == [(0, "en"), (0, "en"), (1, "de"), (3, ""), (4, "en"), (5, "en")]
    if name == "substring_dedup":
        assert len(rows) == len(AWKWARD) and {r.text for r in rows if r.doc_id == 3} == {None}
    if name == "source_mixing":
        assert all(r.text and r.n_chars == len(r.text) for r in rows) and {r.doc_id for r in rows} >= {None, 1, 2}
        assert sum(len(r.text.split()) for r in rows if r.source == "s") <= 2 * 50
    if name == "bpe_encoding":
        assert len(rows) == len(AWKWARD) and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in rows)
    assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
