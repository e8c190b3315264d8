"""Cases that only larger tables hold."""

import random

import duckdb
import pytest

from newsloom.operators import assign as N
from newsloom.plans.queries import ORACLE_SQL, QUERIES


def test_pages_with_references_cut_short_equal_sql(spark, tmp_path):
    body = "one two three four five six seven eight nine ten"
    html = [f"<p>{body} Fish &amp Chips &amp; {body} &lt</p><p>{body} &amp;lt; &#39;x&#39; &copy {body} &middot;</p>", "<p>&amp</p>", "&nbsp;&quot;a&quot", "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, column in (("clean_html", "text_md5"), ("extract_body", "body_md5")):
        want = dict(c.sql(f"SELECT page_id, {column} FROM ({ORACLE_SQL[name]})").fetchall())
        got = {r.page_id: r[column] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want and len(got) == len(html), name


def most_joined(frame):
    """The most rows that one join of a frame that was run made."""

    def below(plan):
        inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else ""
        if inner:
            return (yield from below(getattr(plan, inner)()))
        yield plan
        for i in range(plan.children().size()):
            yield from below(plan.children().apply(i))

    return max(p.metrics().apply("numOutputRows").value() for p in below(frame._jdf.queryExecution().executedPlan()) if p.nodeName().endswith("Join"))


@pytest.mark.parametrize("name", ["entity_candidates", "contained_candidates"])
def test_a_name_of_many_events_brings_the_newest_alone(spark, name):
    rng = random.Random(3)
    names = ["Hot", "Common", *[f"Rare{i}" for i in range(40)]]
    some = lambda: ["Hot", *rng.sample(names[1:], 3)]
    articles, events = [(f"a{i}", some()) for i in range(60)], [(f"e{i}", some(), float(rng.randrange(90))) for i in range(400)]
    a, e = spark.createDataFrame(articles, "id string, entities array<string>"), spark.createDataFrame(events, "cluster_id string, entities array<string>, latest_timestamp double")
    found = getattr(N, name)(a, e, spark.createDataFrame([(90.0,)], "as_of double"))
    got = sorted(map(tuple, found.collect()))
    holds = (lambda x, words: x in words) if name == "entity_candidates" else (lambda x, words: any(x.lower() in w.lower() for w in words))
    want = []
    for i, own in articles:
        met = sorted((-t, c, sum(holds(x, words) for x in own)) for c, words, t in events if any(holds(x, words) for x in own))
        want += [(i, c, n) for _, c, n in met[:20]]
    assert got == sorted(want) and most_joined(found) < 5 * 20 * len(articles) < len(articles) * len(events)


def test_counts_and_claims_of_events_are_kept_without_python(spark, tmp_path):
    from newsloom.streaming import state as E

    arts = "cluster_id string, ts double, ingest_seq long, publisher string, title string, source_type string, social_coverage long"
    claims = "cluster_id string, doc_id long, seq long, what string, source_article_id string"
    spark.createDataFrame([("a", 1.0, 1, "P", "T", "social", 3), ("a", None, 2, None, None, "rss", 9), ("b", 5.0, 3, "", "", "social", None)], arts).write.parquet(f"{tmp_path}/arts")
    read = lambda kinds, name: spark.readStream.schema(kinds).parquet(f"{tmp_path}/{name}")
    for rows in ([("a", 5, 0, "One  thing", "s"), ("a", 5, 1, "one thing ", "s")], [("a", 4, 7, " ONE thing", "t"), ("b", 9, 0, "one thing", None)]):
        spark.createDataFrame(rows, claims).coalesce(1).write.mode("append").parquet(f"{tmp_path}/claims")
        kept = E.keep_events(E.entries(read(arts, "arts"), read(claims, "claims")), f"{tmp_path}/out", f"{tmp_path}/cp", ("rollup", "claim"))
        kept.awaitTermination()
        for q in kept.queries:
            assert "Python" not in q._jsq.explainInternal(False) and "Pandas" not in q._jsq.explainInternal(False)
    got = sorted(map(tuple, E.kept_claims(spark, f"{tmp_path}/out").collect()))
    assert got == [("a", 4, 7, " ONE thing", False, "ONE thing"), ("b", 9, 0, "one thing", True, "one thing")]
    assert [r.source_count for r in E.kept_rollup(spark, f"{tmp_path}/out", timeline=False).orderBy("cluster_id").collect()] == [2, 1]


def test_hashes_of_a_common_vocabulary_are_compared_in_tiles(spark, monkeypatch):
    from newsloom.operators import dedup as D

    rng = random.Random(5)
    common = rng.getrandbits(64)
    own = [common ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(400)]
    rows = [(f"d{i}", h - (1 << 64) if h >> 63 else h) for i, h in enumerate(own)] + [("none", None)]
    for attribute, value in (("TILE", 90), ("AT_ONCE", 50)):
        monkeypatch.setattr(D, attribute, value, raising=False)
    found = D.banded_pairs(spark.createDataFrame(rows, "id string, h long"), "id", "h", 9)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan
    got = [tuple(r) for r in found.collect()]
    want = set()
    for i in range(len(own)):
        for j in range(i):
            x = own[i] ^ own[j]
            if x.bit_count() <= 9 and any((x >> 8 * b) & 255 == 0 for b in range(8)):
                want.add((*sorted((f"d{i}", f"d{j}")), x.bit_count()))
    assert len(want) > 10_000 and len(got) == len(set(got)) and set(got) == want


def test_questions_meet_events_of_common_words_without_pairs(spark, monkeypatch):
    from newsloom.operators import markets as K

    monkeypatch.setattr(K, "TILE", 25, raising=False)
    rng = random.Random(11)
    words = ["common", "every", *[f"word{i}" for i in range(12)]]
    some = lambda n: ["common", *rng.sample(words[1:], n)]
    asked, told = [(f"q{i}", some(rng.randint(0, 6))) for i in range(80)], [(i, some(5), rng.sample(words, rng.randint(0, 1))) for i in range(120)]
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asked] + [("none", None)], "id string, question string")
    e = spark.createDataFrame([(p, " ".join(w), n) for p, w, n in told] + [(999, None, None)], "position long, headline string, entities array<string>")
    found = K.match_events(q, e)
    assert "Join" not in found._jdf.queryExecution().toString()
    want = {}
    for i, w in asked:
        for p, head, named in told:
            share, hits = len({*w} & ({*head} | {*named})) / len(w), len({*w} & {*named})
            if len(w) >= 2 and ((hits and share >= 0.3) or share >= 0.6):
                want[i] = max(want.get(i, (0, 0)), (share + hits * 0.2, -p))
    assert len(want) > 50 and {r.id: (r.score, -r.position) for r in found.collect()} == want
    assert K.match_events(q.limit(0), e).count() == 0 == K.match_events(q, e.limit(0)).count()


def made_once(spark, column, part):
    """Whether an expression has a part in one place: inside a lambda it is computed anew for each element."""
    df = spark.createDataFrame([(["Oslo"], "A gdp tariff. ")], "e array<string>, t string")
    return df.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().count(part) == 1


def test_a_text_is_cut_into_sentences_once(spark):
    from newsloom.functions import text as X

    assert made_once(spark, X.key_sentences("t"), "split(trim(coalesce(t")


def test_a_text_is_lowered_once_for_all_labels(spark):
    from newsloom.functions import scoring as S

    assert made_once(spark, S.topic("e", "t"), "lower(coalesce(t") and made_once(spark, S.geography("e", "t"), "lower(coalesce(t")


@pytest.mark.parametrize("name", ["simhash_classes", "dedup_score"])
def test_hashes_are_made_once_for_both_sides_of_a_join(spark, name):
    assert "_majority_of_words" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_bits_of_long_and_short_texts_add_up_in_bytes():
    import numpy as np

    from newsloom.functions.similarity import _set_bits

    length = np.array([1, 254, 255, 256, 510, 511, 2, 60_000])
    bits = np.random.default_rng(1).integers(0, 2, (length.sum(), 64)).astype(np.uint8)
    bits[300:1500] = 1
    edge = np.concatenate(([0], np.cumsum(length)))
    assert (_set_bits(bits.view(np.uint64), length) == [bits[i:j].sum(axis=0, dtype=np.int64) for i, j in zip(edge, edge[1:], strict=False)]).all()


def test_near_headlines_are_no_sorted_pairs(spark):
    rng = random.Random(8)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    common = rng.getrandbits(64)
    some = lambda: common ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8)))
    articles, heads = [(f"a{i}", some()) for i in range(50)] + [("far", common ^ (2**64 - 1))], [(f"e{i}", some()) for i in range(300)]
    found = N._nearest_headline(spark.createDataFrame([(i, signed(h)) for i, h in articles], "id string, ha long"), spark.createDataFrame([(i, signed(h)) for i, h in heads], "cluster_id string, hb long"), 300)
    want = {}
    for i, h in articles:
        near = min(((h ^ o).bit_count(), c) for c, o in heads)
        if 1 - near[0] / 64 > N.NEAR:
            want[i] = near[1]
    assert 40 < len(want) < len(articles) and {r.id: r.cluster_id for r in found.collect()} == want
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_a_search_are_no_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newsloom.operators import vectors as E

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q, of = v.filter("id % 100 = 0"), {r.id: r.embedding for r in v.collect()}
    want = {}
    for r in E.candidates(v, q, 64).collect():
        a, b = of[r.query_id], of[r.id]
        cosine = sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        want.setdefault(r.query_id, []).append((-round(cosine, 9), r.id))
    monkeypatch.setattr(E, "TILE", 400)
    monkeypatch.setattr(E, "candidates", None)
    got = {(r.query_id, r["rank"], r.id) for r in E.nearest_lsh(v, q, 5, 64).collect()}
    assert min(map(len, want.values())) >= 15 and got == {(i, n + 1, x[1]) for i, met in want.items() for n, x in enumerate(sorted(met)[:5])}


def counted(frame, node, metric):
    """A metric of all nodes of a kind in a frame that was run."""

    def below(plan):
        inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else ""
        if inner:
            return below(getattr(plan, inner)())
        own = [plan.metrics().apply(metric).value()] if plan.nodeName() == node else []
        return own + [n for i in range(plan.children().size()) for n in below(plan.children().apply(i))]

    return below(frame._jdf.queryExecution().executedPlan())


def sent(frame):
    """The rows that the exchanges of a frame that was run wrote."""
    return sum(counted(frame, "Exchange", "shuffleRecordsWritten"))


@pytest.mark.parametrize("name", ["simhash_pairs_all", "simhash_pairs"])
def test_what_is_sent_for_pairs_grows_with_the_rows(spark, tmp_path, monkeypatch, name):
    from newsloom.operators import dedup as D

    texts = [f"storm nears coast {i % 900} {i % 7}" for i in range(1200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    for attribute, value in (("TILE", 4), ("BLOCKS", 8), ("WIDEST", 100)):
        monkeypatch.setattr(D, attribute, value, raising=False)
    found = QUERIES[name](spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want)
    # 1,200 rows of 300 tiles: each tile's rows once for each of 8 blocks, not of 300 tiles
    assert sent(found) < 8 * 300 + 4 * 300 + 100
    monkeypatch.setattr(D, "WIDEST", 5)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_text_is_shuffled_for_titles_and_fingerprints(spark, shuffled_joins):
    from newsloom.plans import adapters as A

    def exchanges(plan):
        inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else ""
        if inner:
            return exchanges(getattr(plan, inner)())
        return [plan.output().toString()] * (plan.nodeName() == "Exchange") + [x for i in range(plan.children().size()) for x in exchanges(plan.children().apply(i))]

    arts = A.articles(spark, "/root/testdata/sf0.001", prints=True)
    for columns in (["id", "title", "ts"], ["id", "content", "summary"]):
        found = exchanges(arts.select(*columns)._jdf.queryExecution().executedPlan())
        assert len(found) >= 2 and not any("text#" in x for x in found), columns


def test_a_common_headline_makes_no_pairs(spark, shuffled_joins):
    n = 150
    articles = spark.createDataFrame([(f"a{i}", "Storm nears coast", f"text {i}", ["Coast"]) for i in range(n)], "id string, title string, text string, entities array<string>")
    events = spark.createDataFrame([(f"e{i:03}", "storm nears coast ", "", ["Coast"], 90.0, 1) for i in range(n)], "cluster_id string, headline string, summary string, entities array<string>, latest_timestamp double, source_count long")
    found = N.assign_articles(articles, events, spark.createDataFrame([(90.0,)], "as_of double"))
    assert {tuple(r) for r in found.collect()} == {(f"a{i}", "e000", "exact") for i in range(n)}
    assert max(counted(found, "SortMergeJoin", "numOutputRows")) <= n and sent(found) < 20 * n  # of 22,500 pairs


def test_the_best_of_the_newest_events_of_names(spark):
    rng = random.Random(6)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    common = rng.getrandbits(64)
    some = lambda most: common ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
    names = [f"Name{i}" for i in range(9)]
    articles = [(f"a{i}", rng.sample(names, rng.randint(0, 6)), some(24), some(24)) for i in range(60)]
    events = [(f"e{i}", rng.sample(names, rng.randint(0, 4)), some(24), some(24), float(rng.randrange(60))) for i in range(200)]
    lower = lambda x: [w.lower() for w in x]
    a = spark.createDataFrame([(i, e, lower(e), signed(t), signed(c)) for i, e, t, c in articles], "id string, ea array<string>, names array<string>, ta long, ca long")
    b = spark.createDataFrame([(i, e, lower(e), signed(t), signed(c), ts) for i, e, t, c, ts in events], "cluster_id string, eb array<string>, names array<string>, tb long, cb long, latest_timestamp double")
    now = spark.createDataFrame([(60.0,)], "as_of double")
    own, other, want = {x[0]: x for x in articles}, {x[0]: x for x in events}, {}
    for r in N.entity_candidates(a.withColumnRenamed("ea", "entities"), b.withColumnRenamed("eb", "entities"), now, 50.0).collect():
        (_, ea, ta, ca), (_, eb, tb, cb, _) = own[r.id], other[r.cluster_id]
        alike = lambda x, y: 1 - (x ^ y).bit_count() / 64
        score = alike(ta, tb) * 0.4 + alike(ca, cb) * 0.3 + len({*ea} & {*eb}) / len({*ea} | {*eb}) * 0.3
        if score > 0.7:
            want[r.id] = min(want.get(r.id, (9, "")), (-score, r.cluster_id))
    assert len(want) > 20 and {r.id: r.shared for r in N._best_shared(a, b, now, 50.0).collect()} == {k: v[1] for k, v in want.items()}


def test_what_is_sent_for_questions_grows_with_the_rows(spark, monkeypatch):
    from newsloom.operators import markets as K

    rng = random.Random(12)
    words = ["common", "every", *[f"word{i}" for i in range(30)]]
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.sample(words, rng.randint(2, 7)))) for i in range(800)], "id string, question string")
    e = spark.createDataFrame([(i, " ".join(rng.sample(words, 6)), rng.sample(words, rng.randint(0, 1))) for i in range(200)], "position long, headline string, entities array<string>")
    want = sorted(map(tuple, K.match_events(q, e).collect()))
    for attribute, value in (("TILE", 4), ("BLOCKS", 8), ("WIDEST", 25), ("EVENTS", 13)):
        monkeypatch.setattr(K, attribute, value, raising=False)
    found = K.match_events(q, e)
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == want
    # 800 questions once for each of 4 blocks of events, 200 events once for each of 8 of questions, and the best; not 40,000 and 40,000
    assert sent(found) <= 4 * 800 + 8 * 200 + 4 * 800
    monkeypatch.setattr(K, "WIDEST", 5)
    assert sorted(map(tuple, K.match_events(q, e).collect())) == want
