"""Every news query with SQL equals it on the smallest tables; the others run and have the right shape."""

import duckdb
import pytest

from newsloom.plans.queries import ORACLE_SQL, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "customer documents embeddings events lineitem nation orders pages part region supplier".split()


def connected(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return connected(DATA)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", ["sensationalism", "ai_relevance", "topics", "geography", "extract_body", "clean_html", "article_word_counts", "word_sets", "headline_match", "first_disputes"])
def test_text_queries_equal_sql_on_more_text(spark, larger, name):
    got, want = QUERIES[name](spark, LARGER).toPandas(), larger.sql(ORACLE_SQL[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_lsh_finds_most_of_the_exact_neighbours(spark):
    exact = {(r.query_id, r.id) for r in QUERIES["knn_exact"](spark, DATA).collect()}
    near = {(r.query_id, r.id) for r in QUERIES["knn_lsh"](spark, DATA).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_groups_hold_every_event_of_the_page_once(spark):
    from newsloom.operators import coverage as V
    from newsloom.plans import adapters as A

    arts = A.articles(spark, DATA)
    page = V.feed_tiered(V.feed_filter(A.clusters(arts), V.as_of(arts), "7d"), limit=100)
    ids = sorted(r.cluster_id for r in page.collect())
    groups = QUERIES["grouped_feed"](spark, DATA).collect()
    assert sorted(x for g in groups for x in [g.cluster_id, *g.related]) == ids
    assert all(len(g.related) < 8 for g in groups)


def test_merges_point_to_events_that_stay(spark):
    merges = {r.cluster_id: r.primary_id for r in QUERIES["merge_clusters"](spark, DATA).collect()}
    assert not set(merges) & set(merges.values())


def test_neutral_headlines_of_typed_titles(spark):
    want = {"t1": "Shocking collapse: markets in decline..", "t2": "Council approves budget", "t3": "Will the Fed cut rates?", "t4": "Senator criticizes rival", "t5": "", "t6": "OpenAI ships a new model", "t7": "Paris climate talks begin", "t8": "China chip makers rally", "t9": "The AI lab hires", "t10": "Storm emerges"}
    got = {r.id: r.neutral for r in QUERIES["neutral_headline"](spark, DATA).collect()}
    assert len(got) > len(want) and {k: got[k] for k in want} == want


@pytest.mark.parametrize("name", ["duplicate_scores", "grouped_ai_feed", "key_sentences", "entities", "assign_articles"])
def test_queries_without_sql_give_sensible_rows(spark, name):
    rows_ = QUERIES[name](spark, DATA).collect()
    assert rows_
    if name == "duplicate_scores":
        assert all(0 <= r.overall <= 1 and r.is_duplicate == (r.overall > 0.7) for r in rows_) and any(r.title_similarity == 1 for r in rows_)
    if name == "grouped_ai_feed":
        assert len({r.cluster_id for r in rows_}) == len(rows_) and all(len(r.related) < 8 for r in rows_)


def test_simhash_pairs_and_classes_cover_all_pairs(spark):
    """Pairs of representatives with their members are the pairs of simhash_pairs_all."""
    of = {r.doc_id: r.class_id for r in QUERIES["simhash_classes"](spark, DATA).collect()}
    near = {(r.id_a, r.id_b): r.distance for r in QUERIES["simhash_pairs"](spark, DATA).collect()}
    every = {(r.id_a, r.id_b): r.distance for r in QUERIES["simhash_pairs_all"](spark, DATA).collect()}
    for (a, b), d in every.items():
        x, y = sorted((of[a], of[b]))
        assert (x == y and d == 0) or near[x, y] == d
    assert all(every[k] == d for k, d in near.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
