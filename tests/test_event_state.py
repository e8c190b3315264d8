"""Kept state of events equals the batch answer over the whole table, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import claims as C
from newsloom.operators import coverage as V
from newsloom.streaming import state as E

ARTICLES = "cluster_id string, ts double, ingest_seq long, publisher string, title string, source_type string, social_coverage long"
CLAIMS = "cluster_id string, doc_id long, seq long, what string, source_article_id string"


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    words = ["Exports rise", "exports  FALL", "profit growth ", "a decline", "support it", "oppose the plan", "nothing new", "", "  ", None, "up and down", "Nothing New"]
    arts = [(rng.choice("abc") if i % 9 else "hot", 1000.0 + rng.randrange(300), i, rng.choice(["P", "", None]), rng.choice(["Title one", "", None, "t" * 200]), rng.choice(["social", "rss"]), rng.choice([0, 5, 9, None])) for i in range(260)]
    claims = [(rng.choice("ab") if i % 4 else "hot", i // 3, i % 3, rng.choice(words), rng.choice(["s1", "s2", "", None])) for i in range(240)]
    return arts, claims


@pytest.mark.parametrize("cuts, mixed", [([1.0], False), ([0.1, 0.15, 0.6, 1.0], False), ([0.3, 0.5, 1.0], True)])
def test_kept_state_equals_batch(spark, tables, tmp_path, cuts, mixed):
    arts, claims = ([*t] for t in tables)
    if mixed:  # claims that come late may be the first of all
        random.Random(1).shuffle(arts)
        random.Random(2).shuffle(claims)
    read = lambda kinds, name: spark.readStream.schema(kinds).parquet(str(tmp_path / name))
    at = 0.0
    for cut in cuts:
        for rows, kinds, name in ((arts, ARTICLES, "articles"), (claims, CLAIMS, "claims")):
            part = rows[round(at * len(rows)) : round(cut * len(rows))]
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        at = cut
        E.keep_events(E.entries(read(ARTICLES, "articles"), read(CLAIMS, "claims")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    a, c = spark.createDataFrame(arts, ARTICLES), spark.createDataFrame(claims, CLAIMS)
    out = str(tmp_path / "out")
    kept = E.kept_rollup(spark, out)
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert same(kept.drop("timeline"), V.cluster_rollup(a))
    lines = kept.select("cluster_id", F.explode("timeline").alias("e")).select("cluster_id", "e.ts", "e.ingest_seq", "e.entry")
    assert same(lines, V.timeline(a)) and max(len(r.timeline) for r in kept.collect()) == 50
    first = E.kept_claims(spark, out)
    assert same(first.select("cluster_id", "doc_id", "seq", "what"), C.claim_dedup(c).select("cluster_id", "doc_id", "seq", "what"))
    assert same(first.filter("novel").select("cluster_id", F.col("first_what").alias("what")), C.novel_claims(c))
    assert same(E.kept_disputes(spark, out), C.first_disputes(c)) and E.kept_disputes(spark, out).count() > 20
