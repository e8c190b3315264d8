"""Published versions, merges of touched keys, centroids kept by changes, and cached verdicts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import centroid_state as S
from newsloom.operators import dedup as D
from newsloom.operators import merging as M
from newsloom.operators import vectors as E
from newsloom.sources.published import PublishedTable

ROWS = "id string, n long"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_versions_are_whole(spark, tmp_path):
    t = PublishedTable(spark, str(tmp_path / "t"), "id", buckets=8)
    with pytest.raises(FileNotFoundError):
        t.read()
    first = spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [(None, 1)], ROWS)
    assert t.replace(first) == 1 and rows_of(t.read()) == rows_of(first)
    old = t.read()
    assert t.replace(t.read().withColumn("n", F.col("n") + 1)) == 2  # made from what it replaces
    assert rows_of(old) == rows_of(first) and rows_of(t.read()) == rows_of(first.withColumn("n", F.col("n") + 1))
    # a job that dies between write and publish
    class Dies(PublishedTable):
        def _publish(self, manifest):
            raise RuntimeError

    with pytest.raises(RuntimeError):
        Dies(spark, str(tmp_path / "t"), "id", buckets=8).replace(first.limit(1))
    assert t.manifest()["version"] == 2 and t.read().count() == 41
    before = t.manifest()["buckets"]
    keys = spark.createDataFrame([("k3",), ("k4",), ("new",)], "id string")
    change = lambda rows: rows.filter("id is null or id <> 'k3'").withColumn("n", F.when(F.col("id") == "k4", -1).otherwise(F.col("n"))).unionByName(spark.createDataFrame([("new", 7)], ROWS))
    assert t.update(keys, change) == 3
    want = {r.id: r.n + 1 for r in first.collect()} | {"k4": -1, "new": 7}
    want.pop("k3")
    assert {r.id: r.n for r in t.read().collect()} == want
    touched = {str(r[0]) for r in keys.select(t._bucket("id")).collect()}
    after = t.manifest()["buckets"]
    assert {b for b in {*before, *after} if before.get(b) != after.get(b)} == touched and 0 < len(touched) <= 3
    assert {r.id for r in t.read(keys).collect()} < set(want) and {"k4", "new"} <= {r.id for r in t.read(keys).collect()}
    assert t.vacuum() >= 1 and {r.id: r.n for r in t.read().collect()} == want
    with pytest.raises(ValueError):
        t.update(keys.limit(1), lambda rows: rows.unionByName(spark.createDataFrame([(f"x{i}", 0) for i in range(40)], ROWS)))
    assert t.replace(first.limit(0)) == 4 and t.read().count() == 0 and json.loads(t.manifest()["schema"])["fields"][0]["name"] == "id"


def test_merge_of_touched_keys_equals_a_whole_recompute(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]
    heads = [" ".join(rng.sample(words, 14)) for _ in range(60)]
    heads += heads[:8] + [h.upper() for h in heads[8:14]] + [h.rsplit(" ", 1)[0] + " other" for h in heads[14:24]]
    events = [(f"e{i:02}", h, float(1000 + i), float(2000 + i), 99, "x") for i, h in enumerate(heads)] + [("orphan", "alone here", 1.0, 1500.0, 0, "x"), ("linked", "market here", 1.0, 1500.0, 0, "x")]
    articles = [(f"a{i}", f"e{rng.randrange(len(heads)):02}", float(rng.randrange(5000)), i) for i in range(300)]
    claims = [(f"e{rng.randrange(len(heads)):02}", i) for i in range(100)]
    markets = [("m1", "linked"), ("m2", "e60"), ("m3", None)]
    e = spark.createDataFrame(events, "cluster_id string, headline string, earliest_timestamp double, latest_timestamp double, source_count long, more string")
    frames = {
        "articles": spark.createDataFrame(articles, "id string, cluster_id string, ts double, n long"),
        "claims": spark.createDataFrame(claims, "cluster_id string, n long"),
        "markets": spark.createDataFrame(markets, "id string, linked_cluster_id string"),
    }
    now = spark.createDataFrame([(2100.0,)], "as_of double")
    # counts that are right for what is not touched
    e = M.refreshed_events(e, frames["articles"])
    merges = D.merge_map(e, now)
    want_events, want = M.merged(e, frames, merges)
    table = PublishedTable(spark, str(tmp_path / "events"), "cluster_id", buckets=200)
    table.replace(e)
    tables = {name: PublishedTable(spark, str(tmp_path / name), "linked_cluster_id" if name == "markets" else "cluster_id", buckets=200) for name in frames}
    for name, t in tables.items():
        t.replace(frames[name])
    before = table.manifest()["buckets"]
    assert M.merge_published(table, tables, now) == merges.count() >= 20
    assert rows_of(table.read()) == rows_of(want_events)
    for name, t in tables.items():
        assert rows_of(t.read()) == rows_of(want[name].select(t.read().columns)), name
    got = {r.cluster_id for r in table.read().collect()}
    assert "orphan" not in got and "linked" in got and not got & {r.cluster_id for r in merges.collect()}
    assert sum(before[b] == f for b, f in table.manifest()["buckets"].items()) >= 15  # files of events that no merge touches stay
    places = M.article_places(tables["articles"].read())
    assert {r.cluster_id: r.n for r in places.groupBy("cluster_id").agg(F.max("position").alias("n")).collect()} == {r.cluster_id: r.source_count - 1 for r in table.read().filter("source_count > 0").collect()}
    assert M.merge_published(table, tables, now) == 0  # nothing is left to merge


def test_centroids_follow_changes(spark):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 1) for _ in range(5)]
    kinds = "id long, cluster_id string, embedding array<double>"
    now = {i: (f"c{i % 7}", vector()) for i in range(120)}
    frame = lambda x: spark.createDataFrame([(i, *v) for i, v in x.items()], kinds)
    state = S.summed(frame(now)).checkpoint()
    for step in range(3):
        ids = rng.sample(sorted(now), 30)
        old = {i: now[i] for i in ids}
        new = {i: (f"c{rng.randrange(9)}" if k % 3 else now[i][0], vector() if k % 2 else now[i][1]) for k, i in enumerate(ids[:20])}
        new |= {1000 * (step + 1) + k: ("late" if k else None, vector()) for k in range(4)}
        if step == 2:
            ids = [i for i in now if now[i][0] == "c1" or i in ids]  # a whole cluster goes
            old = {i: now[i] for i in ids}
            new = {i: v for i, v in new.items() if v[0] != "c1"}
        now = {i: v for i, v in now.items() if i not in old} | new
        state = S.changed(state, *S.changes_of(frame(old), frame(new))).checkpoint()
        want = {r.cluster_id: (r.members, [round(x, 9) for x in r.centroid]) for r in E.centroids(frame(now).filter("cluster_id is not null")).collect()}
        assert {r.cluster_id: (r.members, [round(x, 9) for x in r.centroid]) for r in S.means(state).collect()} == want
    assert "c1" not in want
    assert rows_of(state) == rows_of(S.summed(frame(now)))  # to the last digit
    assert S.changed(state, frame(now).limit(0), frame(now)).count() == 0
