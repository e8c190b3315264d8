import random

from pyspark.sql import functions as F

from newsloom.operators import assign as N
from newsloom.operators import containment as O


def test_pairs_equal_a_nested_loop(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("aab b" if rng.random() < 0.7 else "xyzé😀\\%_") for _ in range(n))
    texts = list({word(rng.randint(0, 14)) for _ in range(250)}) + ["aaaaaaaaaa", "aaab", "aaa"]
    patterns = list({word(rng.randint(0, 6)) for _ in range(200)}) + ["aaa", "a", "aaaa", "zzzz"]
    frame = lambda x, name: spark.createDataFrame([(v,) for v in [*x, *x[:5], None]], f"{name} string")
    got = O.containing(frame(patterns, "pattern"), frame(texts, "text"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [tuple(r) for r in got.collect()]
    want = {(p, t) for p in patterns for t in texts if p and p in t}
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want
    assert O.containing(frame([], "pattern"), frame(texts, "text")).count() == 0 == O.containing(frame(patterns, "pattern"), frame([], "text")).count()


def test_candidates_by_part_of_a_name(spark):
    articles = [("1", ["Harbor", "x"]), ("2", ["COUNCIL"]), ("3", []), ("4", None), ("5", ["Ann Lee", "Ann", "Lee", "Oslo", "Limas", "q"])]
    events = [("e1", ["Harbor Council"], 100.0), ("e2", ["harbor", "X-ray"], 200.0), ("e3", ["Ann Leeward", "Oslo"], 150.0), ("e4", ["Harbor"], -90_000.0), ("e5", None, 1.0)]
    a = spark.createDataFrame(articles, "id string, entities array<string>")
    e = spark.createDataFrame(events, "cluster_id string, entities array<string>, latest_timestamp double")
    now = spark.createDataFrame([(200.0,)], "as_of double")
    got = sorted(map(tuple, N.contained_candidates(a, e, now).collect()))
    assert got == [("1", "e1", 1), ("1", "e2", 2), ("2", "e1", 1), ("5", "e3", 4)]
    assert sorted(map(tuple, N.contained_candidates(a, e, now, limit=1).filter(F.col("id") == "1").collect())) == [("1", "e2", 2)]
