"""Articles led to events in batches equal a loop that takes them one by one."""

import hashlib
import random
import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import neutral_headline
from newsloom.operators import leaders as G
from newsloom.streaming import ingest as I

KINDS = "id string, title string, text string, entities array<string>, ts double"


@cache
def simhash(text):
    words = re.findall(r"\w+", text.lower())
    hashes = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_by_one(articles, neutral, events=()):
    """id -> (event, how); events: [(event, headline, summary, entities, latest)]"""
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    join = lambda *x: " ".join(x)
    there = [(e, h.lower().strip(), h, s, ents, latest) for e, h, s, ents, latest in events]
    out = {}
    for id_, title, text, entities, ts in sorted(articles, key=lambda a: (a[4], a[0])):
        key, text, names = title.lower().strip(), text or "", {x.lower() for x in entities or []}
        exact = [e for e, k, h, *_ in there if key and key in (k, neutral[h].lower().strip())]
        near, scored = [], []
        for at, (e, k, h, summary, ents, latest) in enumerate(there):
            if latest < ts - 86400:
                continue
            far = (simhash(key) ^ simhash(k)).bit_count()
            if key and k and far <= 9:
                near.append((far, at, e))
            other = {x.lower() for x in ents or []}
            share = len(names & other) / len(names | other) if names | other else 0.0
            score = like(simhash(title), simhash(h)) * 0.4 + like(simhash(join(title, text)), simhash(join(h, summary))) * 0.3 + share * 0.3
            if score > 0.70:
                scored.append((-score, at, e))
        if exact:
            out[id_] = (exact[0], "exact")
        elif near:
            out[id_] = (min(near)[2], "near")
        elif scored:
            out[id_] = (min(scored)[2], "score")
        else:
            out[id_] = (f"event-{id_}", "opened")
            there.append((f"event-{id_}", key, title, text[:300], entities, ts))
    return out


@pytest.fixture(scope="module")
def articles():
    """300 articles: chains in which each headline is near the next, copies, shared names, shouting, far times, ties."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    names = ["Harbor Council", "Copper Board", "Ann Lee", "Oslo", "Lima", "OPEC", "Delta Corp"]
    rows, n = [], 0

    def add(title, text=None, entities=None, ts=None):
        nonlocal n
        rows.append((f"{n:03}", title, text if text is not None else " ".join(rng.choice(vocabulary) for _ in range(30)), entities if entities is not None else rng.sample(names, rng.randint(0, 2)), float(ts if ts is not None else 100_000 + 7 * (n // 2))))
        n += 1

    for _ in range(6):  # headlines that drift word by word
        words = [rng.choice(vocabulary) for _ in range(24)]
        for step in range(20):
            add(" ".join(words))
            words[(step * 5) % 24] = rng.choice(vocabulary)
    for _ in range(40):
        add(rng.choice([r[1] for r in rows]).upper() if rng.random() < 0.3 else rng.choice([r[1] for r in rows]))
    for i in range(60):  # the same people and much the same words
        subject = vocabulary[i % 5 * 9 : i % 5 * 9 + 9]
        add(" ".join(subject[: 6 + i % 3]), " ".join(subject * 2 + rng.sample(vocabulary, i % 4)), [names[i % 5], *([names[6]] if i % 7 == 0 else [])])
    for i in range(70):
        add(f"{rng.choice(vocabulary)} SHOCKING {rng.choice(vocabulary)} slams {rng.choice(vocabulary)}!" if i % 3 else "Senator slams rival!", entities=[] if i % 2 else None, ts=100_000 + rng.randint(0, 300_000))
    add("Senator criticizes rival.", ts=401_000)
    add("", "", [])
    add("", "", [])
    for _ in range(7):
        add(rows[0][1], ts=400_000)
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def neutral(spark, articles):
    titles = sorted({r[1] for r in articles})
    return dict(map(tuple, spark.createDataFrame([(t,) for t in titles], "t string").select("t", neutral_headline("t")).collect()))


@pytest.mark.parametrize("local", [2000, 20])
def test_led_articles_equal_a_loop(spark, articles, neutral, local):
    none = spark.createDataFrame([], I.EVENT_KINDS + ", latest_timestamp double, source_count long")
    got = {r.id: (r.cluster_id, r.how) for r in G.led_articles(spark.createDataFrame(articles, KINDS), none, local).collect()}
    want = one_by_one(articles, neutral)
    assert len(want) == len(articles) and {h for _, h in want.values()} == {"exact", "near", "score", "opened"}
    assert got == want


def test_large_events_take_by_headline_only(spark, neutral, articles):
    event = [("e1", "Harbor bridge opens", "Harbor bridge opens", ["Oslo"], 1.0, 90_000.0, 60), ("e2", "Copper exports rise again", "", ["Lima"], 1.0, 90_000.0, 3)]
    events = spark.createDataFrame(event, I.EVENT_KINDS + ", latest_timestamp double, source_count long")
    rows = [("1", "harbor bridge opens", "", [], 95_000.0), ("2", "Harbor bridge opening", "Harbor bridge opens", ["Oslo"], 95_000.0), ("3", "copper exports rise again ", "", [], 900_000.0), ("4", "Copper exports rise again today", "", ["Lima"], 900_000.0)]
    got = {r.id: (r.cluster_id, r.how) for r in G.led_articles(spark.createDataFrame(rows, KINDS), events).collect()}
    assert got == {"1": ("e1", "exact"), "2": ("event-2", "opened"), "3": ("e2", "exact"), "4": ("event-4", "opened")}
    assert G.led_articles(spark.createDataFrame([], KINDS), events).count() == 0


def test_any_split_into_batches_gives_the_same_events(spark, articles, neutral, tmp_path):
    day = sorted((r for r in articles if r[4] < 186_000), key=lambda r: (r[4], r[0]))
    want = {k: v[0] for k, v in one_by_one(day, neutral).items()}
    cuts = [0, 50, 51, 170, len(day)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(day[a:b], KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        I.assign_stream(spark.readStream.schema(KINDS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    placed = spark.read.parquet(str(tmp_path / "out" / "articles"))
    assert {r.id: r.cluster_id for r in placed.collect()} == want and placed.select("batch").distinct().count() == 4
    known = {r.cluster_id: (r.source_count, r.latest_timestamp) for r in I.known_events(spark, str(tmp_path / "out"), 4).collect()}
    sizes = placed.groupBy("cluster_id").agg(F.count(F.lit(1)), F.max("ts")).collect()
    assert known == {r[0]: (r[1], r[2]) for r in sizes}


def test_near_hashes_are_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(3)]
    rows = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(60)})
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    got = [tuple(r) for r in G.near_hashes(spark.createDataFrame([(signed(h),) for h in rows], "h long")).collect()]
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in rows for b in rows if (a ^ b).bit_count() <= 9}
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_make_no_scored_pairs(spark):
    """Equal headlines meet at their key: their names bring no row for each pair; a pair that only its score joins is there."""
    rows = [(f"{i:03}", "Harbor Council votes on the Copper Board", "words of a text", ["Harbor Council"], 100_000.0 + i) for i in range(40)]
    rows += [("a", "", "one two three four", ["Oslo"], 100_500.0), ("b", "", "one two three four", ["Oslo"], 100_600.0), ("c", "", "one two three four", ["Oslo"], 300_000.0)]
    none = spark.createDataFrame([], I.EVENT_KINDS + ", latest_timestamp double, source_count long")
    nodes = G._nodes(spark.createDataFrame(rows, KINDS), none).withColumn("day", F.floor(F.col("place.ts") / G.RECENT))
    assert [(r.place.id, r.earlier.id) for r in G.scored_pairs(nodes).collect()] == [("b", "a")]


def test_near_hashes_of_two_days(spark):
    rows = [(5, 0b0), (5, 0b11), (6, 0b111), (7, (1 << 12) - 1), (8, 0b1), (9, 0b1)]
    known = spark.createDataFrame([(0b1000,), (-1,)], "h long")
    got = {tuple(r) for r in G.near_days(spark.createDataFrame(rows, "day long, h long"), known).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(h, d, g, d - e, bits(h, g)) for d, h in rows for e, g in rows if d - e in (0, 1) and bits(h, g) <= 9}
    want |= {(h, 0, g, 2, bits(h, g)) for _, h in rows for g in (0b1000, -1) if bits(h, g) <= 9}
    assert got == want


def test_rounds_send_no_table_through_the_driver(spark):
    """A round's tables grow with the articles: even where all are small, none is broadcast."""
    state = spark.createDataFrame([], "place struct<rank int, ts double, id string>, event string, key string, neutral string, h long, day long, seen double, opens boolean")
    near = spark.createDataFrame([], "h long, day long, other long, back int, distance int")
    pairs = spark.createDataFrame([], "place struct<rank int, ts double, id string>, earlier struct<rank int, ts double, id string>, score double")
    plan = G._round(state, near, pairs)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_disk_holds_what_one_round_shuffles(spark):
    """Shuffles of rounds that are over are removed while the loop goes on, whether the driver needs memory or not."""
    import time

    from newsloom.session import Rounds

    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size
    rounds, state, before = Rounds(spark), spark.range(50), held()
    for _ in range(12):
        state = rounds.write(state.groupBy((F.col("id") % 40).alias("id")).agg(F.count(F.lit(1)).alias("n")).select("id"))
    end = time.time() + 20
    while held() > before + 4 and time.time() < end:  # removed by a thread of the driver
        time.sleep(0.2)
    assert held() <= before + 4 and state.count() == 40
