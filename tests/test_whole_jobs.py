"""Cases that an operator once left out."""

import random

from pyspark.sql import functions as F


def _recall(spark, folder, which):
    from newsloom.operators import vectors as E

    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter(which)
    exact = {(r.query_id, r.id) for r in E.nearest(v, q, 5, -2.0).collect()}
    near = [(r.query_id, r.id) for r in E.nearest_lsh(v, q, 5, 64).collect()]
    assert len(near) == len(set(near)) == len(exact)
    return len(exact & set(near)) / len(exact)


def test_lsh_recall_of_the_stated_queries(spark):
    assert _recall(spark, "/root/testdata/sf0.001", "id < 10") >= 0.9
    assert _recall(spark, "/root/testdata/sf0.1", "id % 100 = 0") >= 0.9


def test_lsh_searches_all_rows_where_candidates_are_few(spark):
    from newsloom.operators import vectors as E

    near = [(i, [1.0 + i / 1000, float(i % 7) / 10]) for i in range(400)]
    for rows in (near[:150] + [(900, [-1.0, -0.1])], near + [(900, [-1.0, -0.1]), (901, None)]):  # a small table; a query alone on its side
        v = spark.createDataFrame(rows, "id long, embedding array<double>")
        q = v.filter("id >= 900 or id < 2")
        want = sorted(map(tuple, E.nearest(v.filter("embedding is not null"), q.filter("embedding is not null"), 3, -2.0).collect()))
        got = sorted(map(tuple, E.nearest_lsh(v, q, 3, 2, probe=0).collect()))
        assert [r for r in got if r[0] == 900] == [r for r in want if r[0] == 900] and len(got) == len(want) == 9


def _share_a_band(x):
    return any((x >> 8 * i) & 255 == 0 for i in range(8))


def test_pairs_of_common_bands_are_found(spark):
    from newsloom.operators import dedup as D

    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(2)]
    rows = [hashes[i % 2] for i in range(30)]  # equal ones
    while len(rows) < 300:
        rows.append(hashes[len(rows) % 2] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(rows)]
    want = {(i, j, (rows[i] ^ rows[j]).bit_count()) for j in range(300) for i in range(j) if (rows[i] ^ rows[j]).bit_count() <= 9 and _share_a_band(rows[i] ^ rows[j])}
    got = [tuple(r) for r in D.banded_pairs(spark.createDataFrame(signed, "id long, h long"), "id", "h", 9).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_events_of_common_headlines_merge(spark):
    from newsloom.functions.similarity import simhash_column
    from newsloom.operators import dedup as D

    text = "storm nears the northern coast as thousands leave their homes and ports close for the week while ships wait"
    events = spark.createDataFrame([(f"e{i:03}", f"{text} item{i // 2} {'again' if i % 2 else ''}", float(i * 7 % 300), 1000.0) for i in range(300)], "cluster_id string, headline string, earliest_timestamp double, latest_timestamp double")
    now = spark.createDataFrame([(1000.0,)], "as_of double")
    h = [(r.t, r.cluster_id, r.h & (2**64 - 1)) for r in events.select(F.col("earliest_timestamp").alias("t"), "cluster_id", simhash_column(F.lower(F.trim("headline"))).alias("h")).collect()]
    close = lambda a, b: (a ^ b).bit_count() <= 9 and _share_a_band(a ^ b)
    want = {e[1]: min(x for x in h if x < e and close(x[2], e[2]))[1] for e in h if any(x < e and close(x[2], e[2]) for x in h)}
    assert len(want) > 250
    end = lambda x: end(want[x]) if x in want else x
    want = {x: end(x) for x in want}
    assert not set(want) & set(want.values())
    assert {r.cluster_id: r.primary_id for r in D.merge_map(events, now).collect()} == want


def test_events_are_inserted_rescored_and_looked_up(spark):
    from newsloom.operators import lookups as U
    from newsloom.operators import maintenance as W
    from newsloom.sources import configured as C

    now = spark.createDataFrame([(4_000.0,)], "as_of double")
    seeds = C.seed_events(spark)
    empty = spark.createDataFrame([], "cluster_id string")
    rows = W.insert_events(empty, seeds.unionByName(seeds), now)
    assert rows.count() == 3 and W.insert_events(rows, seeds, now).count() == 0
    assert all(0 < r.impact_score <= 100 and r.impact in ("low", "medium", "high") and r.neutral_headline for r in rows.collect())
    assert U.event(rows, "seed-2").count() == 1 and U.event(rows, "none").count() == 0
    assert W.rescored(rows.limit(0), now).count() == 0
    try:
        W.add_columns(rows, {"x": "string"}, ("y",))
        raise AssertionError("a column that is not allowed was added")
    except ValueError:
        pass
    assert W.add_columns(rows, {"y": "string"}, ("y",)).columns[-1] == "y"


def test_pairs_of_articles_are_scored(spark):
    from newsloom.operators import lookups as U

    rows = [("storm nears coast", "storm nears coast", ["Coast"], [1.0, 0.0]), ("storm nears coast", "bridge reopens", ["Bridge"], None), ("", "", None, None)]
    x = spark.createDataFrame([(a, b, e, v) for a, b, e, v in rows], "title1 string, title2 string, entities1 array<string>, embedding1 array<double>")
    x = x.selectExpr("*", "'' AS text1", "'' AS text2", "array('coast') AS entities2", "array(1.0D, 0.0D) AS embedding2")
    got = U.duplicate_scores(x).collect()
    assert got[0].overall > 0.99 and got[0].is_duplicate and not got[1].is_duplicate and got[2].entity_similarity == 0


def test_links_feeds_and_live_markets(spark):
    from newsloom.sources import configured as C

    assert [r.url for r in C.feeds(spark, " a , b,", ("c",)).collect()] == ["a", "b"] and C.feeds(spark, "", ("c",)).count() == 1
    assert C.callsheet_markets(spark).count() == 0
    m = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "id string, url string")
    assert [r.id for r in C.live_links(m, check=lambda u, t: u == "good").collect()] == ["1"]


def test_text_helpers(spark):
    from newsloom.functions import text as X

    row = spark.createDataFrame([("https://www.feeds.a.org/x?b=1&utm_source=q&c=d%20e*&b=2&bad=%zz&n=", ["Traders Now See Chance Today", "The Harbor", "Oil Prices", "Ann Lee"], "&eacute;&#233;&hellip; <b>x</b>", "x" * 70)], "u string, e array<string>, h string, p string")
    got = row.select(X.strip_tracking("u").alias("u"), X.feed_host("u").alias("f"), X.clean_entities("e").alias("e"), X.clean_html("h").alias("h"), X.short_publisher("p").alias("p"), X.joined_list("e").alias("j"), X.relative_time(F.lit(100.0), 4000.0).alias("r")).first()
    assert got.u == "https://www.feeds.a.org/x?b=1&b=2&c=d+e%2A&bad=%25zz" and got.f == "a.org"
    assert got.e == ["Harbor", "Oil", "Ann Lee"] and got.h == "éé… x" and len(got.p) == 60 and got.j.startswith("Traders Now") and got.r == "1h ago"


def test_stream_assigns_articles_and_opens_events(spark, tmp_path):
    from newsloom.streaming import ingest as I

    kinds = "id string, title string, text string, entities array<string>, ts double"
    rows = [("1", "Harbor bridge reopens", "t", ["Harbor"], 1.0), ("2", "harbor bridge reopens ", "t", ["Harbor"], 2.0), ("3", "Copper exports rise", "t", ["Copper"], 3.0)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: I.assign_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("4", "Copper exports rise", "t", ["Copper"], 9.0), ("5", "", "t", [], 10.0)], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.id: r.cluster_id for r in spark.read.parquet(str(tmp_path / "out" / "articles")).collect()}
    assert got == {"1": "event-1", "2": "event-1", "3": "event-3", "4": "event-3", "5": "event-5"}
    assert sorted(r.cluster_id for r in spark.read.parquet(str(tmp_path / "out" / "events")).collect()) == ["event-1", "event-3", "event-5"]


def test_addresses_that_fail_give_no_row(spark):
    from newsloom.sources import web

    web.register(spark)
    assert spark.read.format("newsloom_web").option("urls", "http:// not-an-address http://127.0.0.1:9/x").option("timeout", "1").load().count() == 0
    polls = web.WebPolls({"urls": "junk"})
    rows, end = polls.read(polls.initialOffset())
    assert list(rows) == [] and end == {"polls": 1}


def test_first_disputes_are_the_first_of_all(spark):
    from newsloom.operators import claims as C

    rng = random.Random(3)
    words = ["Exports rise", "exports fall", "profit growth", "a decline", "support", "oppose the plan", "nothing new", "", "  ", None]
    rows = [(rng.choice("ab"), rng.randrange(20), i, rng.choice(words)) for i in range(80)]
    claims = spark.createDataFrame(rows + rows[:5], "cluster_id string, doc_id long, seq long, what string")
    pairs = C.disputed_claims(claims.selectExpr("cluster_id", "doc_id * 1000 + seq AS seq", "what")).collect()
    want = {}
    for r in pairs:
        want[r.cluster_id, r.seq] = min(want.get((r.cluster_id, r.seq), (r.earlier_seq, "")), (r.earlier_seq, r.contradiction))
    got = {(r.cluster_id, r.doc_id * 1000 + r.seq): r.contradiction for r in C.first_disputes(claims).collect()}
    assert got and got == {k: v[1] or next(r.contradiction for r in pairs if (r.cluster_id, r.seq, r.earlier_seq) == (*k, v[0])) for k, v in want.items()}
    assert C.first_disputes(claims.limit(0)).count() == 0


def test_questions_match_as_all_against_all_would(spark):
    from newsloom.functions.lexicons import QUESTION_STOPWORDS
    from newsloom.operators import markets as K

    rng = random.Random(4)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnop"]
    line = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((3, 16))]) for _ in range(n))
    asked = [(f"m{i}", line(rng.randrange(9))) for i in range(60)] + [("null", None), ("empty", "")]
    events = [(i, line(rng.randrange(7)), [line(1)] if i % 3 else None) for i in range(40)] + [(40, None, None), (41, "", [])]
    got = {r.id: (r.position, round(r.score, 9)) for r in K.match_events(spark.createDataFrame(asked, "id string, question string"), spark.createDataFrame(events, "position long, headline string, entities array<string>")).collect()}
    want = {}
    for name, question in asked:
        q = set((question or "").split()) - set(QUESTION_STOPWORDS)
        for position, headline, names in events if len(q) >= 2 else ():
            e = set(names or [])
            share, hits = len(q & (e | set((headline or "").split()))) / len(q), len(q & e)
            if (hits >= 1 and share >= 0.3) or share >= 0.6:
                want[name] = max(want.get(name, (-1, 0)), (share + hits * 0.2, -position))
    assert len(want) > 20 and got == {k: (-p, round(s, 9)) for k, (s, p) in want.items()}
