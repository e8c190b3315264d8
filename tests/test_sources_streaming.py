import json

from newsloom.operators import maintenance as W
from newsloom.sources import payloads as P
from newsloom.streaming import ingest as I

NOW = 1_700_000_000.0


def test_rss(spark):
    xml = """<rss><channel><title>Coast Daily</title>
    <item><title>Storm nears</title><link>https://c.org/a?utm_source=x</link><description>&lt;p&gt;Wind rises.&lt;/p&gt;</description><pubDate>Mon, 06 Nov 2023 10:00:00 GMT</pubDate></item>
    <item><title> </title><link>https://c.org/b</link></item></channel></rss>"""
    rows = P.rss(spark.createDataFrame([(xml,), ("<broken",)], "xml string"), NOW).collect()
    assert [(r.title, r.publisher, r.url, r.text, r.timestamp) for r in rows] == [("Storm nears", "Coast Daily", "https://c.org/a", "Wind rises.", 1699264800.0)]


def test_atom(spark):
    xml = '<feed><title>Hill News</title><entry><title>Bridge opens</title><link href="https://h.org/x?ref=1"/><summary>Soon</summary><author><name>Ann</name></author><updated>2023-11-06T10:00:00Z</updated></entry></feed>'
    r = P.atom(spark.createDataFrame([(xml,)], "xml string"), NOW).first()
    assert (r.title, r.publisher, r.author, r.url, r.text, r.timestamp) == ("Bridge opens", "Hill News", "Ann", "https://h.org/x", "Soon", 1699264800.0)


def test_social(spark):
    hn = [{"id": 7, "type": "story", "title": "A", "score": 5, "descendants": 2, "by": "u", "time": 9}, {"id": 8, "type": "job", "title": "B"}]
    rows = P.hacker_news(spark.createDataFrame([(json.dumps(x),) for x in hn], "json string")).collect()
    assert [(r.url, r.social_coverage, r.text) for r in rows] == [("https://news.ycombinator.com/item?id=7", 7, "HN discussion: A")]
    post = lambda **k: {"data": {"title": "T", "score": 1, "num_comments": 2, "author": "a", "created_utc": 1.0, "permalink": "/r/x/1", "subreddit": "x", "stickied": False, "selftext": "", "url": ""} | k}
    listing = {"data": {"children": [post(), post(stickied=True), post(url="https://o.org/z?utm_term=1")]}}
    rows = P.reddit(spark.createDataFrame([(json.dumps(listing),)], "json string")).collect()
    assert [(r.url, r.publisher, r.social_coverage) for r in rows] == [("https://www.reddit.com/r/x/1", "Reddit/r/x", 3), ("https://o.org/z", "Reddit/r/x", 3)]


def test_markets(spark):
    events = [{"slug": "s", "endDate": "e", "description": "d", "markets": [{"question": "Q?", "outcomePrices": '["0.4", "0.6"]', "volume": 5.0}, {"question": "Sure?", "outcomePrices": '["0.99"]'}, {"question": ""}]}]
    rows = P.polymarket(spark.createDataFrame([(json.dumps(events),)], "json string")).collect()
    assert [(r.question, r.probability, r.slug, r.end_date) for r in rows] == [("Q?", 0.4, "s", "e")]
    k = {"markets": [{"title": "K?", "yes_bid": 40, "yes_ask": 50, "ticker": "KX"}, {"title": "L?", "last_price": 30, "ticker": "LX"}]}
    assert [r.probability for r in P.kalshi(spark.createDataFrame([(json.dumps(k),)], "json string")).collect()] == [0.45, 0.3]


def test_probability_of_junk(spark):
    df = spark.createDataFrame([('["0.7"]',), ("[]",), ("junk",), (None,), ('["x"]',)], "o string")
    assert [r.p for r in df.select(P.probability("o").alias("p")).collect()] == [0.7, 0.0, 0.0, 0.0, 0.0]


def test_inserts_skip_known_links(spark):
    cols = "id string, url string, ingest_seq long"
    table = spark.createDataFrame([("a", "u1", 1)], cols)
    new = spark.createDataFrame([("b", "u1", 2), ("c", "u2", 3), ("d", "u2", 4), ("e", "", 5), ("f", "", 6)], cols)
    assert sorted(r.id for r in W.insert_articles(table, new).collect()) == ["c", "e", "f"]


def test_upsert_by_slug_then_question(spark):
    cols = "id string, slug string, question string, ts double"
    table = spark.createDataFrame([("1", "a", "A?", 1.0), ("2", "b", "B?", 1.0)], cols)
    new = spark.createDataFrame([("x", "a", "A2?", 2.0), ("y", "z", "B?", 2.0), ("w", "n", "N?", 2.0)], cols)
    assert sorted((r.id, r.slug) for r in W.upsert_markets(table, new).collect()) == [("1", "a"), ("2", "z"), ("w", "n")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), str(i % 3), "p", "t", f"u{i % 7}", 1000.0 + i, "social" if i % 2 else "rss", i) for i in range(20)]
    for k in range(0, 20, 5):
        spark.createDataFrame(rows[k : k + 5], I.ARTICLE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = I.read_articles(spark, str(tmp_path / "in"))
    q = I.append_new(I.unseen(stream).drop("event_time"), str(tmp_path / "table"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "table")).collect()) == sorted(f"u{i}" for i in range(7))
    out = I.rollups(stream).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    from newsloom.operators.coverage import cluster_rollup

    batch = cluster_rollup(spark.createDataFrame(rows, I.ARTICLE_SCHEMA))
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, batch.collect()))
