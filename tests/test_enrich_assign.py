from newsloom.operators import assign as N
from newsloom.operators import enrich as R
from newsloom.sources import payloads as P


def test_pages_enrich_short_articles(spark):
    body = "word " * 40
    arts = spark.createDataFrame([("1", "u1", "short", "rss"), ("2", "u2", "w " * 150, "rss"), ("3", "u1", "short", "api"), ("4", "", "short", "rss")], "id string, url string, text string, source_type string")
    pages = spark.createDataFrame([("u1", f"<p>{body}</p>"), ("u2", f"<p>{body}</p>")], "url string, html string")
    got = {r.id: (len(r.text.split()), r.source_type) for r in R.with_page_bodies(arts, pages).collect()}
    assert got == {"1": (40, "scrape"), "2": (150, "rss"), "3": (40, "api"), "4": (1, "rss")}


def test_market_prices(spark):
    events = spark.createDataFrame([("c", None, None, None, None), ("d", None, 0.5, 1.0, "q")], "cluster_id string, price_history array<struct<timestamp:double,probability:double>>, market_odds double, market_volume double, market_question string")
    markets = spark.createDataFrame([("m", 0.3, 5.0, "Q?"), ("n", 0.4, 9.0, "R?")], "id string, probability double, volume double, question string")
    matches = spark.createDataFrame([("c", "m"), ("c", "n")], "cluster_id string, id string")
    got = {r.cluster_id: r for r in R.with_market_prices(events, matches, markets, 7.0).collect()}
    assert (got["c"].market_odds, got["c"].market_question, [tuple(p) for p in got["c"].price_history]) == (0.4, "R?", [(7.0, 0.4)])
    assert (got["d"].market_odds, got["d"].price_history) == (0.5, None)


def test_shift(spark):
    df = spark.createDataFrame([(0.6, [(90000.0, 0.4), (95000.0, 0.5)]), (0.6, [(1.0, 0.1)]), (0.5, [])], "c double, h array<struct<timestamp:double,probability:double>>")
    assert [tuple(r.s) for r in df.select(R.shift_from_history("c", "h", 100000.0).alias("s")).collect()] == [(0.2, True, "up"), (0.0, False, "flat"), (0.0, False, "flat")]


def test_replies_and_provider(spark):
    df = spark.createDataFrame([('<think>hm</think>```json\n[{"who": "A", "what": "B"}]\n```',), ("no json",)], "r string")
    got = [r.c for r in df.select(R.parse_reply("r").alias("c")).collect()]
    assert [tuple(x) for x in got[0]] == [("A", "B")] and not got[1]
    titles = spark.createDataFrame([("Senator slams rival",)], "title string")

    def broken(_):
        raise RuntimeError

    assert R.with_provider(titles).first().neutral_title == R.with_provider(titles, broken).first().neutral_title == "Senator criticizes rival"
    assert R.with_provider(titles, lambda ts: [t.upper() for t in ts]).first().neutral_title == "SENATOR SLAMS RIVAL"


def test_assignment_rules(spark):
    events = spark.createDataFrame(
        [("e1", "Harbor bridge opens", "", ["Harbor Council"], 99000.0, 3), ("e2", "Copper exports rise sharply again", "", ["Copper Board"], 98000.0, 2), ("e3", "Votes counted", "", [], 97000.0, 60)],
        "cluster_id string, headline string, summary string, entities array<string>, latest_timestamp double, source_count long",
    )
    articles = spark.createDataFrame([("1", " HARBOR bridge opens ", "", [], [0.0, 1.0]), ("2", "Copper exports rise sharply again", "x", ["Copper Board"], None), ("3", "Nothing alike here", "", [], [0.0, 1.0]), ("4", "Unrelated words entirely", "", [], None)], "id string, title string, text string, entities array<string>, embedding array<double>")
    centres = spark.createDataFrame([("e2", [0.0, 2.0]), ("e3", [0.0, 3.0])], "cluster_id string, centroid array<double>")
    now = spark.createDataFrame([(100000.0,)], "as_of double")
    got = {r.id: (r.cluster_id, r.how) for r in N.assign_articles(articles, events, now, centres).collect()}
    assert got == {"1": ("e1", "exact"), "2": ("e2", "exact"), "3": ("e2", "centroid"), "4": (None, None)}


def test_mirrors(spark):
    xml = "<rss><channel><title>@a</title><item><title>Post</title><link>https://mirror.test/a/status/1</link></item></channel></rss>"
    raw = spark.createDataFrame([(xml,)], "xml string")
    r = P.mirrored_social(raw, 1.0, "https://mirror.test", "a").first()
    assert (r.url, r.publisher, r.source_type) == ("https://x.com/a/status/1", "Twitter/X/@a", "social")
    assert P.bridged_social(raw, 1.0, "TikTok/@b", 5).first().publisher == "TikTok/@b"
