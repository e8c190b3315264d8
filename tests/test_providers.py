"""Pages and providers that are asked by tasks."""

import json

from pyspark.sql import functions as F

from newsloom.operators import enrich as R
from newsloom.sources import web


def test_short_articles_are_scraped(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def fetch(url, timeout):
        (log / f"{url}-{len(list(log.glob(url + '-*')))}").touch()
        return None if url == "u2" else (url, "<p>" + "word " * 40 + "</p>")

    arts = spark.createDataFrame([("1", "u1", "short", "rss"), ("2", "u2", "short", "rss"), ("3", "u3", "w " * 150, "rss"), ("4", "u1", "brief", "api"), ("5", None, "x", "rss")], "id string, url string, text string, source_type string")
    got = {r.id: (len(r.text.split()), r.source_type) for r in R.scraped(arts, lambda links: web.fetched_pages(links, 1.0, fetch)).collect()}
    assert got == {"1": (40, "scrape"), "2": (1, "rss"), "3": (150, "rss"), "4": (40, "api"), "5": (1, "rss")}
    assert sorted(p.name for p in log.iterdir()) == ["u1-0", "u2-0"]


def test_a_failing_provider_is_left_alone_for_a_while(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def provider(text):
        (log / text).touch()
        if text.startswith("bad"):
            raise OSError
        return text.upper()

    ticks = iter(range(10**6))
    texts = [f"bad{i}" for i in range(3)] + [f"lost{i}" for i in range(20)] + [None, " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = {r.id: r.reply for r in R.answered(df, "text", provider).collect()}
    assert set(got.values()) == {None} and sorted(p.name for p in log.iterdir()) == ["bad0", "bad1", "bad2"]
    # with a clock by which the pause passes while texts go by
    clock = lambda: next(ticks) * 10.0
    got = {r.id: r.reply for r in R.answered(df, "text", provider, clock=clock).collect()}
    assert got[3] is None and got[22] == "LOST19" and got[23] is None and got[24] is None
    got = {r.id: r.reply for r in R.answered(df.filter("text like 'lost%'"), "text", provider, 2, "id").collect()}
    assert [k for k, v in got.items() if v] == [3, 4] and len(got) == 20


def test_claims_and_verdicts_of_a_provider(spark):
    claims = lambda text: f"<think>x</think>```json\n{json.dumps([{'who': 'A', 'what': text}, {'who': 'B', 'what': ''}])}\n```" if "fact" in text else "none"
    arts = spark.createDataFrame([("1", "a fact"), ("2", "nothing"), ("3", None)], "id string, text string")
    assert [tuple(r) for r in R.provided_claims(arts, claims).collect()] == [("1", 0, "A", "a fact")]
    events = spark.createDataFrame([("a", "AI chip", "s", None), ("b", "Storm", None, None), ("c", "AI", "s", False), ("d", "AI law", "s", None), ("e", "odd", "s", None)], "cluster_id string, headline string, summary string, ai_relevant boolean")
    verdict = lambda text: "Yes." if "AI" in text else "no" if "Storm" in text else "perhaps"
    got = {r.cluster_id: r.ai_relevant for r in R.provided_verdicts(events, verdict, 3).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": None}
    assert R.provided_verdicts(events, verdict, 1).filter(F.col("ai_relevant")).count() == 1
