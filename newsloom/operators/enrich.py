"""Enrichment: page bodies for short articles, market prices for events, and an optional text provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_body, neutral_headline, word_count

SHORT = 100  # words under which an article's page is worth reading
REPLY_CHARS = 8000


def with_page_bodies(articles: DataFrame, pages: DataFrame, least: int = SHORT) -> DataFrame:
    """Short articles take the body of their page (url, html), if it has one; feed articles then count as scraped.

    Only the links of short articles meet the pages, and bodies are extracted after that join.
    """
    short = (word_count("text") < least) & (F.coalesce("url", F.lit("")) != "")
    wanted = articles.filter(short).select("url").distinct()
    bodies = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html")).select("url", article_body("html").alias("body"))
    x = articles.join(bodies.filter("body is not null"), "url", "left").withColumn("__use", short & F.col("body").isNotNull())
    kind = F.when(F.col("__use") & (F.col("source_type") == "rss"), "scrape").otherwise(F.col("source_type"))
    return x.withColumn("source_type", kind).withColumn("text", F.when(F.col("__use"), F.col("body")).otherwise(F.col("text"))).select(*articles.columns)


def scraped(articles: DataFrame, fetch: Callable[[DataFrame], DataFrame], least: int = SHORT) -> DataFrame:
    """Short articles with the bodies of their pages, fetched now: `fetch` gives (url, html) of links, as sources.web.fetched_pages does."""
    short = (word_count("text") < least) & (F.coalesce("url", F.lit("")) != "")
    pages = fetch(articles.filter(short).select("url")).checkpoint()  # a page is fetched once, whoever reads it
    return with_page_bodies(articles, pages, least)


def with_market_prices(events: DataFrame, matches: DataFrame, markets: DataFrame, as_of: float) -> DataFrame:
    """Events with the odds, volume and question of their matched market and one more price point.

    matches: cluster_id, id (of the market).  Of several markets of an event the one of largest volume counts.
    """
    m = matches.join(markets.select("id", "probability", "volume", "question"), "id")
    best = m.groupBy("cluster_id").agg(F.max_by(F.struct("probability", "volume", "question"), F.struct("volume", "id")).alias("__m"))
    x = events.join(best, "cluster_id", "left")
    point = F.struct(F.lit(float(as_of)).alias("timestamp"), F.col("__m.probability").alias("probability"))
    has = F.col("__m").isNotNull()
    history = F.coalesce("price_history", F.array().cast("array<struct<timestamp:double,probability:double>>"))
    x = x.withColumn("price_history", F.when(has, F.array_append(history, point)).otherwise(F.col("price_history")))
    for name, field in (("market_odds", "probability"), ("market_volume", "volume"), ("market_question", "question")):
        x = x.withColumn(name, F.when(has, F.col(f"__m.{field}")).otherwise(F.col(name)))
    return x.drop("__m")


def shift_from_history(current: Column | str, history: Column | str, as_of: float, hours: int = 24) -> Column:
    """Struct of shift, is_significant and direction of the current price against the oldest of the last hours."""
    c = F.col(current) if isinstance(current, str) else current
    h = F.col(history) if isinstance(history, str) else history
    recent = F.array_sort(F.filter(h, lambda p: p["timestamp"] >= float(as_of) - hours * 3600.0))
    shift = F.coalesce(c - F.get(recent, F.lit(0))["probability"], F.lit(0.0))
    direction = F.when(shift > 0.01, "up").when(shift < -0.01, "down").otherwise("flat")
    return F.struct(F.round(shift, 4).alias("shift"), (F.abs(shift) >= 0.10).alias("is_significant"), direction.alias("direction"))


def parse_reply(reply: Column | str, schema: str = "array<struct<who:string,what:string>>") -> Column:
    """The JSON of a model's reply without its thinking and code fence; null if it is none."""
    r = F.regexp_replace(F.col(reply) if isinstance(reply, str) else reply, r"(?s)<think>.*?</think>", "")
    r = F.regexp_replace(F.trim(r), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return F.from_json(F.trim(r), schema)


def with_provider(articles: DataFrame, provider: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds neutral_title: from a provider of texts, called once a batch in tasks, else by rule.

    A provider that fails leaves null, and the rule fills in; it sees at most REPLY_CHARS characters of a title.
    """
    rule = articles.withColumn("__rule", neutral_headline("title"))
    if provider is None:
        return rule.withColumnRenamed("__rule", "neutral_title")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                frame["neutral_title"] = provider([str(t or "")[:REPLY_CHARS] for t in frame["title"]])
            except Exception:  # a provider is outside this engine: whatever it raises, the rule answers
                frame["neutral_title"] = None
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rule.schema) + ", neutral_title string"
    return rule.mapInPandas(ask, schema).withColumn("neutral_title", F.coalesce("neutral_title", "__rule")).drop("__rule")


FAILURES, PAUSE = 3, 60.0  # failures in a row after which a task asks nobody for that many seconds


def answered(texts: DataFrame, column: str, provider: Callable[[str], str], limit: int | None = None, order: str | None = None, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """`texts` with the column reply: a provider's answer to the first REPLY_CHARS characters of each text, null where there is none.

    It is asked by tasks, one text after another.  After FAILURES failures in a row a task leaves PAUSE seconds of its texts unasked, then
    tries again.  With `limit`, only that many rows, first by `order`, are asked; the others have no answer, as null and blank texts.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed, until = 0, float("-inf")
        for frame in frames:
            replies = []
            for text, wanted in zip(frame[column], frame["__ask"], strict=True):
                reply = None
                if wanted and isinstance(text, str) and text.strip() and clock() >= until:
                    try:
                        reply, failed = provider(text[:REPLY_CHARS]), 0
                    except Exception:  # a provider is outside this engine: whatever it raises, there is no answer
                        failed += 1
                        if failed >= FAILURES:
                            failed, until = 0, clock() + PAUSE
                replies.append(reply)
            yield frame.drop(columns="__ask").assign(reply=pd.Series(replies, index=frame.index, dtype=object))

    if limit is None:
        x = texts.withColumn("__ask", F.lit(True))
    else:
        first = texts.orderBy(order).limit(limit).select(F.col(order).alias("__o")).distinct()
        x = texts.join(first.withColumn("__ask", F.lit(True)), F.col(order).eqNullSafe(F.col("__o")), "left").drop("__o").withColumn("__ask", F.coalesce("__ask", F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", reply string"
    return x.mapInPandas(ask, schema)


def provided_claims(articles: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """(id, seq, who, what): claims that a provider finds in each article's text, as JSON in its reply; replies that are none give no rows."""
    replies = answered(articles.select("id", "text"), "text", provider)
    return replies.select("id", F.posexplode(parse_reply("reply")).alias("seq", "c")).select("id", "seq", "c.who", "c.what").filter("coalesce(what, '') <> ''")


def provided_verdicts(events: DataFrame, provider: Callable[[str], str], limit: int = 100) -> DataFrame:
    """Events with ai_relevant filled by a provider ("yes" or "no") where it is null, for `limit` of these at most, by cluster_id; other replies leave it null."""
    open_ = events.filter("ai_relevant is null").select("cluster_id", F.concat_ws("\n", "headline", "summary").alias("told"))
    told = answered(open_, "told", provider, limit, "cluster_id").select("cluster_id", F.lower(F.trim("reply")).alias("r"))
    verdict = F.when(F.col("r").startswith("yes"), F.lit(True)).when(F.col("r").startswith("no"), F.lit(False))
    return events.join(told, "cluster_id", "left").withColumn("ai_relevant", F.coalesce("ai_relevant", verdict)).drop("r").select(*events.columns)
