"""Parsers of raw connector payloads: one string column in, normalised rows out, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, strip_boilerplate, strip_tracking, text_of

ARTICLE = ("title", "author", "publisher", "timestamp", "url", "text", "source_type", "social_coverage")
_ITEM = "title string, link string, description string, author string, creator string, `dc:creator` string, pubDate string"
RSS = f"channel struct<title string, item array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _ITEM.split(','))}>>>".replace("struct<title string", "struct<title:string").replace(", item array", ", item:array")
ATOM = "title string, entry array<struct<title:string,link:array<struct<_href:string>>,summary:string,content:string,author:struct<name:string>,updated:string>>"
EVENTS = "array<struct<slug:string,title:string,endDate:string,description:string,markets:array<struct<question:string,outcomePrices:string,volume:double,volume24hr:double,endDate:string,description:string>>>>"
KALSHI = "struct<markets:array<struct<title:string,subtitle:string,yes_bid:double,yes_ask:double,last_price:double,volume:double,volume_24h:double,ticker:string,close_time:string,expiration_time:string,rules_primary:string>>>"
REDDIT = "struct<data:struct<children:array<struct<data:struct<title:string,url:string,selftext:string,score:bigint,num_comments:bigint,author:string,created_utc:double,permalink:string,subreddit:string,stickied:boolean>>>>>"
BLUESKY = "struct<posts:array<struct<uri:string,author:struct<handle:string,displayName:string>,record:struct<text:string,createdAt:string>,likeCount:bigint,replyCount:bigint,repostCount:bigint>>>"
NEWSAPI = "struct<status:string,articles:array<struct<title:string,url:string,description:string,content:string,author:string,publishedAt:string,source:struct<name:string>>>>"
HN = "struct<id:bigint,title:string,url:string,text:string,score:bigint,descendants:bigint,by:string,time:bigint,type:string>"


def parse_date(x: Column | str, as_of: float) -> Column:
    """Epoch seconds of an RFC 822 or ISO 8601 date; the reference time if it is neither."""
    s = F.trim(text_of(x))
    rfc = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    zones = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    for name, offset in zones.items():
        rfc = F.regexp_replace(rfc, f"{name}$", offset)
    parsed = F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(s))
    return F.coalesce(F.unix_micros(parsed) / 1e6, F.lit(float(as_of)))


def _article(title, author, publisher, timestamp, url, text, source_type="rss", coverage=None) -> list[Column]:
    coverage = F.lit(0) if coverage is None else coverage
    values = (F.trim(text_of(title)), F.trim(text_of(author)), F.trim(text_of(publisher)), timestamp, url, text, F.lit(source_type), coverage.cast("long"))
    return [v.alias(n) for v, n in zip(values, ARTICLE, strict=True)]


def rss(raw: DataFrame, as_of: float, xml: str = "xml", source_type: str = "rss", publisher: str | None = None) -> DataFrame:
    """Articles of RSS 2.0 feeds, one feed a row; malformed feeds and items without a title give none."""
    x = raw.select(F.from_xml(xml, RSS, {"mode": "PERMISSIVE"}).alias("f")).select(F.col("f.channel.title").alias("feed"), F.explode("f.channel.item").alias("i"))
    author = F.coalesce(F.nullif(F.col("i.author"), F.lit("")), F.col("i.creator"), F.col("i").getField("dc:creator"))
    name = F.coalesce(F.nullif(F.trim(F.col("feed")), F.lit("")), F.lit(publisher or ""))
    body = strip_boilerplate(clean_html("i.description"))
    return x.select(*_article(F.col("i.title"), author, name, parse_date("i.pubDate", as_of), strip_tracking(F.trim(F.col("i.link"))), body, source_type)).filter("title <> ''")


def atom(raw: DataFrame, as_of: float, xml: str = "xml", source_type: str = "rss") -> DataFrame:
    """Articles of Atom feeds; the content counts before the summary."""
    x = raw.select(F.from_xml(xml, ATOM, {"mode": "PERMISSIVE"}).alias("f")).select(F.col("f.title").alias("feed"), F.explode("f.entry").alias("i"))
    body = strip_boilerplate(clean_html(F.coalesce(F.nullif(F.col("i.content"), F.lit("")), F.col("i.summary"))))
    link = strip_tracking(text_of(F.get("i.link", F.lit(0))["_href"]))
    return x.select(*_article(F.col("i.title"), F.col("i.author.name"), F.col("feed"), parse_date("i.updated", as_of), link, body, source_type)).filter("title <> ''")


def hacker_news(raw: DataFrame, json: str = "json") -> DataFrame:
    i = raw.select(F.from_json(json, HN).alias("i")).filter("i.type = 'story' and trim(coalesce(i.title, '')) <> ''")
    permalink = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("i.id").cast("string"))
    url = F.when(text_of("i.url") != "", strip_tracking("i.url")).otherwise(permalink)
    body = clean_html("i.text")
    body = F.when(body == "", F.concat(F.lit("HN discussion: "), F.trim("i.title"))).otherwise(body)
    coverage = F.coalesce("i.score", F.lit(0)) + F.coalesce("i.descendants", F.lit(0))
    return i.select(*_article(F.col("i.title"), F.col("i.by"), F.lit("Hacker News"), F.col("i.time").cast("double"), url, body, "social", coverage))


def reddit(raw: DataFrame, json: str = "json") -> DataFrame:
    i = raw.select(F.from_json(json, REDDIT).alias("j")).select(F.explode("j.data.children.data").alias("i"))
    i = i.filter("not coalesce(i.stickied, false) and trim(coalesce(i.title, '')) <> ''")
    permalink = F.concat(F.lit("https://www.reddit.com"), text_of("i.permalink"))
    outside = (text_of("i.url") != "") & ~F.col("i.url").rlike(r"^https?://([a-z]+\.)?reddit\.com|^/r/")
    coverage = F.coalesce("i.score", F.lit(0)) + F.coalesce("i.num_comments", F.lit(0))
    body = F.coalesce(F.nullif(F.trim("i.selftext"), F.lit("")), F.trim("i.title"))
    return i.select(*_article(F.col("i.title"), F.concat(F.lit("u/"), text_of("i.author")), F.concat(F.lit("Reddit/r/"), text_of("i.subreddit")), F.col("i.created_utc"), F.when(outside, strip_tracking("i.url")).otherwise(permalink), body, "social", coverage))


def bluesky(raw: DataFrame, as_of: float, json: str = "json") -> DataFrame:
    p = raw.select(F.from_json(json, BLUESKY).alias("j")).select(F.explode("j.posts").alias("p")).withColumn("t", F.trim("p.record.text")).filter(F.length("t") >= 20)
    title = F.substring(F.split_part("t", F.lit("\n"), F.lit(1)), 1, 120)
    url = F.concat(F.lit("https://bsky.app/profile/"), text_of("p.author.handle"), F.lit("/post/"), F.regexp_extract(text_of("p.uri"), r"([^/]*)$", 1))
    coverage = sum((F.coalesce(f"p.{c}", F.lit(0)) for c in ("likeCount", "replyCount", "repostCount")), F.lit(0))
    author = F.coalesce(F.nullif(F.col("p.author.displayName"), F.lit("")), F.col("p.author.handle"))
    return p.select(*_article(title, author, F.lit("Bluesky"), parse_date("p.record.createdAt", as_of), url, F.col("t"), "social", coverage))


def newsapi(raw: DataFrame, as_of: float, json: str = "json") -> DataFrame:
    a = raw.select(F.from_json(json, NEWSAPI).alias("j")).select(F.explode("j.articles").alias("a")).filter("trim(coalesce(a.title, '')) not in ('', '[Removed]')")
    longer = F.when(F.length(text_of("a.content")) > F.length(text_of("a.description")), F.col("a.content")).otherwise(F.col("a.description"))
    body = F.trim(F.regexp_replace(strip_boilerplate(clean_html(longer)), r"\[\+\d+ chars\]$", ""))
    return a.select(*_article(F.col("a.title"), F.col("a.author"), F.col("a.source.name"), parse_date("a.publishedAt", as_of), strip_tracking("a.url"), body, "api"))


def probability(outcomes: Column | str) -> Column:
    """First of a JSON list of prices; 0 for anything else."""
    x = F.col(outcomes) if isinstance(outcomes, str) else outcomes
    return F.coalesce(F.get(F.from_json(x, "array<string>"), F.lit(0)).try_cast("double"), F.lit(0.0))


MARKET = ("question", "probability", "volume", "volume_24h", "resolution_criteria", "slug", "end_date", "source")


def _market(x: DataFrame, *values: Column) -> DataFrame:
    made = x.select(*[v.alias(n) for v, n in zip(values, MARKET, strict=True)])
    return made.filter("question <> '' and probability > 0.05 and probability < 0.95")


def polymarket(raw: DataFrame, json: str = "json") -> DataFrame:
    """Markets of events, one event list a row; the event's slug and description win, the market's own end date."""
    e = raw.select(F.explode(F.from_json(json, EVENTS)).alias("e")).select("e", F.explode("e.markets").alias("m"))
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _market(e, text_of("m.question"), probability("m.outcomePrices"), n("m.volume"), n("m.volume24hr"), first("e.description", "m.description"), text_of("e.slug"), first("m.endDate", "e.endDate"), F.lit("polymarket"))


def kalshi(raw: DataFrame, json: str = "json") -> DataFrame:
    m = raw.select(F.from_json(json, KALSHI).alias("j")).select(F.explode("j.markets").alias("m"))
    price = F.coalesce((F.col("m.yes_bid") + F.col("m.yes_ask")) / 2 / 100.0, F.col("m.last_price") / 100.0, F.lit(0.0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    question = F.coalesce(F.nullif(F.col("m.title"), F.lit("")), F.col("m.subtitle"), F.lit(""))
    return _market(m, question, price, n("m.volume"), n("m.volume_24h"), text_of("m.rules_primary"), text_of("m.ticker"), F.coalesce("m.close_time", "m.expiration_time", F.lit("")), F.lit("kalshi"))


def mirrored_social(raw: DataFrame, as_of: float, instance: str, account: str, xml: str = "xml") -> DataFrame:
    """Posts of an account from a mirror's RSS: links point to the original site, the publisher is the account."""
    x = rss(raw, as_of, xml, "social")
    return x.withColumn("url", F.replace("url", F.lit(instance.rstrip("/")), F.lit("https://x.com"))).withColumn("publisher", F.lit(f"Twitter/X/@{account}"))


def bridged_social(raw: DataFrame, as_of: float, publisher: str, limit: int, xml: str = "xml") -> DataFrame:
    """The first items of a bridge's RSS under one publisher, coverage 0."""
    return rss(raw, as_of, xml, "social").withColumn("publisher", F.lit(publisher)).orderBy(F.col("timestamp").desc(), "url").limit(limit)
