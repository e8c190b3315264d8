"""Relational questions about articles, events and publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scoring import social_score
from ..functions.text import display_headline, text_of

TRADITIONAL = ("rss", "api", "scrape")


def as_of(arts: DataFrame) -> DataFrame:
    """One row: the newest article's time, the reference time of queries over this table."""
    return arts.agg(F.max("ts").alias("as_of"))


def cluster_rollup(arts: DataFrame) -> DataFrame:
    """Per event: article count, confidence, social score and newest article."""
    social = F.col("source_type") == "social"
    agg = arts.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.sum(F.when(social, F.col("social_coverage")).otherwise(0)).alias("__coverage"), F.count_if(social).alias("__social"), F.max("ts").alias("latest_timestamp")
    )
    return agg.select(
        "cluster_id", "source_count", F.least(F.lit(1.0), F.col("source_count") * 0.1 + 0.5).alias("confidence"), social_score("__coverage", "__social").alias("social_score"), "latest_timestamp"
    )


def timeline_entry() -> Column:
    """An article as the text of a timeline's entry."""
    publisher = F.when(text_of("publisher") != "", F.concat(F.lit("["), F.col("publisher"), F.lit("] "))).otherwise("")
    return F.concat(publisher, F.when(text_of("title") == "", "New source added").otherwise(F.substring("title", 1, 120)))


def timeline(arts: DataFrame, most: int = 50) -> DataFrame:
    """(cluster_id, ts, ingest_seq, entry): the newest `most` articles of each event, as text entries.

    A ranked window keeps a bounded number of rows for each event, so no event's articles are collected whole.
    """
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("ts").desc(), F.col("ingest_seq").desc()))
    return arts.withColumn("__r", rank).filter(F.col("__r") <= most).select("cluster_id", "ts", "ingest_seq", timeline_entry().alias("entry"))


def coverage_gaps(arts: DataFrame, events: DataFrame, now: DataFrame, limit: int = 20, look_back: float = 172800.0) -> DataFrame:
    """Events that social media covers and the press does not, in a list of high and one of lower priority.

    Articles are cut to the look-back and aggregated before they meet the events.
    """
    recent = arts.join(F.broadcast(now), F.col("ts") >= F.col("as_of") - look_back)  # one row: as_of() above
    social = (F.col("source_type") == "social") & (F.col("sensationalism_score") < 0.5)
    agg = recent.groupBy("cluster_id").agg(
        F.countDistinct(F.when(social, F.when(F.col("url") != "", F.col("url")).otherwise(F.col("id")))).alias("social_count"),
        F.count_if(social).alias("social_rows"),
        F.count_if(F.col("source_type").isin(*TRADITIONAL)).alias("traditional_count"),
        F.sum(F.when(social, F.col("social_coverage")).otherwise(0)).alias("social_coverage"),
    )
    s, t = F.col("social_count"), F.col("traditional_count")
    ratio = s / F.greatest(t, F.lit(1))
    gap = F.when((s > 1) & (t == 0), 1.0).when((s > 1) & (t > 0) & (s >= 3 * t), F.least(F.lit(1.0), (ratio - 1) / (ratio + 1)))
    signal = F.when((s <= 1) & (F.col("social_rows") > 1), "viral").when(s > 1, "multiple").otherwise("single")
    x = agg.withColumn("gap", gap).filter("gap is not null").withColumn("social_signal_type", signal).join(events.drop("source_count"), "cluster_id")
    importance = F.col("gap") * 0.3 + F.least((s + t) / 5.0, F.lit(1.0)) * 0.4 + F.least(F.log1p(F.col("social_coverage")) / 5.0, F.lit(1.0)) * 0.3
    score, near = F.coalesce("impact_score", F.lit(0.0)), F.coalesce("impact", F.lit("low")).isin("high", "medium")
    traded = (F.coalesce("market_odds", F.lit(0.0)) != 0) & (F.coalesce("market_volume", F.lit(0.0)) > 100000)
    high = (near & (s + t >= 3)) | (score >= 42) | traded | (s + t >= 5) | ((F.col("gap") >= 0.7) & (s + t >= 2))
    medium = near | (score >= 20) | (s + t >= 3) | (F.col("gap") >= 0.4)
    x = x.withColumn("importance", F.when(importance >= 0.5, "high").when(importance >= 0.25, "medium").otherwise("low"))
    x = x.withColumn("gap_impact", F.when(high, "high").when(medium, "medium").otherwise("low")).withColumn("headline", display_headline("neutral_headline", "headline"))
    asks = F.lower("headline").rlike("^(" + "|".join(L.QUESTION_STARTS) + ")") | (F.contains("headline", F.lit("?")) & (s <= 3))
    x = x.filter(~(asks & (t == 0)))
    x = x.withColumn("bucket", F.when((F.col("gap_impact") == "high") & (F.col("importance") == "high"), "high").otherwise("lower"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("gap").desc(), "cluster_id"))
    x = x.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return x.select(
        "bucket", F.col("rank").cast("long").alias("rank"), "cluster_id", "headline", s.cast("long").alias("social_count"), t.cast("long").alias("traditional_count"), F.col("social_coverage").cast("long").alias("social_coverage"),
        "social_signal_type", F.lit("social_leading").alias("gap_type"), F.round("gap", 4).alias("gap_score"), "importance", F.col("gap_impact").alias("impact"), "latest_timestamp",
    )


def platform_stats(arts: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """One row of totals; each table is aggregated in one pass."""
    social = F.col("source_type") == "social"
    a = arts.agg(F.count(F.lit(1)).alias("article_count"), F.count_if(social).alias("social_article_count"), F.count_if(F.col("source_type") == "rss").alias("rss_article_count"), F.countDistinct(F.when(social, F.col("publisher"))).alias("social_publisher_count"))
    e = events.agg(F.count(F.lit(1)).alias("cluster_count"), F.max("latest_timestamp").alias("latest_update"))
    return a.crossJoin(e).crossJoin(claims.agg(F.count(F.lit(1)).alias("claim_count")))  # single rows


def rounded_mean(column: str, digits: int) -> Column:
    """Mean of scores of 0 or more, each taken to 9 digits, rounded half up to `digits`: in whole numbers, so the order of rows does not matter."""
    n, unit = F.nullif(F.count(F.col(column)), F.lit(0)), 10 ** (9 - digits)
    doubled = 2 * F.sum(F.round(F.col(column) * 1e9).cast("long")) + n * unit
    return (doubled - F.pmod(doubled, 2 * n * unit)) / (2 * n * unit) / F.lit(10.0**digits)


def publisher_stats(arts: DataFrame) -> DataFrame:
    """Per publisher: articles, newest, oldest, mean scores and the newest article's kind."""
    agg = arts.filter("publisher <> ''").groupBy("publisher").agg(
        F.count(F.lit(1)).alias("article_count"), F.max("ts").alias("latest_article"), F.min("ts").alias("earliest_article"),
        rounded_mean("sensationalism_score", 3).alias("s"), rounded_mean("fact_density", 4).alias("f"), F.max_by("source_type", F.struct("ts", "ingest_seq")).alias("source_type"),
    )
    return agg.select("publisher", "article_count", "latest_article", "earliest_article", F.coalesce("s", F.lit(0.0)).alias("avg_sensationalism"), F.coalesce("f", F.lit(0.0)).alias("avg_fact_density"), F.coalesce("source_type", F.lit("rss")).alias("source_type"))


def social_publisher_stats(arts: DataFrame) -> DataFrame:
    social = arts.filter("source_type = 'social'").groupBy("publisher")
    return social.agg(F.count(F.lit(1)).alias("article_count"), F.coalesce(F.sum("social_coverage"), F.lit(0)).cast("long").alias("total_coverage"), F.max("ts").alias("latest_article"))


def publisher_bias(arts: DataFrame, window_s: float = 3600.0) -> DataFrame:
    """Per event and publisher: mean sensationalism, articles, kinds, and whether it was among the first."""
    first = F.min("ts").over(Window.partitionBy("cluster_id"))
    agg = arts.withColumn("__first", first).groupBy("cluster_id", "publisher").agg(
        rounded_mean("sensationalism_score", 3).alias("avg_sensationalism"), F.count(F.lit(1)).alias("article_count"), (F.min("ts") <= F.min("__first") + window_s).alias("is_primary"), F.countDistinct("source_type").alias("source_types")
    )
    return agg.select("cluster_id", "publisher", "avg_sensationalism", "article_count", "is_primary", "source_types")


def narrative_evolution(arts: DataFrame) -> DataFrame:
    """Articles of an event in time with the change of tone against the one before."""
    w = Window.partitionBy("cluster_id").orderBy("ts", "ingest_seq")
    before = F.lag("sensationalism_score").over(w)
    change = F.round(F.col("sensationalism_score") - before, 3)
    label = F.when(change > 0.1, "more sensational").when(change < -0.1, "more neutral").otherwise("")
    return arts.select("cluster_id", "id", F.row_number().over(w).cast("long").alias("step"), "sensationalism_score", label.alias("shift"))


def primary_source(arts: DataFrame) -> DataFrame:
    """Every article with whether it is its event's first."""
    w = Window.partitionBy("cluster_id").orderBy("ts", "ingest_seq")
    return arts.select("cluster_id", "id", "publisher", (F.row_number().over(w) == 1).alias("is_primary"))


def earliest_url(arts: DataFrame) -> DataFrame:
    return arts.filter("url <> ''").groupBy("cluster_id").agg(F.min_by("url", F.struct("ts", "ingest_seq")).alias("source_url"))


def dedup_by_url(arts: DataFrame) -> DataFrame:
    """Articles that stay if of each link the earliest stays; those without a link all stay."""
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("#"), F.col("id")))
    return arts.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy("ingest_seq"))).filter("__r = 1").drop("__k", "__r")


def orphan_clusters(events: DataFrame, arts: DataFrame, markets: DataFrame) -> DataFrame:
    """Events that neither an article nor a market refers to."""
    return events.join(arts.select("cluster_id"), "cluster_id", "left_anti").join(markets.select(F.col("linked_cluster_id").alias("cluster_id")), "cluster_id", "left_anti")


def claim_counts(arts: DataFrame, claims: DataFrame) -> DataFrame:
    n = claims.groupBy(F.col("source_article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return arts.select("id", "cluster_id").join(n, "id", "left").select("id", "cluster_id", F.coalesce("n", F.lit(0)).alias("claim_count"))


def newest_per_platform(arts: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("publisher").orderBy(F.col("ts").desc(), F.col("ingest_seq").desc())
    return arts.filter("source_type = 'social'").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(F.col("publisher").alias("platform"), "rank", "id", "title")


def recent_social(arts: DataFrame, limit: int = 50) -> DataFrame:
    return arts.filter("source_type = 'social'").orderBy(F.col("ts").desc(), F.col("ingest_seq").desc()).limit(limit).select("id", "publisher", "title", "ts", "social_coverage")


def platform_counts(page: DataFrame) -> DataFrame:
    """Articles of a page by platform, the publisher's part before a slash."""
    return page.groupBy(F.split_part("publisher", F.lit("/"), F.lit(1)).alias("platform")).agg(F.count(F.lit(1)).alias("articles"))


def publisher_by_host(arts: DataFrame) -> DataFrame:
    """Commonest publisher of each host over distinct (publisher, link) pairs; ties go to the name."""
    from ..functions.text import url_host

    pairs = arts.filter("url <> '' and publisher <> ''").select("publisher", "url").distinct().withColumn("host", url_host("url")).filter("host <> ''")
    n = pairs.groupBy("host", "publisher").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("host").agg(F.min_by("publisher", F.struct((-F.col("n")).alias("a"), "publisher")).alias("publisher"))


def in_time_range(ts: Column | str, now: Column, name: str = "24h") -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return t >= now - float(L.TIME_RANGES.get(name, 86400))


def feed_filter(events: DataFrame, now: DataFrame, time_range="24h", impact=None, min_sources=1, keyword=None, market_moving=False, topic=None, start=None, end=None, geography=None) -> DataFrame:
    """Events of a time range with the feed's filters; a custom range needs a start."""
    x = events
    if time_range == "custom" and start is not None:
        x = x.filter(F.col("latest_timestamp") >= start)
        x = x if end is None else x.filter(F.col("latest_timestamp") <= end)
    else:
        x = x.join(F.broadcast(now), in_time_range("latest_timestamp", F.col("as_of"), time_range)).drop("as_of")
    if impact:
        x = x.filter(F.col("impact") == impact)
    if min_sources > 1:
        x = x.filter(F.col("source_count") >= min_sources)
    if keyword:
        fields = [c for c in ("headline", "summary") if c in x.columns] + (["entities"] if "entities" in x.columns else [])
        has = [F.contains(F.lower(F.to_json(c) if c == "entities" else text_of(c)), F.lit(keyword.lower())) for c in fields]
        cond = has[0]
        for more in has[1:]:
            cond = cond | more
        x = x.filter(cond)
    if market_moving:
        x = x.filter("market_odds is not null")
    if geography:
        x = x.filter(F.col("geography") == geography)
    if topic == "Market & Economy":
        x = x.filter("topic = 'Economy' or market_odds is not null")
    elif topic:
        x = x.filter(F.col("topic") == topic)
    return x


def feed_tiered(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of events, high before medium before low, with a reserve for low ones.

    Ranks within the tiers are cut to what a page can need before tiers are counted, so only limit + offset rows of each
    tier meet in one place.
    """
    total = limit + offset
    reserve = min(max(2, total // 10), total // 3)
    rank = F.row_number().over(Window.partitionBy("impact").orderBy(F.col("latest_timestamp").desc(), F.coalesce("impact_score", F.lit(0.0)).desc(), "cluster_id"))
    x = events.filter(F.col("impact").isin("high", "medium", "low")).withColumn("tier_rank", rank).filter(F.col("tier_rank") <= total)
    n = x.agg(*[F.count_if(F.col("impact") == t).alias(t) for t in ("high", "medium", "low")])
    n = n.withColumn("l0", F.least("low", F.lit(reserve))).withColumn("m", F.least(F.col("medium"), F.lit(total) - F.col("high") - F.col("l0")))
    left = F.lit(total) - F.col("high") - F.col("m") - F.col("l0")
    n = n.withColumn("l1", F.when((left > 0) & (F.col("low") > F.col("l0")), F.least(F.col("low"), F.col("l0") + left)).otherwise(F.col("l0")))
    # a negative share of the medium tier counts from its end
    n = n.withColumn("m", F.when(F.col("m") < 0, F.greatest(F.lit(0), F.col("medium") + F.col("m"))).otherwise(F.col("m"))).select(F.col("high").alias("nh"), F.col("m").alias("nm"), F.col("l1").alias("nl"))
    x = x.crossJoin(n)  # n has one row
    tier = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    allowed = F.when(tier == 0, F.col("nh")).when(tier == 1, F.col("nm")).otherwise(F.col("nl"))
    place = F.col("tier_rank") + F.when(tier == 0, 0).when(tier == 1, F.col("nh")).otherwise(F.col("nh") + F.col("nm"))
    x = x.filter(F.col("tier_rank") <= allowed).withColumn("place", place.cast("long")).filter((F.col("place") > offset) & (F.col("place") <= total))
    return x.drop("nh", "nm", "nl", "tier_rank")


def feed_impact_order(events: DataFrame, now: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in the order of impact, recency and score."""
    recent = F.col("latest_timestamp") >= F.col("as_of") - 21600.0
    is_ = lambda t: F.col("impact") == t
    tier = F.when(is_("high") & recent, 0).when(is_("high") & (F.col("market_odds").isNotNull() | (F.col("topic") == "Economy")), 1).when(is_("high"), 2).when(is_("medium") & recent, 3).when(is_("medium"), 4).when(is_("low") & recent, 5).otherwise(6)
    x = events.crossJoin(F.broadcast(now)).withColumn("tier", tier).drop("as_of")
    return x.orderBy("tier", F.col("latest_timestamp").desc(), F.coalesce("impact_score", F.lit(0.0)).desc(), "cluster_id").offset(offset).limit(limit)


def exact_headline_groups(events: DataFrame) -> DataFrame:
    """Events whose headlines are equal but for case and outer blanks; the earliest is primary."""
    key = F.lower(F.trim("headline"))
    g = events.groupBy(key.alias("headline_key")).agg(F.count(F.lit(1)).alias("clusters"), F.min_by("cluster_id", F.struct("earliest_timestamp", "cluster_id")).alias("primary_id"), F.sum("source_count").alias("source_count"))
    return g.filter("clusters > 1")


def ai_feed(events: DataFrame, now: DataFrame, limit: int = 100, offset: int = 0, time_range: str = "24h") -> DataFrame:
    """Events about AI: keyword matches, stored verdicts first, hype dropped, and a rule where no verdict is stored.

    Five times the limit (500 at least) is taken in the feed's order before hype and other subjects are dropped.
    """
    from ..functions.scoring import ai_keyword, ai_relevant, hype

    x = feed_filter(events, now, time_range).filter(ai_keyword("headline", "summary", F.to_json("entities"))).crossJoin(F.broadcast(now))
    recent = F.col("latest_timestamp") >= F.col("as_of") - 21600.0
    tier = F.lit(None).cast("int")
    for i, name in enumerate(("low", "medium", "high")):
        tier = F.when((F.col("impact") == name), F.when(recent, 4 - 2 * i).otherwise(5 - 2 * i)).otherwise(tier)
    x = x.withColumn("verdict_rank", F.when(F.col("ai_relevant"), 0).otherwise(1)).withColumn("tier", F.coalesce(tier, F.lit(5)))
    order = ["verdict_rank", "tier", F.col("latest_timestamp").desc(), F.coalesce("impact_score", F.lit(0.0)).desc(), "cluster_id"]
    page = x.orderBy(*order).offset(offset).limit(max(5 * limit, 500))
    headline = F.coalesce(F.nullif("neutral_headline", F.lit("")), F.col("headline"))
    kept = page.filter(~hype(headline) & F.coalesce("ai_relevant", ai_relevant(headline, "summary")))
    return kept.orderBy(*order).limit(limit)


def related_sources(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of sources of each group of events; `groups` has cluster_id and primary_id."""
    return groups.join(events.select("cluster_id", "source_count"), "cluster_id").groupBy("primary_id").agg(F.sum("source_count").alias("source_count"), F.count(F.lit(1)).alias("members"))


def social_detail(arts: DataFrame) -> DataFrame:
    """Per event: coverage and number of platforms of its social articles."""
    social = arts.filter("source_type = 'social'")
    return social.groupBy("cluster_id").agg(F.sum("social_coverage").alias("coverage"), F.countDistinct(F.split_part("publisher", F.lit("/"), F.lit(1))).alias("platforms"))


def platform_prefix_counts(arts: DataFrame, platforms: list[str]) -> DataFrame:
    """Articles whose publisher begins with each platform's name, in one pass."""
    one = arts.agg(*[F.count_if(F.col("publisher").startswith(p)).alias(p) for p in platforms])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).alias("articles")) for p in platforms])).alias("x")).select("x.*")


def cluster_span(arts: DataFrame) -> DataFrame:
    """First and last article and number of articles of each event."""
    return arts.groupBy("cluster_id").agg(F.min("ts").alias("earliest_timestamp"), F.max("ts").alias("latest_timestamp"), F.count(F.lit(1)).alias("source_count"))
