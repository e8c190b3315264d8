"""Logical news tables over the driver's Parquet tables; each rule has the same form in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import simhash_text
from ..functions.text import text_of
from ..operators.coverage import cluster_rollup
from ..operators.leaders import SUMMARY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without or with a zone, whatever the session's zone for the former."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) / 1000000.0D")


def articles(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, prints: bool = False) -> DataFrame:
    """documents joined with events: one article for each document that has an event; `events` may be a stream.

    Titles are cut before the join, so where they are all that is asked for, no text is shuffled.  The same holds for the fingerprints that
    `prints` adds: `content` of title and text, `summary` of title and the text's first SUMMARY characters.
    """
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title")
    d, e = read(spark, sf_dir, "documents").select("doc_id", title, "text", "source", "n_chars"), read(spark, sf_dir, "events") if events is None else events
    made = {"content": text_of("text"), "summary": F.substring(text_of("text"), 1, SUMMARY)} if prints else {}
    d = d.select("*", *[simhash_text(F.concat_ws(" ", text_of("title"), x)).alias(c) for c, x in made.items()])
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "social").when(F.col("event_type") == "signup", "rss").otherwise("api")
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    joined = d.join(e.select("event_id", "ts", "user_id", "event_type", "value"), F.col("event_id") == F.col("doc_id")).join(p, F.col("page_id") == F.col("doc_id"), "left")
    return joined.select(
        F.col("doc_id").cast("string").alias("id"), "title", F.col("source").alias("publisher"), epoch("ts").alias("ts"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "").alias("url"), F.col("user_id").cast("string").alias("cluster_id"), kind.alias("source_type"),
        F.floor("value").cast("long").alias("social_coverage"), ((F.col("n_chars") % 100) / 100.0).alias("sensationalism_score"), ((F.col("n_chars") % 7) / 1000.0).alias("fact_density"),
        F.col("doc_id").alias("ingest_seq"), F.col("text"), *made,
    )


ARTICLES = """articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, substr(split_part(text, chr(10), 1), 1, 120) AS title, source AS publisher, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
    regexp_replace(coalesce(url, ''), '[?#].*$', '') AS url, CAST(user_id AS VARCHAR) AS cluster_id,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'social' WHEN event_type = 'signup' THEN 'rss' ELSE 'api' END AS source_type,
    CAST(floor(value) AS BIGINT) AS social_coverage, (n_chars % 100) / 100.0::DOUBLE AS sensationalism_score, (n_chars % 7) / 1000.0::DOUBLE AS fact_density,
    doc_id AS ingest_seq, text
  FROM documents JOIN events ON event_id = doc_id LEFT JOIN pages ON page_id = doc_id)"""


def clusters(arts: DataFrame) -> DataFrame:
    """One event for each cluster of articles, with what its rollup gives and labels from its size."""
    rolled = cluster_rollup(arts)
    head = arts.groupBy("cluster_id").agg(F.min_by("title", F.struct("ts", "ingest_seq")).alias("headline"), F.min("ts").alias("earliest_timestamp"))
    score = (F.col("source_count") * 7 + F.col("social_score")) % 100
    impact = F.when((score >= 60) & (F.col("source_count") >= 3), "high").when(score >= 32, "medium").otherwise("low")
    c = rolled.join(head, "cluster_id").withColumn("impact_score", F.round(score, 1)).withColumn("impact", impact)
    topic = F.element_at(F.array(*[F.lit(x) for x in ("Economy", "Technology", "Politics", "")]), (F.col("source_count") % 4 + 1).cast("int"))
    odds = F.when(F.col("source_count") % 3 == 0, (F.col("source_count") % 10) / 10.0)
    return c.withColumn("topic", topic).withColumn("market_odds", odds)


CLUSTERS = """rolled AS (
  SELECT cluster_id, count(*) AS source_count, sum(CASE WHEN source_type = 'social' THEN social_coverage ELSE 0 END) AS social_total,
    count(*) FILTER (source_type = 'social') AS social_articles, max(ts) AS latest_timestamp, min(ts) AS earliest_timestamp, arg_min(title, (ts, ingest_seq)) AS headline
  FROM articles GROUP BY cluster_id),
rolled2 AS (
  SELECT cluster_id, CAST(source_count AS BIGINT) AS source_count, latest_timestamp, earliest_timestamp, headline, least(1.0::DOUBLE, source_count * 0.1::DOUBLE + 0.5::DOUBLE) AS confidence,
    CASE WHEN social_total > 0 THEN round(least(least(log10(social_total + 1.0::DOUBLE) * 20, 100.0::DOUBLE) + social_articles * 5, 100.0::DOUBLE), 1) ELSE 0.0::DOUBLE END AS social_score
  FROM rolled),
clusters AS (
  SELECT *, round(s, 1) AS impact_score, CASE WHEN s >= 60 AND source_count >= 3 THEN 'high' WHEN s >= 32 THEN 'medium' ELSE 'low' END AS impact,
    ['Economy', 'Technology', 'Politics', ''][source_count % 4 + 1] AS topic, CASE WHEN source_count % 3 = 0 THEN (source_count % 10) / 10.0::DOUBLE END AS market_odds
  FROM (SELECT *, (source_count * 7 + social_score) % 100 AS s FROM rolled2))"""


def claims(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One claim a line of text, with its article's cluster; `events` may be a stream."""
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "events") if events is None else events
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "what")).join(e.select("event_id", "user_id"), F.col("event_id") == F.col("doc_id"))
    return lines.select(F.col("user_id").cast("string").alias("cluster_id"), F.col("doc_id").cast("string").alias("source_article_id"), F.col("doc_id"), F.col("seq").cast("long").alias("seq"), "what")


CLAIMS = """claims AS (
  SELECT CAST(user_id AS VARCHAR) AS cluster_id, CAST(doc_id AS VARCHAR) AS source_article_id, doc_id, CAST(i - 1 AS BIGINT) AS seq, ws[i] AS what
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ws FROM documents) d, unnest(range(1, len(ws) + 1)) t(i) JOIN events ON event_id = doc_id)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market for each part that was sold."""
    p, li = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_extendedprice", "l_shipdate")
    # money in whole cents and discounts in whole percent: sums are exact in any order
    cents, points = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    late = F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    agg = li.groupBy("l_partkey").agg(F.sum(cents).alias("c"), F.sum(points).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.when(late, cents).otherwise(0)).alias("c24"))
    slug = F.concat_ws("-", F.lower(F.regexp_replace("p_brand", "#", "-")), F.lower(F.regexp_replace("p_type", " ", "-")), F.col("p_partkey").cast("string"))
    end = F.when(F.col("p_partkey") % 3 == 0, "1995-06-01T00:00:00Z").when(F.col("p_partkey") % 3 == 1, "2099-06-01T00:00:00Z").otherwise("junk")
    source = F.when(F.col("p_partkey") % 5 == 0, "kalshi").otherwise("polymarket")
    return p.join(agg, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), (F.col("d") / F.col("n") / 10.0).alias("probability"), (F.col("c") / 100.0 * 20).alias("volume"), (F.col("c24") / 100.0).alias("volume_24h"),
        slug.alias("slug"), end.alias("end_date"), source.alias("source"),
    )


MARKETS = """sold AS (
  SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, count(*) AS n,
    CAST(sum(CASE WHEN l_shipdate >= TIMESTAMP '1997-01-01' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS c24
  FROM lineitem GROUP BY l_partkey),
markets AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS question, d / n::DOUBLE / 10.0::DOUBLE AS probability, c / 100.0::DOUBLE * 20 AS volume, c24 / 100.0::DOUBLE AS volume_24h,
    lower(replace(p_brand, '#', '-')) || '-' || lower(replace(p_type, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR) AS slug,
    CASE p_partkey % 3 WHEN 0 THEN '1995-06-01T00:00:00Z' WHEN 1 THEN '2099-06-01T00:00:00Z' ELSE 'junk' END AS end_date,
    CASE WHEN p_partkey % 5 = 0 THEN 'kalshi' ELSE 'polymarket' END AS source
  FROM part JOIN sold ON l_partkey = p_partkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points by cluster: the value of each event over 500."""
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cluster_id"), F.col("event_id").alias("seq"), epoch("ts").alias("ts"), (F.col("value") / 500.0).alias("probability"))


HISTORY = "history AS (SELECT CAST(user_id AS VARCHAR) AS cluster_id, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts, value / 500.0::DOUBLE AS probability FROM events)"
