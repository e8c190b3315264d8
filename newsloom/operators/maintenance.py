"""Batch forms of the tables' writes: each takes the table and returns what it should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import expired, geography, impact_label, impact_score, probability_shift, topic
from ..functions.text import clean_entities, neutral_headline, strip_urls
from .coverage import dedup_by_url


def insert_articles(table: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` to append: links unknown so far, once each; rows without a link always."""
    fresh = dedup_by_url(new)
    linked = fresh.filter("url <> ''").join(table.select("url").distinct(), "url", "left_anti")
    return linked.select(*new.columns).unionByName(fresh.filter("coalesce(url, '') = ''").select(*new.columns))


#: Columns of an event that a score needs, with what stands for a missing one.
EVENT_DEFAULTS = {
    "headline": "string", "summary": "string", "source_count": "long", "confidence": "double", "social_score": "double", "market_odds": "double", "market_volume": "double",
    "novel_facts": "array<string>", "disputed_claims": "array<string>", "timeline": "array<string>", "entities": "array<string>", "price_history": "array<struct<timestamp:double,probability:double>>",
}


def add_columns(table: DataFrame, columns: dict[str, str], allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The table with the columns it lacks, as nulls of the given types; a name that is not allowed is refused."""
    if allowed is not None and (unknown := set(columns) - set(allowed)):
        raise ValueError(f"columns that may not be added: {sorted(unknown)}")
    return table.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in table.columns))


def rescored(events: DataFrame, now: DataFrame) -> DataFrame:
    """All events with impact_score and impact by today's rules; no sources count as one, no confidence as 0.5."""
    x = add_columns(events.drop("impact_score", "impact"), EVENT_DEFAULTS).crossJoin(F.broadcast(now.select("as_of")))
    for name, value in (("source_count", 1), ("confidence", 0.5)):
        x = x.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(value)))
    shift = F.coalesce(probability_shift("price_history", F.col("as_of")), F.lit(0.0))
    x = x.withColumn("latest_timestamp", F.coalesce("latest_timestamp", "as_of")).withColumn("__shift", shift)
    x = x.withColumn("impact_score", impact_score(F.col("as_of"), F.col("__shift")))
    x = x.withColumn("impact", impact_label("impact_score", F.col("__shift"), "source_count"))
    return x.select(*[c for c in events.columns if c not in ("impact_score", "impact")], "impact_score", "impact")


def insert_events(table: DataFrame, new: DataFrame, now: DataFrame) -> DataFrame:
    """Rows to append for new events: scored, labelled, with a neutral headline without links; known ids are left out."""
    fresh = new.dropDuplicates(["cluster_id"]).join(table.select("cluster_id"), "cluster_id", "left_anti")
    given = strip_urls(F.col("neutral_headline")) if "neutral_headline" in new.columns else F.lit("")
    neutral = F.coalesce(F.nullif(given, F.lit("")), neutral_headline(strip_urls("headline")))
    return rescored(fresh, now).withColumn("neutral_headline", neutral)


def insert_claims(table: DataFrame, new: DataFrame) -> DataFrame:
    """The claims table with new claims appended in their order; columns that one side lacks are null."""
    return table.unionByName(new, allowMissingColumns=True)


def upsert_markets(table: DataFrame, new: DataFrame) -> DataFrame:
    """`table` after `new`: matched by slug, else by question; unmatched rows are added."""
    last = lambda df, key: df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), "id"))).filter("__r = 1").drop("__r")
    new = last(new, "slug")
    by_slug = new.join(table.select("slug", F.col("id").alias("known")), "slug", "left")
    by_question = table.groupBy("question").agg(F.min("id").alias("same"))
    keyed = by_slug.join(by_question, "question", "left").withColumn("id", F.coalesce("known", F.when(F.col("question") != "", F.col("same")), "id"))
    keyed = last(keyed.select(*table.columns), "id")
    return table.join(keyed.select("id"), "id", "left_anti").unionByName(keyed)


def purge_expired(markets: DataFrame, as_of: float) -> DataFrame:
    """Markets whose end has not passed; dates that cannot be read stay."""
    return markets.filter(~expired("end_date", as_of))


def refresh_events(events: DataFrame) -> DataFrame:
    """Headlines without links, neutral forms, names without fragments, and topic and geography where they are empty."""
    x = events.withColumn("headline", strip_urls("headline")).withColumn("entities", clean_entities("entities")).withColumn("neutral_headline", neutral_headline("headline"))
    words = F.concat_ws(" ", "headline", "summary")
    for name, infer in (("topic", topic), ("geography", geography)):
        x = x.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), infer("entities", words)))
    return x


def cascade_claims(claims: DataFrame, kept_articles: DataFrame) -> DataFrame:
    """Claims whose article is still there."""
    return claims.join(kept_articles.select(F.col("id").alias("source_article_id")), "source_article_id", "left_semi")
