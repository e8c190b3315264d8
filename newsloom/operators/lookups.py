"""Look-ups by key and the details of one event: filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import DUPLICATE, cosine, dedup_score, entity_jaccard, simhash_column, simhash_similarity
from ..functions.text import text_of


def event(events: DataFrame, cluster_id: str) -> DataFrame:
    """The event of an id; no row if there is none."""
    return events.filter(F.col("cluster_id") == cluster_id)


def claims_of(claims: DataFrame, cluster_id: str) -> DataFrame:
    """An event's claims in the order of their insertion."""
    return claims.filter(F.col("cluster_id") == cluster_id).orderBy("doc_id", "seq")


def articles_of(articles: DataFrame, cluster_id: str) -> DataFrame:
    """An event's articles, the newest first."""
    return articles.filter(F.col("cluster_id") == cluster_id).orderBy(F.col("ts").desc(), F.col("ingest_seq").desc())


def event_details(events: DataFrame, articles: DataFrame, claims: DataFrame) -> DataFrame:
    """Every event with its number of articles, publishers and claims and its earliest link; counts are made before they meet."""
    by_article = articles.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("publisher").alias("publishers"), F.min(F.when(F.col("url") != "", F.struct("ts", "ingest_seq", "url"))).alias("first"))
    by_claim = claims.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("claims"))
    x = events.join(by_article, "cluster_id", "left").join(by_claim, "cluster_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select(*events.columns, none("articles"), none("publishers"), none("claims"), F.coalesce("first.url", F.lit("")).alias("source_url"))


def centroid_of(centres: DataFrame, cluster_id: str) -> DataFrame:
    return centres.filter(F.col("cluster_id") == cluster_id).select("centroid")


def known_clusters(vectors: DataFrame) -> DataFrame:
    """Ids of the clusters that have a vector, and how many."""
    return vectors.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("vectors"))


def duplicate_scores(pairs: DataFrame) -> DataFrame:
    """Similarity of the articles in each row: title1, text1, entities1 and title2, text2, entities2, and perhaps embedding1 and embedding2.

    Adds title_similarity, content_similarity, entity_similarity, overall and is_duplicate.  Vectors count where both are there.
    """
    title = simhash_similarity(simhash_column("title1"), simhash_column("title2"))
    both = lambda i: simhash_column(F.concat_ws(" ", text_of(f"title{i}"), text_of(f"text{i}")))
    x = pairs.withColumn("title_similarity", title).withColumn("content_similarity", simhash_similarity(both(1), both(2)))
    x = x.withColumn("entity_similarity", entity_jaccard(_list("entities1"), _list("entities2")))
    vectors = None
    if {"embedding1", "embedding2"} <= set(pairs.columns):
        vectors = F.when(F.col("embedding1").isNotNull() & F.col("embedding2").isNotNull(), cosine("embedding1", "embedding2"))
    overall = dedup_score(F.col("title_similarity"), F.col("content_similarity"), F.col("entity_similarity"), vectors)
    return x.withColumn("overall", overall).withColumn("is_duplicate", F.col("overall") > DUPLICATE)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))
