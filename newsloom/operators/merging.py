"""Merging duplicate events in published tables: references moved, metadata made anew, orphans removed, touched keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.published import PublishedTable
from .coverage import cluster_span
from .dedup import apply_merges, merge_map

REFRESHED = ("source_count", "earliest_timestamp", "latest_timestamp")


def article_places(arts: DataFrame) -> DataFrame:
    """(cluster_id, position, id): each event's articles in the order of their time, as rows; no event's list is held at once."""
    order = Window.partitionBy("cluster_id").orderBy("ts", "id")
    return arts.select("cluster_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "id")


def refreshed_events(events: DataFrame, arts: DataFrame) -> DataFrame:
    """Events with count and times from their articles; times stay where there are none."""
    span = cluster_span(arts).select("cluster_id", *[F.col(c).alias(f"__{c}") for c in REFRESHED])
    x = events.join(span, "cluster_id", "left")
    x = x.withColumn("source_count", F.coalesce("__source_count", F.lit(0)).cast(events.schema["source_count"].dataType))
    for c in REFRESHED[1:]:
        x = x.withColumn(c, F.coalesce(f"__{c}", c))
    return x.select(*events.columns)


def without_orphans(events: DataFrame, arts: DataFrame, markets: DataFrame) -> DataFrame:
    """Events that count an article, or that an article or a market names."""
    named = arts.select("cluster_id").unionByName(markets.select(F.col("linked_cluster_id").alias("cluster_id"))).filter("cluster_id is not null").distinct()
    return events.filter("source_count > 0").unionByName(events.filter("coalesce(source_count, 0) <= 0").join(named, "cluster_id", "left_semi"))


def merged(events: DataFrame, tables: dict[str, DataFrame], merges: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(events, tables) after the merges over whole tables: `tables` has articles and markets, and others with a cluster_id."""
    moved = {name: apply_merges(t, merges, "linked_cluster_id" if name == "markets" else "cluster_id") for name, t in tables.items()}
    left = refreshed_events(events.join(merges.select("cluster_id"), "cluster_id", "left_anti"), moved["articles"])
    return without_orphans(left, moved["articles"], moved["markets"]), moved


def merge_published(events: PublishedTable, tables: dict[str, PublishedTable], now: DataFrame) -> int:
    """Merge the duplicates of published tables; the number of events that went into others.

    events is keyed by cluster_id, markets by linked_cluster_id, articles and others by cluster_id.  The merge map drives everything: the ids that
    it names are the touched keys of every table, with events that have no article, which may be orphans.  Tables that refer to events are
    published first, so a job that dies between leaves no reference to an event that is gone, and running it again ends the work.
    """
    all_events = events.read()
    merges = merge_map(all_events, now).checkpoint()
    ids = merges.select("cluster_id").unionByName(merges.select(F.col("primary_id").alias("cluster_id"))).distinct()
    for name, table in tables.items():
        column = "linked_cluster_id" if name == "markets" else "cluster_id"
        table.update(ids.withColumnRenamed("cluster_id", column), lambda rows, column=column: apply_merges(rows, merges, column))
    keys = ids.unionByName(all_events.filter("coalesce(source_count, 0) <= 0").select("cluster_id")).distinct().checkpoint()

    def change(rows: DataFrame) -> DataFrame:
        arts = tables["articles"].read(keys).join(keys, "cluster_id", "left_semi")
        markets = tables["markets"].read(keys.withColumnRenamed("cluster_id", "linked_cluster_id"))
        own = rows.join(keys, "cluster_id", "left_semi").join(merges.select("cluster_id"), "cluster_id", "left_anti")
        return rows.join(keys, "cluster_id", "left_anti").unionByName(without_orphans(refreshed_events(own, arts), arts, markets))

    events.update(keys, change)
    return merges.count()
