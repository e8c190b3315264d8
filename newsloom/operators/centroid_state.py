"""Centroids as sums that changes are added to and taken from, so that a run reads what changed and no vector twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"  # sums of these are the same in any order, and taking away leaves nothing behind


def summed(vectors: DataFrame) -> DataFrame:
    """State (cluster_id, pos, total, n) of vectors (cluster_id, embedding); rows without either take no part."""
    x = vectors.filter("cluster_id is not null").select("cluster_id", F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("cluster_id", "pos").agg(F.sum(F.col("x").cast("double").cast(EXACT)).cast(EXACT).alias("total"), F.count(F.lit(1)).alias("n"))


def changed(state: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The state after vectors came and went; one that moved, or changed, is among both with its old and new cluster and vector.  Clusters without any leave."""
    less = summed(removed).select("cluster_id", "pos", (-F.col("total")).cast(EXACT).alias("total"), (-F.col("n")).alias("n"))
    both = state.unionByName(summed(added)).unionByName(less)
    return both.groupBy("cluster_id", "pos").agg(F.sum("total").cast(EXACT).alias("total"), F.sum("n").alias("n")).filter("n > 0")


def changes_of(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) between two versions of changed rows (id, cluster_id, embedding): what is the same on both sides falls out."""
    row = F.struct("cluster_id", "embedding")
    a, b = before.select("id", row.alias("old")), after.select("id", row.alias("new"))
    x = a.join(b, "id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return x.filter("new is not null").select("new.*"), x.filter("old is not null").select("old.*")


def means(state: DataFrame) -> DataFrame:
    """(cluster_id, centroid, members) of a state."""
    parts = state.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("total").cast("double") / F.col("n")).alias("m")))).alias("p"), F.max("n").alias("members"))  # one entry a dimension
    return parts.select("cluster_id", F.transform("p", lambda e: e["m"]).alias("centroid"), "members")
