"""Claims within events: duplicates, novelty, contradictions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import claim_key


def claim_dedup(claims: DataFrame) -> DataFrame:
    """The first of equal claims of an event; blank ones are not touched."""
    keyed = claims.filter("what <> ''").withColumn("key", claim_key("what"))
    first = F.row_number().over(Window.partitionBy("cluster_id", "key").orderBy("doc_id", "seq"))
    return keyed.withColumn("__r", first).filter("__r = 1").drop("__r")


def novel_claims(claims: DataFrame, most: int | None = None) -> DataFrame:
    """Claims that one source of their event alone makes; `most` keeps the first of each event."""
    source = F.coalesce(F.nullif("source_article_id", F.lit("")), F.lit("unknown"))
    g = claims.filter("what <> ''").groupBy("cluster_id", claim_key("what").alias("key")).agg(
        F.min(source).alias("lo"), F.max(source).alias("hi"), F.min_by(F.trim("what"), F.struct("doc_id", "seq")).alias("what"), F.min(F.struct("doc_id", "seq")).alias("at")
    )
    g = g.filter("lo = hi")
    if most is not None:
        g = g.withColumn("__r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("at"))).filter(F.col("__r") <= most)
    return g.select("cluster_id", "what")


def disputed_claims(claims: DataFrame) -> DataFrame:
    """(cluster_id, seq, earlier_seq, claim, contradiction): claims that an earlier one of the event contradicts.

    Each claim is one row for each side of an antonym pair that it contains, and opposite sides meet by an equi-join;
    claims without such words meet nothing.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side"), F.lit(w).alias("word")) for i, p in enumerate(L.ANTONYMS) for s, w in enumerate(p)])
    text = F.lower(F.trim("what"))
    x = claims.filter(F.trim("what") != "").select("cluster_id", "seq", "what", F.explode(F.filter(sides, lambda s: F.contains(text, s["word"]))).alias("s"))
    x = x.select("cluster_id", "seq", "what", F.col("s.pair").alias("pair"), F.col("s.side").alias("side"))
    a, b = x.alias("a"), x.select("cluster_id", "pair", (1 - F.col("side")).alias("side"), F.col("seq").alias("earlier_seq"), F.col("what").alias("earlier")).alias("b")
    met = a.join(b, ["cluster_id", "pair", "side"]).filter("earlier_seq < seq")
    return met.select("cluster_id", "seq", "earlier_seq", F.col("what").alias("claim"), F.concat(F.lit("Contradicted by: "), F.col("earlier")).alias("contradiction")).distinct()


def first_disputes(claims: DataFrame) -> DataFrame:
    """(cluster_id, doc_id, seq, claim, contradiction): each claim that an earlier one of its event contradicts, with the first that does.

    For tables whose events hold many claims: an event's first claim with each side of an antonym pair is all that is kept, so one
    row an event meets its claims and no pairs of claims arise.  Order is by doc_id and seq; blank and null claims take no part.
    """
    text = F.lower(F.trim("what"))
    has = {w: F.contains(text, F.lit(w)) for p in L.ANTONYMS for w in p}
    x = claims.filter((F.trim("what") != "") & reduce(or_, has.values())).select("cluster_id", "doc_id", "seq", "what")
    me = F.struct("doc_id", "seq", "what")
    names = {w: f"__first{i}" for i, w in enumerate(has)}
    first = x.groupBy("cluster_id").agg(*[F.min(F.when(has[w], me)).alias(c) for w, c in names.items()])
    against = F.array(*[F.when(has[w], F.col(names[o])) for a, b in L.ANTONYMS for w, o in ((a, b), (b, a))])
    met = x.join(first, "cluster_id").withColumn("by", F.array_min(F.filter(against, lambda o: o.isNotNull() & ((o["doc_id"] < F.col("doc_id")) | ((o["doc_id"] == F.col("doc_id")) & (o["seq"] < F.col("seq")))))))
    return met.filter("by is not null").select("cluster_id", "doc_id", "seq", F.col("what").alias("claim"), F.concat(F.lit("Contradicted by: "), F.col("by.what")).alias("contradiction"))
