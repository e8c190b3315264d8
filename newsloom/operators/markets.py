"""Prediction markets: flags, shifts, pages and matching to events."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scoring import clean_slug, divergence, expired, market_category, market_url, unusual_reason, valid_slug

QUESTION_WORD = r"(?<![\p{L}\p{N}_])[a-z][\p{L}\p{N}_]{2,}"
TILE, TASKS = 4096, 4096  # questions or events of a tile, tasks at most
BLOCKS, WIDEST, EVENTS = 64, 32, 16  # blocks that tiles of questions lie in, tiles of such a block at most, tiles of a block of events


def with_flags(markets: DataFrame) -> DataFrame:
    """Slug cleaned, invalid ones dropped, and what is unusual; a column previous_volume_24h lets spikes count."""
    x = markets.withColumn("slug", clean_slug("slug")).filter(valid_slug("slug"))
    previous = "previous_volume_24h" if "previous_volume_24h" in markets.columns else None
    x = x.withColumn("unusual_reason", unusual_reason("volume", "volume_24h", "probability", previous))
    return x.withColumn("is_unusual", F.col("unusual_reason") != "")


def market_page(markets: DataFrame, as_of: float, limit: int, unusual: bool) -> DataFrame:
    """Live markets of largest volume.  Twice the limit is taken before dead links and expired ones are dropped."""
    x = markets.filter("slug is not null and slug <> '' and probability > 0.05 and probability < 0.95")
    order = [F.col("volume").desc(), "id"]
    if unusual:
        x, order = x.filter("is_unusual"), [F.col("volume_24h").desc(), *order]
    page = x.orderBy(*order).limit(2 * limit).withColumn("url", market_url("slug", "source"))
    live = page.filter(valid_slug("slug") & ~expired("end_date", as_of))
    return live.orderBy(*order).limit(limit)


def sorted_page(markets: DataFrame, by: str) -> DataFrame:
    """A page's markets by volume, probability, end date (blank ones last) or daily share of volume."""
    order = {
        "volume": F.col("volume").desc(), "probability": F.col("probability").desc(), "end_date": F.coalesce(F.nullif("end_date", F.lit("")), F.lit("z")).asc(),
        "spike": F.coalesce(F.try_divide("volume_24h", "volume"), F.lit(0.0)).desc(),
    }
    return markets.orderBy(order[by], "id")


def categories(markets: DataFrame) -> DataFrame:
    return markets.groupBy(market_category("question").alias("category")).agg(F.count(F.lit(1)).alias("markets"))


def not_in(markets: DataFrame, shown: DataFrame) -> DataFrame:
    """Markets whose question, or slug where it is blank, is not among `shown`."""
    key = F.coalesce(F.nullif("question", F.lit("")), F.col("slug"))
    return markets.withColumn("__k", key).join(shown.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def price_shift(history: DataFrame, now: DataFrame) -> DataFrame:
    """Per event: newest minus oldest probability of the last 24 hours, from sums over its points alone."""
    recent = F.col("ts") >= F.col("as_of") - 86400.0
    at = F.struct("ts", "seq")
    g = history.crossJoin(F.broadcast(now)).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("points"), F.max_by("probability", F.when(recent, at)).alias("newest"), F.min_by("probability", F.when(recent, at)).alias("oldest")
    )
    shift = F.when((F.col("points") >= 2) & F.col("newest").isNotNull(), F.round(F.col("newest") - F.col("oldest"), 4)).otherwise(0.0)
    direction = F.when(F.col("shift") > 0, "up").when(F.col("shift") < 0, "down").otherwise("flat")
    return g.withColumn("shift", shift).select("cluster_id", "points", "shift", (F.abs("shift") >= 0.10).alias("is_significant"), direction.alias("direction"))


def volume_spikes(observations: DataFrame) -> DataFrame:
    """Observations (slug, ts, volume_24h) of over twice the one before and over 100,000."""
    before = F.lag("volume_24h").over(Window.partitionBy("slug").orderBy("ts", "seq"))
    return observations.withColumn("before", before).filter((F.col("before") > 0) & (F.col("volume_24h") > 2 * F.col("before")) & (F.col("volume_24h") > 100000))


def _best_matches(asked: pa.Table, events: pa.Table) -> pa.Table:
    """(id, score, position) of the best event of each question that has one, of two blocks."""
    events = events.sort_by("position")
    lists = lambda x: x.combine_chunks()
    words, named, own = lists(events["words"]), lists(events["named"]), lists(asked["w"])
    known = pc.unique(words.flatten())

    def index(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Events in the order of their words, and where each word's begin."""
        at, code = np.repeat(np.arange(len(x)), np.asarray(x.value_lengths())), pc.index_in(x.flatten(), known).to_numpy()
        return at[np.argsort(code, kind="stable")], np.searchsorted(np.sort(code), np.arange(len(known) + 1))

    def count(mine: np.ndarray, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, first = x
        return np.bincount(np.concatenate([at[first[c] : first[c + 1]] for c in mine] or [at[:0]]), minlength=len(words))

    size = np.asarray(own.value_lengths())
    edge, codes = np.concatenate(([0], np.cumsum(size))), pc.fill_null(pc.index_in(own.flatten(), known), -1).to_numpy()
    by_word, by_name = index(words), index(named)
    found, scores, places = [], [], []
    for i, n in enumerate(size):
        mine = codes[edge[i] : edge[i + 1]]
        mine = mine[mine >= 0]
        if len(mine) < 0.3 * n - 1e-9:
            continue
        shared = count(mine, by_word)
        some = np.flatnonzero(shared >= 0.3 * n - 1e-9)
        if not len(some):
            continue
        share, hits = shared[some] / n, count(mine, by_name)[some]
        score = np.where(((hits >= 1) & (share >= 0.3)) | (share >= 0.6), share + hits * 0.2, -1.0)
        best = int(score.argmax())  # the first of equal ones is that of the lowest position
        if score[best] >= 0:
            found.append(i)
            scores.append(score[best])
            places.append(some[best])
    return pa.table({"id": asked["id"].take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.float64()), "position": events["position"].take(pa.array(places, pa.int64()))})


def match_events(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Best event for each market question by shared words; entities of an event count double.

    Questions and events are dealt to blocks, and each block of questions meets each block of events as a task: the events of a question's
    words are counted there and the best alone is given on, so no pair is a row.  A question is sent once for EVENTS * TILE events, an event BLOCKS times until
    a block has WIDEST * TILE questions, which is all that a task holds of them.  Ties go to the event of the lower position.  Questions of
    under two words and null ones match nothing.
    """
    stop = F.array(*[F.lit(w) for w in L.QUESTION_STOPWORDS])
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(QUESTION_WORD), F.lit(0)))
    q = markets.select("id", F.array_except(found(F.col("question")), stop).alias("w")).filter(F.size("w") >= 2).checkpoint()
    named = F.coalesce(found(F.array_join("entities", " ")), F.array().cast("array<string>"))
    e = events.select("position", F.array_union(F.coalesce(found(F.col("headline")), F.array().cast("array<string>")), named).alias("words"), named.alias("named")).checkpoint()
    asked, told = (max(1, math.ceil(x.count() / TILE)) for x in (q, e))
    blocks = [max(min(asked, BLOCKS), math.ceil(asked / WIDEST)), math.ceil(told / EVENTS)]
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = q.withColumn("a", number("id", blocks[0])).withColumn("b", each(blocks[1])), e.withColumn("b", number("position", blocks[1])).withColumn("a", each(blocks[0]))
    tasks = min(blocks[0] * blocks[1], TASKS)
    left, right = (x.repartition(tasks, "a", "b").groupBy("a", "b") for x in (left, right))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"id": x["id"].slice(0, 0), "score": pa.array([], pa.float64()), "position": y["position"].slice(0, 0)}) if x.num_columns and y.num_columns else pa.table({})
        return _best_matches(x, y)

    kind = lambda x, c: x.schema[c].dataType.simpleString()
    best = left.cogroup(right).applyInArrow(meet, f"id {kind(markets, 'id')}, score double, position {kind(events, 'position')}")
    return best.groupBy("id").agg(F.max_by("position", F.struct("score", -F.col("position"))).alias("position"), F.max("score").alias("score"))


def market_view(events: DataFrame, history: DataFrame, now: DataFrame) -> DataFrame:
    """(cluster_id, market_odds, points, shift, is_significant, direction, divergent, reason): an event's market beside its news.

    The shift is that of the last 24 hours of its price points (none: 0, flat); events without odds have no market.
    """
    listed = events.filter("market_odds is not null").select("cluster_id", "market_odds", "impact", "impact_score")
    shifts = price_shift(history.join(listed.select("cluster_id"), "cluster_id", "left_semi"), now)
    x = listed.join(shifts, "cluster_id", "left").withColumn("reason", divergence("impact", "impact_score", "market_odds"))
    filled = {"points": F.lit(0).cast("long"), "shift": F.lit(0.0), "is_significant": F.lit(False), "direction": F.lit("flat")}
    return x.select("cluster_id", "market_odds", *[F.coalesce(c, v).alias(c) for c, v in filled.items()], (F.col("reason") != "").alias("divergent"), "reason")
