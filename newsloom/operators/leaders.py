"""Articles in the order of their time, each joining an event that is there by then or opening one.

What a loop over articles would do one by one is done here for a whole batch.  An article opens an event exactly if no earlier node
(event, or article that opens one) resembles it, so the openers are settled in rounds: an article with an opener among its earlier
look-alikes is none, and one whose earlier look-alikes are all settled otherwise is one.  Equal headlines and equal fingerprints
meet at their key, so copies make no pairs.  What is left when few articles are open is settled in order by one task.

Headlines and names meet within two days only, as no rule looks further back.  Joins are by sorted shuffles: none sends a table by way of
the driver, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import DUPLICATE, dedup_score, entity_jaccard, hamming, simhash_similarity, simhash_text
from ..functions.text import neutral_headline, strip_urls, text_of
from ..session import Rounds
from .dedup import STRIP, TILE

NEAR_BITS = 9  # a similarity over 0.85 of 64 bits
RECENT, SIZE_MOST, SUMMARY = 86400.0, 50, 300
LEAST_SHARED = (DUPLICATE - 0.4 * (1 - (NEAR_BITS + 1) / 64) - 0.3) / 0.3  # share of names that a score over DUPLICATE needs if headlines are not near
LOCAL = 2000  # open articles that one task settles


def _merged(x: DataFrame) -> DataFrame:
    """To be joined by a sorted shuffle: broadcasts of each round's tables would gather in the driver."""
    return x.hint("merge")


def _key(headline: Column | str) -> Column:
    return F.lower(F.trim(strip_urls(headline)))


def _names(x: str) -> Column:
    return F.array_distinct(F.transform(F.coalesce(F.col(x), F.array().cast("array<string>")), F.lower))


def _nodes(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Events and articles alike: place (events first, then by time and id), headline keys, fingerprints, names."""

    def node(x: DataFrame, rank: int, name: str, head: str, body: Column, opened: Column, ts: str, seen: str, takes: Column) -> DataFrame:
        if "content" in x.columns:
            own, as_event = F.col("content"), F.col("summary")
        else:
            own, as_event = (simhash_text(F.concat_ws(" ", text_of(head), t)) for t in (text_of(body), F.substring(text_of(body), 1, SUMMARY)))
        return x.select(
            F.struct(F.lit(rank).alias("rank"), F.coalesce(F.col(ts), F.lit(0.0)).alias("ts"), F.col(name).alias("id")).alias("place"), opened.alias("event"),
            _key(head).alias("key"), _key(neutral_headline(head)).alias("neutral"), simhash_text(_key(head)).alias("h"), simhash_text(text_of(head)).alias("title"),
            own.alias("content"), as_event.alias("summary"), _names("entities").alias("names"), F.col(seen).alias("seen"), takes.alias("takes"),
        )

    known = node(events, 0, "cluster_id", "headline", F.col("summary"), F.col("cluster_id"), "earliest_timestamp", "latest_timestamp", F.col("source_count") < SIZE_MOST)
    new = node(articles, 1, "id", "title", F.col("text"), F.concat(F.lit("event-"), F.col("id")), "ts", "ts", F.lit(True))
    return known.unionByName(new)


def _packed(hashes: DataFrame, *by: str) -> DataFrame:
    """(by, tile, hs): rows (by, h, tiles) dealt to that many tiles."""
    return hashes.groupBy(*by, F.pmod(F.xxhash64("h"), "tiles").cast("int").alias("tile")).agg(F.collect_list("h").alias("hs"))


def _meetings(n: Column | str, day: Column, back: int, late: bool | None = None) -> Column:
    """Meetings of a tile with each of n tiles: tile a of a day and tile b of `back` days before; late: it is the former."""
    tile, n = F.col("tile"), F.col(n) if isinstance(n, str) else n

    def meeting(i: Column) -> Column:
        a, b, first = (F.least(tile, i), F.greatest(tile, i), tile <= i) if late is None else (tile, i, F.lit(True)) if late else (i, tile, F.lit(False))
        return F.struct(day.cast("long").alias("day"), F.lit(back).alias("back"), a.cast("int").alias("a"), b.cast("int").alias("b"), first.alias("late"))

    return F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n), meeting)


def _compared(tiles: DataFrame, most: int) -> DataFrame:
    """(h, day, other, back, distance): hashes of tiles that meet, (meetings, hs), which differ in at most `most` bits; inside a day both ways and each with itself.

    Two tiles are compared as arrays, strip by strip: no candidate is a row.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(late, hs.values.to_numpy().view(np.uint64), k) for x in batches for late, hs, *k in zip(x["late"].to_pylist(), x["hs"], *(x[c].to_pylist() for c in ("day", "back", "a", "b")), strict=True)]
        day, back, a, b = got[0][2]
        alone = back == 0 and a == b
        if len(got) == 1 and not alone:
            return  # the other tile has no rows
        own, other = max(got, key=lambda x: x[0])[1], min(got, key=lambda x: x[0])[1]
        for start in range(0, len(own), STRIP):
            bits = np.bitwise_count(own[start : start + STRIP, None] ^ other[None, :])
            i, j = np.nonzero(bits <= most)
            h, o, d = own[i + start].view(np.int64), other[j].view(np.int64), bits[i, j].astype(np.int32)
            if back == 0 and not alone:
                h, o, d = np.concatenate((h, o)), np.concatenate((o, h)), np.concatenate((d, d))
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), day, np.int64)), pa.array(o), pa.array(np.full(len(h), back, np.int32)), pa.array(d)], ["h", "day", "other", "back", "distance"])

    met = tiles.select(F.explode("meetings").alias("k"), "hs").select("k.*", "hs")
    return met.groupBy("day", "back", "a", "b").applyInArrow(compare, "h long, day long, other long, back int, distance int")


def near_days(hashes: DataFrame, known: DataFrame | None = None, most: int = NEAR_BITS) -> DataFrame:
    """(h, day, other, back, distance): of distinct rows (day, h), the near hashes of the same day (back 0, each with itself) and of the day before (1).

    `known` (distinct h) are near whenever they are seen (back 2, day 0).  What is shuffled is a tile once for each one that it meets; comparisons grow
    with the rows times those of two days.
    """
    days = hashes.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    around = days.join(days.select(F.col("day") + 1, F.col("tiles").alias("before")).toDF("day", "before"), "day", "left").join(days.select(F.col("day") - 1, F.col("tiles").alias("after")).toDF("day", "after"), "day", "left")
    by_day = _packed(hashes.join(around.fillna(0, ["before", "after"]), "day"), "day", "tiles", "before", "after")
    day = F.col("day")
    tiles = by_day.select(F.concat(_meetings("tiles", day, 0), _meetings("before", day, 1, late=True), _meetings("after", day + 1, 1, late=False)).alias("meetings"), "hs")
    if known is not None:
        new = hashes.select("h").distinct()
        n_new, n_known = (F.lit(math.ceil(x.count() / TILE)) for x in (new, known))
        for x, own, other, late in ((new, n_new, n_known, True), (known, n_known, n_new, False)):
            tiles = tiles.unionByName(_packed(x.withColumn("tiles", own)).select(_meetings(other, F.lit(0), 2, late=late).alias("meetings"), "hs"))
    return _compared(tiles, most)


def near_hashes(hashes: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """(h, other, distance): every pair of the distinct hashes `h` that differ in at most `most` bits, both ways, and each with itself."""
    return near_days(hashes.select(F.lit(0).cast("long").alias("day"), "h"), most=most).select("h", "other", "distance")


def scored_pairs(nodes: DataFrame) -> DataFrame:
    """(place, earlier, score): articles and earlier nodes of the last day whose weighted score is over DUPLICATE, but whose headlines are not near.

    Such a pair shares names, and unless its headlines are near (which another rule sees) at least LEAST_SHARED of them: it meets at one
    of the rarest names of both, in which the commonest need not take part.  Articles meet those of their day and of the day before.  A pair
    is no row if its fingerprints lie too far apart for any names, or if its headlines are near (copies among them).
    """
    named = nodes.select("place", F.explode("names").alias("name"))
    seen = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    ranked = named.join(_merged(seen), "name").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("ranked"))  # the names of one headline or text
    size = F.size("ranked")
    rare = F.slice("ranked", F.lit(1), (size - F.ceil(size * LEAST_SHARED) + 1).cast("int"))
    keyed = nodes.join(_merged(ranked.select("place", rare.alias("rare"))), "place").withColumn("name", F.explode(F.transform("rare", lambda x: x["name"])))
    head = F.when(F.col("key") != "", F.col("h"))
    left = keyed.filter("place.rank = 1").select("name", "day", "place", head.alias("ha"), F.col("title").alias("ta"), F.col("content").alias("ca"))
    right = keyed.filter("takes").select("name", "day", F.col("place").alias("earlier"), head.alias("hb"), F.col("title").alias("tb"), F.col("summary").alias("cb"), "seen")
    # those of the day before lie in the day after theirs too
    days = right.filter("earlier.rank = 1").withColumn("day", F.explode(F.array(F.col("day"), F.col("day") + 1)))
    met = left.join(_merged(days), ["name", "day"]).unionByName(left.join(_merged(right.filter("earlier.rank = 0").drop("day")), "name"))
    alike = lambda names: dedup_score(simhash_similarity("ta", "tb"), simhash_similarity("ca", "cb"), names)
    met = met.filter((F.col("earlier") < F.col("place")) & (F.col("seen") >= F.col("place.ts") - RECENT) & F.coalesce(hamming("ha", "hb") > NEAR_BITS, F.lit(True)) & (alike(F.lit(1.0)) > DUPLICATE))
    met = met.drop("name", "day", "seen", "ha", "hb").distinct()
    both = met.join(_merged(nodes.select("place", F.col("names").alias("ea"))), "place").join(_merged(nodes.select(F.col("place").alias("earlier"), F.col("names").alias("eb"))), "earlier")
    return both.withColumn("score", alike(entity_jaccard("ea", "eb"))).filter(F.col("score") > DUPLICATE).select("place", "earlier", "score")


def _by_key(some: DataFrame, name: str) -> DataFrame:
    """(key, first place of these nodes with that headline, as it is or neutral)."""
    keys = some.select("place", "key").unionByName(some.select("place", F.col("neutral").alias("key"))).filter("key <> ''")
    return keys.groupBy("key").agg(F.min("place").alias(name))


def _by_hash(some: DataFrame, near: DataFrame, name: str) -> DataFrame:
    """(h, day, first place of that day's nodes with a near headline, last time of those of the day before)."""
    own = some.filter("key <> ''").groupBy(F.col("h").alias("other"), F.col("day").alias("on")).agg(F.min("place").alias("p"), F.max("place.ts").alias("t"))
    met = near.filter("back < 2").withColumn("on", F.col("day") - F.col("back")).join(_merged(own), ["other", "on"])
    return met.groupBy("h", "day").agg(F.min(F.when(F.col("back") == 0, F.col("p"))).alias(f"{name}_today"), F.max(F.when(F.col("back") == 1, F.col("t"))).alias(f"{name}_before"))


def _is_met(name: str) -> Column:
    """Whether an earlier node was joined as a look-alike by headline, by fingerprint within a day, or by score."""
    near = F.coalesce(F.col(f"{name}_today") < F.col("place"), F.lit(False)) | F.coalesce(F.col(f"{name}_before") >= F.col("place.ts") - RECENT, F.lit(False))
    return F.coalesce(F.col(f"{name}_key") < F.col("place"), F.lit(False)) | ((F.col("key") != "") & near) | F.coalesce(F.col(f"{name}_pair"), F.lit(False))


def _met_known(articles: DataFrame, known: DataFrame, near: DataFrame, pairs: DataFrame) -> DataFrame:
    """Articles with opens: false where a known event takes them, else null."""
    last = known.filter("key <> ''").groupBy(F.col("h").alias("other")).agg(F.max("seen").alias("t"))
    seen = near.filter("back = 2").select("h", "other").join(_merged(last), "other").groupBy("h").agg(F.max("t").alias("t"))
    scored = pairs.filter("earlier.rank = 0").select("place").distinct().withColumn("scored", F.lit(True))
    x = articles.join(_merged(_by_key(known, "k")), "key", "left").join(_merged(seen), "h", "left").join(_merged(scored), "place", "left")
    by_headline = (F.col("key") != "") & (F.col("t") >= F.col("place.ts") - RECENT)
    return x.withColumn("opens", F.when(F.col("k").isNotNull() | by_headline | F.col("scored"), F.lit(False))).select(*articles.columns, "opens")


def _round(state: DataFrame, near: DataFrame, pairs: DataFrame, open_more: bool = True) -> DataFrame:
    """The articles after one round; opens is true or false once one is settled.  Without open_more, none becomes an opener."""
    todo = state.filter("opens is null")
    x = todo
    for some, name in ((state.filter("opens"), "led"), (todo, "open")):
        x = x.join(_merged(_by_key(some, f"{name}_key")), "key", "left").join(_merged(_by_hash(some, near, name)), ["h", "day"], "left")
    of_pairs = pairs.join(_merged(state.select(F.col("place").alias("earlier"), "opens")), "earlier").groupBy("place").agg(F.bool_or(F.coalesce("opens", F.lit(False))).alias("led_pair"), F.bool_or(F.col("opens").isNull()).alias("open_pair"))
    settled = x.join(_merged(of_pairs), "place", "left").withColumn("opens", F.when(_is_met("led"), F.lit(False)).when(~_is_met("open") & F.lit(open_more), F.lit(True)))
    return state.filter("opens is not null").unionByName(settled.select(*state.columns))


def _settle_rest(todo: DataFrame, pairs: DataFrame) -> DataFrame:
    """(place, opens) of at most LOCAL open articles, in order, by one task; no opener is among their earlier look-alikes yet."""
    among = pairs.join(todo.select("place"), "place", "left_semi").join(todo.select(F.col("place").alias("earlier")), "earlier", "left_semi")
    near = among.groupBy("place").agg(F.collect_list("earlier.id").alias("like"))
    rows = todo.join(near, "place", "left").select("place.ts", "place.id", "key", "neutral", "h", "like").withColumn("all", F.lit(1))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, hashes, openers, out = set(), [], set(), []
        alike = lambda r, h, ts: ts >= r.ts - RECENT and ((int(r.h) ^ h) & (2**64 - 1)).bit_count() <= NEAR_BITS
        for r in pdf.sort_values(["ts", "id"]).itertuples():
            led = bool(r.key) and (r.key in heads or any(alike(r, *x) for x in hashes))
            opens = not led and not (r.like is not None and openers & set(r.like))
            if opens:
                openers.add(r.id)
                heads |= {r.key, r.neutral} - {""}
                if r.key:
                    hashes.append((int(r.h), r.ts))
            out.append((r.id, opens))
        return pd.DataFrame(out, columns=["id", "opens"])

    done = rows.groupBy("all").applyInPandas(settle, "id string, opens boolean")
    return todo.drop("opens").join(done, F.col("place.id") == F.col("id")).drop("id")


def led_articles(articles: DataFrame, events: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, cluster_id, how): the event of each article, as if they came one by one in the order of (ts, id).

    articles: id, title, text, entities, ts; or instead of text the fingerprints content and summary, of the title with the text and with its first SUMMARY
    characters.  events: cluster_id, headline, summary, entities, earliest_timestamp, latest_timestamp, source_count.
    An article joins, of the events there by then, the first with an equal headline (as it is or neutral, without links); else the one of
    the last day whose headline's fingerprint is nearest, at over 0.85; else the one of the last day and of under 50 articles with the highest weighted score
    over 0.70; ties go to events before articles, then to the earlier.  Otherwise it opens the event "event-" and its id (how: opened).

    Time and size of an event are those given, or of the article that opened it; as long as events are given with the time of their opening and stay
    under 50 articles, any split of the articles into batches gives the same events.  Articles without a title join by score only; a null time counts as 0;
    ids are distinct.  Rounds grow with the longest chain of articles that wait for each other; each ends in a table of the checkpoint folder.
    """
    nodes = _nodes(articles, events).withColumn("day", F.floor(F.col("place.ts") / RECENT)).checkpoint()
    heads = nodes.filter("key <> ''")
    near_ = near_days(heads.filter("place.rank = 1").select("day", "h").distinct(), heads.filter("place.rank = 0").select("h").distinct()).checkpoint()
    pairs = scored_pairs(nodes).checkpoint()
    columns = ["place", "event", "key", "neutral", "h", "day", "seen"]
    known = nodes.filter("place.rank = 0").select(*columns)
    rounds, asked, met = (Rounds(articles.sparkSession) for _ in range(3))
    state = rounds.write(_met_known(nodes.filter("place.rank = 1").select(*columns), known, near_, pairs))
    state = rounds.write(_round(state, near_, pairs))
    before, near, like = math.inf, near_, pairs
    while (left := state.filter("opens is null").count()) > local:
        if left * 2 < before:  # what rounds read and send of near hashes and pairs goes down with the articles that are open
            todo, before = state.filter("opens is null"), left
            near = asked.write(near.join(_merged(todo.select("h", "day").distinct()), ["h", "day"], "left_semi"))
            like = met.write(like.join(_merged(todo.select("place")), "place", "left_semi"))
        state = rounds.write(_round(state, near, like))
    if left:
        state = rounds.write(_round(state, near, like, open_more=False))
        rest = _settle_rest(state.filter("opens is null"), like)
        state = rounds.write(state.filter("opens is not null").unionByName(rest.select(*state.columns)))
    state = state.unionByName(known.withColumn("opens", F.lit(True)))

    opener = state.filter("opens")
    x = state.filter("place.rank = 1 and not opens").select("place", "key", "h", "day")
    exact = x.join(_merged(_by_key(opener, "p")), "key").filter("p < place").select("place", F.struct(F.lit(0).alias("rule"), F.lit(0.0).alias("far"), "p").alias("best"))
    heads = opener.filter("key <> ''").select(F.col("h").alias("other"), F.col("place").alias("p"), "seen", (F.col("place.rank") == 0).alias("old"), F.when(F.col("place.rank") == 1, F.col("day")).otherwise(0).alias("on"))
    # openers lie apart, so few are near a hash, however many hashes are near each other
    met = near_.withColumn("old", F.col("back") == 2).withColumn("on", F.when(~F.col("old"), F.col("day") - F.col("back")).otherwise(0)).join(_merged(heads), ["other", "old", "on"])
    by_headline = x.filter("key <> ''")
    like = by_headline.join(_merged(met.filter("not old")), ["h", "day"]).select("place", "p", "seen", "distance")
    like = like.unionByName(by_headline.join(_merged(met.filter("old").drop("day")), "h").select("place", "p", "seen", "distance"))
    like = like.filter((F.col("p") < F.col("place")) & (F.col("seen") >= F.col("place.ts") - RECENT))
    near = like.select("place", F.struct(F.lit(1).alias("rule"), F.col("distance").cast("double").alias("far"), "p").alias("best"))
    scored = pairs.join(_merged(opener.select(F.col("place").alias("earlier"))), "earlier", "left_semi").select("place", F.struct(F.lit(2).alias("rule"), (-F.col("score")).alias("far"), F.col("earlier").alias("p")).alias("best"))
    best = exact.unionByName(near).unionByName(scored).groupBy("place").agg(F.min("best").alias("best"))
    joined = best.join(_merged(opener.select(F.col("place").alias("p"), "event")), F.col("best.p") == F.col("p")).select(
        F.col("place.id").alias("id"), F.col("event").alias("cluster_id"), F.get(F.array(F.lit("exact"), F.lit("near"), F.lit("score")), F.col("best.rule")).alias("how")
    )
    return joined.unionByName(opener.filter("place.rank = 1").select("place.id", F.col("event").alias("cluster_id"), F.lit("opened").alias("how")))
