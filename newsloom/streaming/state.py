"""State of each event, kept up to date article by article: rollup, last entries, claims, novelty and contradictions.

Counts and the first of equal claims are streaming aggregations.  What is none, the last entries of an event and which claims contradict
one another, is kept by a keyed processor that sees articles and claims with a side of an antonym pair alone.  Each part gives the rows of
its view that a batch touched; the newest row of each key is the view.  No event's claims are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import lexicons as L
from ..functions.scoring import social_score
from ..functions.text import claim_key
from ..operators.coverage import timeline_entry

LAST = 50
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPPOSITE = {w: o for a, b in L.ANTONYMS for w, o in ((a, b), (b, a))}
CHANGES = (
    "cluster_id string, part string, key string, "
    "timeline array<struct<ts:double,ingest_seq:long,entry:string>>, doc_id long, seq long, what string, contradiction string"
)
PARTS = ("rollup", "claim", "entry")
COLUMNS = [c.split()[0] for c in CHANGES.replace("array<struct<ts:double,ingest_seq:long,entry:string>>", "x").split(", ")]


def entries(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """Articles (cluster_id, ts, ingest_seq, publisher, title, source_type, social_coverage) and claims (cluster_id, doc_id, seq, what,
    source_article_id) as one stream of an event's entries, with what the state needs of them."""
    words = F.filter(F.array(*[F.lit(w) for w in OPPOSITE]), lambda w: F.contains(F.lower(F.trim("what")), w))
    source = F.coalesce(F.nullif("source_article_id", F.lit("")), F.lit("unknown"))
    a = articles.select("cluster_id", "ts", "ingest_seq", timeline_entry().alias("entry"), (F.col("source_type") == "social").alias("social"), "social_coverage")
    c = claims.filter("what <> ''").select("cluster_id", "doc_id", "seq", "what", F.trim("what").alias("trimmed"), claim_key("what").alias("key"), source.alias("source"), words.alias("words"))
    return a.unionByName(c, allowMissingColumns=True)


def _frame(event: str, rows: list[dict]) -> pd.DataFrame:
    """Rows of CHANGES, with None for what a part lacks."""
    columns = {c: [event if c == "cluster_id" else r.get(c) for r in rows] for c in COLUMNS}
    kinds = {"doc_id": "Int64", "seq": "Int64"}
    return pd.DataFrame({c: pd.Series(v, dtype=kinds.get(c, object)) for c, v in columns.items()})


class EventState(StatefulProcessor):
    """Last entries and contradictions of each event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "ts array<double>, seq array<long>, entry array<string>")
        self.sides = handle.getValueState("sides", ", ".join(f"d{i} long, s{i} long, w{i} string" for i in range(len(OPPOSITE))))
        self.contrary = handle.getMapState("contrary", "doc_id long, seq long", "what string, words string")

    def _articles(self, rows: pd.DataFrame) -> dict:
        kept = list(zip(*(self.recent.get() or ([], [], [])), strict=True))
        kept += [(None if pd.isna(t) else t, s, e) for t, s, e in zip(rows["ts"], rows["ingest_seq"].astype("int64"), rows["entry"], strict=True)]
        kept = sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))[-LAST:]
        self.recent.update(tuple([list(c) for c in zip(*kept, strict=True)]))
        line = [{"ts": t, "ingest_seq": int(s), "entry": e} for t, s, e in kept]
        return {"part": "timeline", "key": "", "timeline": line}

    def _disputes(self, rows: pd.DataFrame) -> Iterator[dict]:
        words = list(OPPOSITE)
        flat = self.sides.get()
        first = {w: tuple(flat[3 * i : 3 * i + 3]) for i, w in enumerate(words) if flat is not None and flat[3 * i] is not None}
        new = [(int(d), int(s), w, list(x)) for d, s, w, x in zip(rows["doc_id"], rows["seq"], rows["what"], rows["words"], strict=True)]
        moved = set()
        for d, s, what, own in new:
            self.contrary.updateValue((d, s), (what, "\n".join(own)))
            for w in own:
                if w not in first or (d, s, what) < first[w]:
                    # a claim that comes late may be the first that contradicts those which are there
                    moved.add(OPPOSITE[w])
                    first[w] = (d, s, what)
        if moved:
            self.sides.update(tuple(x for w in words for x in first.get(w, (None, None, None))))
            there = ((k[0], k[1], v[0], v[1].split("\n")) for k, v in self.contrary.iterator())
            new = [c for c in there if moved & set(c[3])] + [c for c in new if not moved & set(c[3])]
        for d, s, what, own in new:
            by = min((first[OPPOSITE[w]] for w in own if OPPOSITE[w] in first and first[OPPOSITE[w]][:2] < (d, s)), default=None)
            if by is not None:
                yield {"part": "dispute", "key": f"{d} {s}", "doc_id": d, "seq": s, "what": what, "contradiction": f"Contradicted by: {by[2]}"}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (event,) = key
        for frame in rows:
            out = []
            is_claim = frame["key"].notna()
            if not is_claim.all():
                out.append(self._articles(frame[~is_claim]))
            if is_claim.any():
                out += self._disputes(frame[is_claim])
            if out:
                yield _frame(event, out)

    def close(self) -> None:
        pass


def event_changes(stream: DataFrame) -> DataFrame:
    """What each batch of entries() changes in the last entries and contradictions of the events that it touches."""
    seen = stream.filter("key is null or (trimmed <> '' and size(words) > 0)")
    return seen.groupBy("cluster_id").transformWithStateInPandas(statefulProcessor=EventState(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def rollup_changes(stream: DataFrame) -> DataFrame:
    """Counts of the events that a batch of entries() touches."""
    return stream.filter("key is null").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.sum(F.coalesce(F.when(F.col("social"), F.col("social_coverage")), F.lit(0))).alias("coverage"), F.count_if("social").alias("social"), F.max("ts").alias("latest_timestamp")
    )


def claim_changes(stream: DataFrame) -> DataFrame:
    """The first of equal claims and the least and greatest source of all of them, of the claims that a batch of entries() touches.

    Claims are told apart by 128 bits of their texts, so that state and shuffles hold each text once.
    """
    keyed = stream.filter("key is not null").withColumn("key", F.md5(F.col("key").cast("binary")))
    return keyed.groupBy("cluster_id", "key").agg(F.min(F.struct("doc_id", "seq", "what")).alias("first"), F.min("source").alias("lo"), F.max("source").alias("hi"))


class Kept:
    """The queries that keep the parts of a state."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802
        for query in self.queries:
            query.awaitTermination()


def keep_events(stream: DataFrame, folder: str, checkpoint: str, parts: tuple[str, ...] = PARTS) -> Kept:
    """Run to the end of what is there: batch n writes what it changed in a part under part/batch=n, in place of what an earlier try left there."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def start(part: str) -> StreamingQuery:
        changes = {"rollup": rollup_changes, "claim": claim_changes, "entry": event_changes}[part](stream)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/{part}/batch={n}")
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{part}").trigger(availableNow=True).start()

    try:
        return Kept([start(part) for part in parts])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row written for each key of a view."""
    last = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1")


def _changes(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return spark.read.schema(CHANGES + ", batch long").parquet(f"{folder}/entry").filter(F.col("part") == part)


def kept_rollup(spark: SparkSession, folder: str, timeline: bool = True) -> DataFrame:
    """(cluster_id, source_count, confidence, social_score, latest_timestamp, timeline) as of the last batch; `timeline` needs the part "entry"."""
    kinds = "cluster_id string, source_count long, coverage long, social long, latest_timestamp double, batch long"
    x = _newest(spark.read.schema(kinds).parquet(f"{folder}/rollup"), "cluster_id")
    x = x.select("cluster_id", "source_count", F.least(F.lit(1.0), F.col("source_count") * 0.1 + 0.5).alias("confidence"), social_score("coverage", "social").alias("social_score"), "latest_timestamp")
    if not timeline:
        return x
    # of one batch an event may have more rows than one: its entries only grow, or later ones take the place of earlier ones
    rows = _changes(spark, folder, "timeline").withColumn("last", F.struct("batch", F.size("timeline"), F.transform(F.reverse("timeline"), lambda e: F.struct(e["ts"], e["ingest_seq"]))))
    lines = rows.groupBy("cluster_id").agg(F.max_by("timeline", "last").alias("timeline")).withColumnRenamed("cluster_id", "event")
    return x.join(lines, F.col("cluster_id").eqNullSafe(F.col("event"))).drop("event")


def kept_claims(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, doc_id, seq, what, novel, first_what): the first of equal claims of an event, and whether one source alone makes it."""
    kinds = "cluster_id string, key string, first struct<doc_id:long,seq:long,what:string>, lo string, hi string, batch long"
    x = _newest(spark.read.schema(kinds).parquet(f"{folder}/claim"), "cluster_id", "key")
    return x.select("cluster_id", "first.doc_id", "first.seq", "first.what", (F.col("lo") == F.col("hi")).alias("novel"), F.trim("first.what").alias("first_what"))


def kept_disputes(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, doc_id, seq, claim, contradiction) as of the last batch."""
    rows = _changes(spark, folder, "dispute")
    return rows.groupBy("cluster_id", "doc_id", "seq").agg(F.max_by("what", "batch").alias("claim"), F.max_by("contradiction", "batch").alias("contradiction"))
