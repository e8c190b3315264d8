"""Links seen once, remembered for a time by keyed state.

Unlike a watermark, nothing that comes late is dropped: an article whose link is new is passed on whatever its time, and a link that comes again
only moves the newest time that its state holds.  A timer evicts a link that has not come for `memory`, so state is bounded by the links of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import PROVIDER


class SeenLinks(StatefulProcessor):
    def __init__(self, columns: list[str], memory_ms: int):
        self.columns, self.memory_ms = columns, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "latest double, due long")

    def _remember(self, latest: float | None, now_ms: int) -> None:
        before = self.link.get()
        if before is not None:
            self.handle.deleteTimer(before[1])
            times = [t for t in (before[0], latest) if t is not None]
            latest = max(times, default=None)
        due = now_ms + self.memory_ms
        self.link.update((latest, due))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, state = timerValues.getCurrentProcessingTimeInMs(), self.link.get()
        first, latest, known = None, None, state is not None and state[1] > now  # a timer that is due may not have fired yet
        for frame in rows:  # in pieces: only the first article and the newest time are held
            times = frame["ts"].dropna()
            if len(times):
                latest = float(times.max()) if latest is None else max(latest, float(times.max()))
            if not known:
                own = frame if first is None else pd.concat([first, frame])
                first = own.sort_values(["ts", "id"], kind="stable", na_position="last").iloc[:1]
        self._remember(latest, now)
        if first is not None:
            yield first[self.columns].astype(object).where(first[self.columns].notna(), None).reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.link.get()
        if state is not None and state[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.link.clear()
        yield pd.DataFrame({c: pd.Series([], dtype=object) for c in self.columns})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        times = initialState["latest"].dropna()
        self._remember(float(times.max()) if len(times) else None, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def seen_once(stream: DataFrame, memory_seconds: float, known: DataFrame | None = None) -> DataFrame:
    """The first article (by ts, then id) of each link that is not remembered, once; articles without a link are dropped.

    stream: id, url, ts and other columns.  `known` (url, ts) is remembered from the start, as links of articles that are there before the first batch.
    A link's time starts again whenever it comes.  Needs Spark's RocksDB state store, which run_seen() sets for its query.
    """
    url_hash = F.md5(F.col("url").cast("binary"))
    rows = stream.filter("coalesce(url, '') <> ''").withColumn("url_hash", url_hash)
    start = None
    if known is not None:
        own = known.filter("coalesce(url, '') <> ''").withColumn("url_hash", url_hash)
        start = own.groupBy("url_hash").agg(F.max("ts").alias("latest")).groupBy("url_hash")
    processor = SeenLinks(rows.columns, int(memory_seconds * 1000))
    return rows.groupBy("url_hash").transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime", initialState=start)


def run_seen(articles: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, name: str | None = None):
    """Write what seen_once() passes on to Parquet, to the end of what is there or by another trigger."""
    spark = articles.sparkSession
    # timers are looked at with each batch; batches for timers alone would never end where all that is there is read
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false" if trigger is None else "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        writer = articles.writeStream.queryName(name) if name else articles.writeStream
        return writer.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
