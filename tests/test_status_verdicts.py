from pyspark.sql import functions as F

from newsloom.operators import markets as K
from newsloom.sources import configured as C
from newsloom.streaming import status as Q


def test_verdicts_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def check(url, timeout):
        (log / f"{url}-{len(list(log.glob(url + '-*')))}").touch()
        return {"good": True, "bad": False, "net": None}[url]

    count = lambda: {u: len(list(log.glob(u + "-*"))) for u in ("good", "bad", "net")}
    markets = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "net"), ("4", None), ("5", "good")], "id string, url string").coalesce(1)
    live, kept = C.checked_links(markets, spark.createDataFrame([], C.VERDICTS), 1000.0, 100.0, check=check)
    assert sorted(r.id for r in live.collect()) == ["1", "5"] and sorted(map(tuple, kept.collect())) == [("bad", False, 1100.0), ("good", True, 1100.0)]
    assert count() == {"good": 1, "bad": 1, "net": 1}
    live, again = C.checked_links(markets, kept, 1050.0, 100.0, check=check)
    assert sorted(r.id for r in live.collect()) == ["1", "5"] and again.count() == 2 and count() == {"good": 1, "bad": 1, "net": 2}
    live, later = C.checked_links(markets, again, 1100.0, 100.0, check=check)  # the verdicts have run out
    assert live.count() == 2 and {r.until for r in later.collect()} == {1200.0} and count() == {"good": 2, "bad": 2, "net": 3}
    assert C._verdict("junk", 1.0) is None and C._verdict("http://127.0.0.1:9/x", 1.0) is None


def test_progress_is_a_table(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    listener = Q.ProgressLog(str(tmp_path / "log"))
    for name in ("feed-a", "feed-b"):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = stream.writeStream.queryName(name).format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            listener.keep(progress if isinstance(progress, dict) else __import__("json").loads(progress.json))
    listener._keep({"id": "gone", "name": None, "batch": -1, "at": None, "rows": 0, "seconds": 0.0, "state_rows": 0, "error": "it broke"})
    got = {r.name: (r.batches, r.rows, r.error) for r in Q.ingestion_status(spark, str(tmp_path / "log")).collect()}
    assert got == {"feed-a": (1, 7, None), "feed-b": (1, 7, None), "gone": (0, 0, "it broke")}


def test_market_view_of_events_without_prices(spark):
    events = spark.createDataFrame([("a", 0.2, "high", 70.0), ("b", None, "low", 1.0), ("c", 0.9, "low", 5.0)], "cluster_id string, market_odds double, impact string, impact_score double")
    history = spark.createDataFrame([("a", 1, 100.0, 0.5), ("a", 2, 200.0, 0.2), ("b", 3, 100.0, 0.1)], "cluster_id string, seq long, ts double, probability double")
    got = {r.cluster_id: (r.points, r.shift, r.is_significant, r.direction, r.divergent) for r in K.market_view(events, history, spark.createDataFrame([(300.0,)], "as_of double")).collect()}
    assert got == {"a": (2, -0.3, True, "down", True), "c": (0, 0.0, False, "flat", True)}
    assert K.market_view(events.filter(F.lit(False)), history, spark.createDataFrame([(300.0,)], "as_of double")).count() == 0
