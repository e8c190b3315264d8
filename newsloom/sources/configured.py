"""Sources that a configuration or this engine itself gives: feeds, an empty market source, rows to start from, link checks."""

from __future__ import annotations

import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET = "question string, probability double, volume double, volume_24h double, resolution_criteria string, slug string, end_date string, source string"


def feeds(spark: SparkSession, configured: str = "", defaults: tuple[str, ...] = ()) -> DataFrame:
    """One row a feed address: the comma-separated configured ones, or the defaults if there are none."""
    urls = [u.strip() for u in configured.split(",") if u.strip()] or list(defaults)
    return spark.createDataFrame([(u,) for u in urls], "url string")


def callsheet_markets(spark: SparkSession) -> DataFrame:
    """A market source without a public interface: no rows, with the schema of the others."""
    return spark.createDataFrame([], MARKET)


def seed_events(spark: SparkSession) -> DataFrame:
    """Invented events to start an empty table from; insert_events leaves out those that it has."""
    rows = [("seed-1", "Harbor council approves the northern bridge", "Work begins in spring.", ["Harbor Council"], 1_000.0), ("seed-2", "Copper exports rise for a third month", "Mines report record output.", ["Copper Board"], 2_000.0), ("seed-3", "Nordland ratifies the fishing treaty", "Quotas hold for five years.", ["Nordland"], 3_000.0)]
    return spark.createDataFrame(rows, "cluster_id string, headline string, summary string, entities array<string>, latest_timestamp double")


def _answers(url: str, timeout: float) -> bool:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as got:
            return 200 <= got.status < 400
    except (OSError, ValueError):
        return False


def live_links(markets: DataFrame, timeout: float = 5.0, check=_answers) -> DataFrame:
    """Rows whose `url` answers; each distinct address is asked once, and one that cannot be reached counts as dead."""

    def ask(frames):
        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "live": [bool(check(u, timeout)) for u in frame["url"]]})

    asked = markets.select("url").filter("url is not null").distinct().mapInPandas(ask, "url string, live boolean")
    return markets.join(asked.filter("live").select("url"), "url", "left_semi")


VERDICTS = "url string, live boolean, until double"


def _verdict(url: str, timeout: float) -> bool | None:
    """Whether an address answers; null where the network failed, so that nothing is known of it."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as got:
            return 200 <= got.status < 400
    except urllib.error.HTTPError:
        return False
    except (OSError, ValueError):
        return None


def checked_links(markets: DataFrame, verdicts: DataFrame, as_of: float, keep: float = 86400.0, timeout: float = 5.0, check=_verdict) -> tuple[DataFrame, DataFrame]:
    """(rows whose `url` answers, verdicts to keep): only addresses without a verdict that still holds are asked, in tasks.

    verdicts: url, live, until.  New answers hold for `keep` seconds; a failure of the network is not kept and counts as dead this time, as do null addresses.
    """
    valid = verdicts.filter(F.col("until") > float(as_of)).groupBy("url").agg(F.max_by("live", "until").alias("live"), F.max("until").alias("until"))
    unknown = markets.select("url").filter("url is not null").distinct().join(valid, "url", "left_anti")

    def ask(frames):
        for frame in frames:
            answers = [check(u, timeout) for u in frame["url"]]
            yield pd.DataFrame({"url": frame["url"], "live": pd.array(answers, dtype="boolean"), "until": float(as_of) + keep})

    asked = unknown.mapInPandas(ask, VERDICTS).checkpoint()  # an address is asked once, whoever reads the answer
    kept = valid.select("url", "live", "until").unionByName(asked.filter("live is not null"))
    return markets.join(kept.filter("live").select("url"), "url", "left_semi"), kept
