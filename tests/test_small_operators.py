"""Operators that no query shows."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import maintenance as W
from newsloom.operators import markets as K
from newsloom.operators import vectors as E


def test_texts_of_money_and_lists(spark):
    df = spark.createDataFrame([(2_345_678.0, '["a", "b"]'), (12_499.0, "[]"), (7.4, "junk"), (None, None), (999_999.0, '{"a": 1}')], "v double, j string")
    got = df.select(X.volume_text("v").alias("v"), X.json_list("j").alias("j")).collect()
    assert [r.v for r in got] == ["$2.3M", "$12K", "$7", "$0", "$1000K"] and [r.j for r in got] == [["a", "b"], [], [], [], []]


def test_markets_are_flagged_and_sorted(spark):
    rows = [("a", 6e6, 1e5, 0.5, 0.0), ("b", 1e6, 3e5, 0.5, 1e5), ("c", 2e6, 6e5, 0.97, None), ("d", 10.0, 0.0, 0.5, 1.0), ("e", 0.0, 5.0, 0.2, None)]
    m = spark.createDataFrame([(i, f"slug-{i}", v, d, p, b, "" if i == "a" else f"20{ord(i)}-01-01") for i, v, d, p, b in rows], "id string, slug string, volume double, volume_24h double, probability double, previous_volume_24h double, end_date string")
    got = {r.id: r.unusual_reason for r in K.with_flags(m).collect()}
    assert got == {"a": "High total volume: $6.0M", "b": "Volume spike: 3.0x increase in 24h volume", "c": "High 24h volume: $0.6M; Extreme odds (97%) with significant volume", "d": "", "e": ""}
    ids = lambda by: "".join(r.id for r in K.sorted_page(m, by).collect())
    assert [ids(by) for by in ("volume", "probability", "end_date", "spike")] == ["acbde", "cabde", "debca", "bcade"]


def test_events_are_cleaned_in_bulk(spark):
    rows = [("1", "Senator slams rival https://x.org/a", "", ["Ann Lee", "Traders Now See Chance Today"], "", None), ("2", "Quiet day", None, None, "Health", "Asia"), ("3", "China central bank cuts rates", "", [], None, "")]
    events = spark.createDataFrame(rows, "cluster_id string, headline string, summary string, entities array<string>, topic string, geography string")
    got = {r.cluster_id: r for r in W.refresh_events(events).collect()}
    assert got["1"].headline.strip() == "Senator slams rival" and got["1"].neutral_headline == "Senator criticizes rival" and got["1"].entities == ["Ann Lee"]
    assert (got["2"].topic, got["2"].geography) == ("Health", "Asia") and (got["3"].topic, got["3"].geography) == ("Economy", "Asia")


def test_claims_are_appended(spark):
    table = spark.createDataFrame([("e", "old", 1)], "cluster_id string, what string, extra int")
    new = spark.createDataFrame([("e", "new", "who")], "cluster_id string, what string, who string")
    assert sorted(map(str, W.insert_claims(table, new).collect())) == sorted(["Row(cluster_id='e', what='old', extra=1, who=None)", "Row(cluster_id='e', what='new', extra=None, who='who')"])


def test_vectors_are_saved_and_consolidated(spark, tmp_path):
    v = spark.createDataFrame([("1", "a", [1.0, 3.0]), ("2", "a", [3.0, 5.0]), ("3", "b", None), ("4", None, [1.0, 1.0])], "id string, cluster_id string, embedding array<double>")
    E.save_vectors(v, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 4 and [(r.cluster_id, r.centroid, r.members) for r in E.consolidated(back).collect()] == [("a", [2.0, 4.0], 2)]
    E.save_vectors(v.filter(F.col("id") == "1"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
