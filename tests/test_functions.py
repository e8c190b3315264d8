import pytest
from pyspark.sql import functions as F

from newsloom.functions import scoring as S
from newsloom.functions import similarity as M
from newsloom.functions import text as X


def one(spark, value, **columns):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(value.alias("v")).first().v


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.org/x?utm_source=f&id=3", "https://a.org/x?id=3"),
        ("https://a.org/x?UTM_Source=f#top", "https://a.org/x#top"),
        ("https://a.org/x?ref=b&empty=", "https://a.org/x"),
        ("https://a.org/x", "https://a.org/x"),
        (None, ""),
    ],
)
def test_tracking_parameters(spark, url, want):
    assert one(spark, X.strip_tracking("u"), u=url) == want


def test_html_and_boilerplate(spark):
    assert one(spark, X.clean_html("h"), h="<p>Fish &amp; chips</p><script>var a;</script> <b>now</b>") == "Fish & chips now"
    assert one(spark, X.strip_boilerplate("h"), h="Storm nears. Subscribe to our letter today") == "Storm nears."
    assert one(spark, X.strip_urls("h"), h="See  https://x.io/a  now") == "See now"
    assert one(spark, X.strip_urls("h"), h=None) == ""


def test_body_needs_thirty_words(spark):
    para = "<p>" + "word " * 20 + "</p>"
    assert one(spark, X.article_body("h"), h=para) is None
    assert len(one(spark, X.article_body("h"), h=f"<nav><p>{'menu ' * 9}</p></nav>{para}{para}<p>short one</p>").split()) == 40


def test_entities(spark):
    text = "The Harbor Council met on Monday with Ann Lee. Officials from NATO said so. Later, Berlin agreed."
    found = one(spark, X.entities("t"), t=text)
    assert {"Harbor Council", "Ann Lee", "NATO"} <= set(found) and "The" not in found and found == sorted(found)
    assert one(spark, X.entities("t"), t="Parliament Votes On EUR Budget Plan Today") is not None
    assert one(spark, X.entities("t"), t="") == []


def test_key_sentences_keep_their_order(spark):
    text = " ".join(f"Sentence number {i} talks about matter {i * 1111}." for i in range(9))
    got = one(spark, X.key_sentences("t"), t=text)
    assert len(got) == 5 and got == sorted(got, key=text.index)
    assert one(spark, X.key_sentences("t"), t="Only one sentence is in this text.") == ["Only one sentence is in this text."]


def test_sensationalism_bounds(spark):
    calm = one(spark, X.sensationalism("a", "b"), a="Council approves budget", b="The vote was on Monday.")
    loud = one(spark, X.sensationalism("a", "b"), a="SHOCKING collapse: chaos and panic!!", b="Everyone lost everything, the worst ever")
    assert calm < 0.3 < loud <= 1.0
    assert one(spark, X.sensationalism("a", "b"), a="", b="") == 0.0


def test_publisher_names(spark):
    assert one(spark, X.publisher_name("p"), p="News - The Very Long Named Gazette of the Northern Coast") == "The Very Long Named Gazette of the Northern Coast"
    assert one(spark, X.publisher_name("p"), p="Short - name") == "Short - name"


@pytest.mark.parametrize("slug, want", [("a-b-100-200-300-400-500-600-700-800", "a-b"), ("a-2026-100-200", "a-2026-100-200"), ("a-111-222-333-444-555-666-777", "a-111-222-333-444-555-666-777"), ("", "")])
def test_slugs(spark, slug, want):
    assert one(spark, S.clean_slug("s"), s=slug) == want


@pytest.mark.parametrize("date, want", [("2020-01-01T00:00:00Z", True), ("2090-01-01T00:00:00Z", False), ("", False), ("soon", False), ("2020-01-01T00:00:00", False), (None, False)])
def test_expiry(spark, date, want):
    assert one(spark, S.expired("d", 1.7e9), d=date) is want


@pytest.mark.parametrize("score, shift, sources, want", [(61.0, 0.0, 3, "high"), (61.0, 0.0, 2, "medium"), (32.0, 0.0, 1, "medium"), (31.9, 0.0, 9, "low"), (5.0, 0.2, 3, "high"), (5.0, 0.2, 2, "low")])
def test_impact_labels(spark, score, shift, sources, want):
    assert one(spark, S.impact_label("a", F.col("b"), "c"), a=score, b=shift, c=sources) == want


def test_topics_and_geography(spark):
    assert one(spark, S.topic("e", "t"), e=["OPEC"], t="Crude oil price per barrel") == "Economy"
    assert one(spark, S.topic("e", "t"), e=[], t="zzz") == ""
    assert one(spark, S.geography("e", "t"), e=["Berlin"], t="talks in paris") == "Europe"


def test_simhash_matches_a_plain_definition(spark):
    import hashlib
    import re

    def plain(text):
        counts = [0] * 64
        for w in re.findall(r"\w+", text.lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            for i in range(64):
                counts[i] += 1 if h >> i & 1 else -1
        x = sum(1 << i for i in range(64) if counts[i] > 0)
        return x - (1 << 64) if x >= 1 << 63 else x

    texts = ["storm hits the coast", "storm hits the northern coast", "markets close higher", "", "été à la plage"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    table = {r.id: r.simhash for r in M.simhash_table(docs, "id", "t").collect()}
    column = {r.id: r.h for r in docs.select("id", M.simhash_column("t").alias("h")).collect()}
    assert table == column == {i: plain(t) for i, t in enumerate(texts)}


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 2.0], [2.0, 4.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(M.cosine("a", "b").alias("c")).collect()] == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_edges_of_words_are_those_of_unicode(spark):
    """Capitals beside letters that are not ASCII are no word of capitals, on any version of Java."""
    row = spark.createDataFrame([("CIÓNCIEZ!! CIÓNIEAR!! NASA", "ÉCOLE éCOLES ABCDE_ ABCDÉ PLAIN word", "l'ÉAI aié", "Éslams slams it")], "a string, b string, c string, d string")
    got = row.select(X.sensationalism("a", F.lit("")).alias("s"), X.neutral_headline("b").alias("n"), S.ai_relevant("c", F.lit("model training")).alias("r"), X.neutral_headline("d").alias("d"), X.entities("a").alias("e")).first()
    assert got.s == 0.183 and got.n == "ÉCOLE éCOLES ABCDE_ ABCDÉ Plain word" and not got.r and got.d == "Éslams criticizes it" and got.e == ["NASA"]
