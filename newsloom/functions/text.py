"""Text functions as column expressions; only character references of HTML are decoded in Arrow batches, where there are any."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as L

WORD = r"[\p{L}\p{N}_]+"  # Unicode words; Java's own \w is ASCII
# The edge of a Unicode word, the same on all versions of Java; its own \b is ASCII from 19 on.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, of) -> Column:
    """of(x) with x bound as a lambda's variable: inside a lambda or in several places, an expression is computed anew each time."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def text_of(x: Column | str) -> Column:
    """The string, '' for null."""
    return F.coalesce(col(x), F.lit(""))


def edged(pattern: str) -> str:
    """A pattern with the edges of Unicode words for its \\b."""
    return pattern.replace(r"\b", EDGE)


def words(x: Column | str) -> Column:
    """Lower-cased words in order, with repeats."""
    return F.regexp_extract_all(F.lower(text_of(x)), F.lit(WORD), F.lit(0))


def content_words(x: Column | str, stopwords=L.HEADLINE_STOPWORDS) -> Column:
    """Distinct words of two letters or more that are no stop-words."""
    keep = F.filter(F.array_distinct(words(x)), lambda w: F.length(w) > 1)
    return F.array_except(keep, F.array(*[F.lit(w) for w in stopwords]))


def word_count(x: Column | str) -> Column:
    t = F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def strip_urls(x: Column | str) -> Column:
    """Without links; runs of blanks become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(x), r"https?://\S+", ""), r"\s{2,}", " "))


def _encoded(x: Column) -> Column:
    """Form encoding; '~' stays and '*' does not, unlike in Java."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def strip_tracking(url: Column | str, names=L.TRACKING) -> Column:
    """The link without tracking parameters and parameters of no value; the fragment stays.

    Names and values are decoded and encoded again, repeated names come together at the first one's place; what cannot be
    decoded stays as it is.
    """
    u = text_of(url)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(u, r"(#.*)$", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    named = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+")),
        lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(*names))
    keys = F.transform(kept, lambda p: p["k"])
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.array_position(keys, p["k"]).alias("at"), i.alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    pairs = F.transform(placed, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    return F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), fragment)


def url_host(url: Column | str) -> Column:
    """Lower-cased host without 'www.'; '' if there is none."""
    return F.replace(F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def feed_host(url: Column | str) -> Column:
    """Host of a feed's address, without 'feeds.' and 'rss.' too."""
    return F.replace(F.replace(url_host(url), F.lit("feeds."), F.lit("")), F.lit("rss."), F.lit(""))


@F.arrow_udf(T.StringType())
def _unescaped(x: pa.Array) -> pa.Array:
    return pa.array([v if v is None else html.unescape(v) for v in x.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _each_unescaped(x: pa.Array) -> pa.Array:
    return pa.array([v if v is None else [html.unescape(t) for t in v] for v in x.to_pylist()], pa.list_(pa.string()))


def _without_tags(x: Column) -> Column:
    for tag in ("script", "style"):
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(x, r"<[^>]+>", " ")


def _one_blank(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _decoded(x: Column, references: tuple[tuple[str, str], ...]) -> Column:
    """With these references alone decoded, in their order."""
    for reference, char in references:
        x = F.replace(x, F.lit(reference), F.lit(char))
    return x


def clean_html(x: Column | str, references: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Text of a piece of HTML: no scripts, styles or tags, character references decoded, blanks collapsed.

    As browsers do, "&amp" is decoded without its semicolon too; with `references` (text, character), these alone are.
    """
    t = _without_tags(text_of(x))
    if references is not None:
        return _one_blank(_decoded(t, references))
    return _one_blank(F.coalesce(_unescaped(F.when(F.contains(t, F.lit("&")), t)), t))


def strip_boilerplate(x: Column | str) -> Column:
    t = text_of(x)
    for pattern in L.BOILERPLATE:
        t = F.regexp_replace(t, "(?i)" + pattern, "")
    return F.trim(t)


def article_body(html: Column | str, least_words: int = 5, least_total: int = 30, references: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Text of the paragraphs of a page; null if less than `least_total` words are left.  `references` are those of clean_html()."""
    t = text_of(html)
    for tag in L.NON_CONTENT:
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    paragraphs = F.regexp_extract_all(t, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.transform(paragraphs, _without_tags)
    if references is not None:
        plain = F.transform(plain, lambda p: _decoded(p, references))
    else:
        some = F.exists(plain, lambda p: F.contains(p, F.lit("&")))
        plain = F.coalesce(_each_unescaped(F.when(some, plain)), plain)
    clean = F.filter(F.transform(plain, lambda p: strip_boilerplate(_one_blank(p))), lambda p: word_count(p) >= least_words)
    body = F.array_join(clean, " ")
    return F.when(word_count(body) >= least_total, body)


def is_title_case(x: Column | str) -> Column:
    """Three words or more, over 60 % of which begin with a capital."""
    w = F.split(F.trim(text_of(x)), r"\s+")
    return (F.size(w) >= 3) & (F.size(F.filter(w, lambda v: v.rlike(r"^\p{Lu}"))) / F.size(w) > 0.6)


def neutral_headline(title: Column | str) -> Column:
    """Headline without emoji, shouting, labels, show names, dates and loaded verbs."""
    t = F.replace(F.regexp_replace(text_of(title), L.EMOJI, ""), F.lit("!"), F.lit("."))
    pieces = F.regexp_extract_all(t, F.lit(edged(r"\b[A-Z]{5,}\b|(?s:.)")), F.lit(0))
    t = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 1, F.initcap(p)).otherwise(p)), "")
    for pattern in L.HEADLINE_LABELS:
        t = F.regexp_replace(t, "(?i)" + pattern, "")
    for pattern in L.HEADLINE_DATES:
        t = F.regexp_replace(t, pattern, "")
    for pattern, word in L.NEUTRAL:
        t = F.regexp_replace(t, "(?i)" + edged(pattern), word)
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def key_sentences(text: Column | str, k: int = 5) -> Column:
    """The k sentences of most numbers, quotes and names, in the order of the text; all if there are no more than k."""
    cut = F.filter(F.transform(F.split(F.trim(text_of(text)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)

    def score(s: Column, i: Column, last: Column) -> Column:
        n = F.size(F.split(F.trim(s), r"\s+"))
        place = F.when(i == 0, 2.0).when(i == last, 1.0).otherwise(0.0)
        length = once(n, lambda n: F.when(n < 5, -1.0).when(n > 50, -0.5).otherwise(0.0))
        found = lambda p: F.size(F.regexp_extract_all(s, F.lit(edged(p)), F.lit(0)))
        return place + found(r"\b\d[\d,.%$]+\b") * 0.5 + found(r'"[^"]{10,}"') * 1.5 + found(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+") * 0.3 + length

    def best(parts: Column) -> Column:
        last = F.size(parts) - 1
        ranked = F.array_sort(F.transform(parts, lambda s, i: F.struct((-score(s, i, last)).alias("s"), i.alias("i"), s.alias("t"))))
        first = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
        return F.when(F.size(parts) <= k, parts).otherwise(F.transform(first, lambda x: x["t"]))

    return once(cut, best)  # one pass: the text is not cut again for each of its sentences


def entities(text: Column | str, stopwords=L.ENTITY_STOPWORDS, most: int = 20) -> Column:
    """Names in a text by capitalisation: phrases of up to three words, words after a sentence's first, acronyms.

    Lines in title case give acronyms only, unless the whole text is such lines.
    """
    stop = F.array(*[F.lit(w) for w in stopwords])
    lines = F.filter(F.transform(F.split(text_of(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    plain = F.filter(lines, lambda s: ~is_title_case(s))
    body = F.array_join(F.when(F.size(plain) > 0, plain).otherwise(lines), " ")
    named = lambda w: ~F.array_contains(stop, w)

    def trimmed(phrase: Column) -> Column:
        w = F.split(phrase, r"\s+")
        at = F.filter(F.transform(w, lambda v, i: F.when(named(v), i)), lambda i: i.isNotNull())
        lo, hi = F.array_min(at), F.array_max(at)
        kept = F.slice(w, lo + 1, hi - lo + 1)
        enough = F.size(F.filter(kept, named)) * 2 >= F.size(kept)
        return F.when((F.size(w) <= 3) & (F.size(at) > 0), F.when(enough, F.array_join(kept, " ")))

    multi = F.transform(F.regexp_extract_all(body, F.lit(edged(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")), F.lit(1)), trimmed)
    single = F.filter(F.regexp_extract_all(body, F.lit(r"(?<=[.!?]\s)([A-Z][a-z]{2,})"), F.lit(1)), named)
    acronyms = F.filter(F.regexp_extract_all(F.array_join(lines, " "), F.lit(edged(r"\b([A-Z]{3,})\b")), F.lit(1)), named)
    found = F.filter(F.concat(multi, single, acronyms), lambda e: e.isNotNull() & (e != ""))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, most)


def sensationalism(title: Column | str, text: Column | str) -> Column:
    """0 (neutral) to 1: distinct loaded words, bait in the title, shouting and exclamation marks."""
    t, x = text_of(title), text_of(text)
    both = F.concat(t, F.lit(" "), x)
    tokens = F.array_distinct(words(both))
    hits = lambda lexicon: F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in lexicon])))
    bait = sum((F.lower(t).rlike(p).cast("int") for p in L.BAIT), F.lit(0))
    caps = F.size(F.regexp_extract_all(both, F.lit(edged(r"\b[A-Z]{4,}\b")), F.lit(0)))
    marks = F.length(F.concat(t, x)) - F.length(F.replace(F.concat(t, x), F.lit("!"), F.lit("")))
    part = lambda n, full, weight: F.least(n / full, F.lit(1.0)) * weight
    total = part(hits(L.EMOTIONAL), 3.0, 0.3) + part(hits(L.ABSOLUTE), 3.0, 0.15) + part(hits(L.LOADED), 3.0, 0.15) + part(bait, 2.0, 0.15) + part(caps, 3.0, 0.1) + part(marks, 2.0, 0.15)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.round(F.least(total, F.lit(1.0)), 3))


def fact_density(claims: Column | str, n_words: Column | str) -> Column:
    """Claims a word, to four places; 0 without words."""
    return F.when(col(n_words) > 0, F.round(col(claims) / col(n_words), 4)).otherwise(0.0)


def publisher_name(x: Column | str) -> Column:
    """A long publisher's name cut to the part that says who it is."""
    p = col(x)
    parted = p
    for sep in reversed(L.PUBLISHER_SEPARATORS):
        halves = F.split(p, re.escape(sep), 2)
        left, right = F.trim(F.get(halves, F.lit(0))), F.trim(F.get(halves, F.lit(1)))
        generic = F.lower(left).isin(*L.GENERIC_PUBLISHERS) | F.lower(left).startswith("frb")
        parted = F.when(F.contains(p, F.lit(sep)), F.when(generic, right).otherwise(left)).otherwise(parted)
    parted = F.trim(F.regexp_replace(parted, L.PUBLISHER_ENDING, ""))
    cut = F.when(F.length(parted) > 60, F.concat(F.substring(parted, 1, 57), F.lit("..."))).otherwise(parted)
    return F.when(F.length(p) > 40, cut).otherwise(p)


def claim_key(x: Column | str) -> Column:
    """A claim's text as it is compared."""
    return F.regexp_replace(F.lower(F.trim(col(x))), r"\s+", " ")


def display_headline(neutral: Column | str, headline: Column | str) -> Column:
    """Neutral headline, else the headline, without links, cut to 120 characters at a word."""
    h = strip_urls(F.coalesce(F.nullif(col(neutral), F.lit("")), col(headline), F.lit("")))
    return F.when(F.length(h) > 120, F.concat(F.regexp_replace(F.substring(h, 1, 117), r" [^ ]*$", ""), F.lit("..."))).otherwise(h)


def short_publisher(x: Column | str) -> Column:
    """A feed's publisher of over 50 characters cut to the part before its first separator, and to 60 characters."""
    p = col(x)
    out = p
    for sep in reversed(L.PUBLISHER_SEPARATORS):
        out = F.when(F.contains(p, F.lit(sep)), F.trim(F.get(F.split(p, re.escape(sep), 2), F.lit(0)))).otherwise(out)
    cut = F.when(F.length(out) > 60, F.concat(F.substring(out, 1, 57), F.lit("..."))).otherwise(out)
    return F.when(F.length(p) > 50, cut).otherwise(p)


def joined_list(x: Column | str) -> Column:
    """A list as one string with '; ' between its entries; '' for null or an empty list."""
    return F.coalesce(F.array_join(col(x), "; "), F.lit(""))


def relative_time(ts: Column | str, as_of: Column | float) -> Column:
    """How long ago a time was: 'just now', '5m ago', '3h ago' or '2d ago'; '' for null."""
    age = F.floor((as_of if isinstance(as_of, Column) else F.lit(float(as_of))) - col(ts))
    ago = lambda unit, name: F.concat(F.floor(age / unit).cast("string"), F.lit(f"{name} ago"))
    label = F.when(age < 60, "just now").when(age < 3600, ago(60, "m")).when(age < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))
    return F.when(age.isNull() | F.isnan(col(ts)), "").otherwise(label)


def clean_entities(entities: Column | str, stopwords=L.ENTITY_STOPWORDS) -> Column:
    """Stored names without fragments of sentences: of up to three words, outer stop-words cut, and over half of the rest no stop-words."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    named = lambda w: ~F.array_contains(stop, w)

    def cut(name: Column) -> Column:
        w = F.filter(F.split(F.trim(name), r"\s+"), lambda v: v != "")
        at = F.filter(F.transform(w, lambda v, i: F.when(named(v), i)), lambda i: i.isNotNull())
        kept = F.slice(w, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1)
        return F.when((F.size(w) <= 3) & (F.size(at) > 0), F.when(F.size(F.filter(kept, named)) * 2 > F.size(kept), F.array_join(kept, " ")))

    return F.filter(F.transform(col(entities), cut), lambda e: e.isNotNull())


def volume_text(x: Column | str) -> Column:
    """A sum of money as $1.2M, $3K or $7."""
    v = F.coalesce(col(x).cast("double"), F.lit(0.0))
    return F.when(v >= 1e6, F.format_string("$%.1fM", v / 1e6)).when(v >= 1e3, F.format_string("$%.0fK", v / 1e3)).otherwise(F.format_string("$%.0f", v))


def json_list(x: Column | str) -> Column:
    """A JSON list of strings; an empty one for null or anything else."""
    return F.coalesce(F.from_json(col(x), "array<string>"), F.array().cast("array<string>"))


def low_density(density: Column | str, n_words: Column | str) -> Column:
    """Whether a text of over 100 words makes hardly any claim."""
    return (col(density) < 0.001) & (col(n_words) > 100)
