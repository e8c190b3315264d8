"""Domain scores and labels as column expressions; the reference time is always a parameter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as L
from .text import col, edged, once, text_of


def _hits(text: Column, terms) -> Column:
    """How many of the terms the text contains."""
    return once(text, lambda x: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t))))


def _any(text: Column, terms) -> Column:
    return once(text, lambda x: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t)))


def _capped(x: Column, full: float, weight: float) -> Column:
    return F.least(x / F.lit(full), F.lit(1.0)) * weight


def probability_shift(history: Column | str, as_of: Column | float) -> Column:
    """Newest minus oldest probability of the last 24 hours; 0 with fewer than two points in all or none recent."""
    h = col(history)
    since = (as_of if isinstance(as_of, Column) else F.lit(float(as_of))) - 86400.0
    recent = F.array_sort(F.filter(h, lambda p: p["timestamp"] >= since))
    return F.when((F.size(h) >= 2) & (F.size(recent) >= 1), F.element_at(recent, -1)["probability"] - F.element_at(recent, 1)["probability"]).otherwise(0.0)


def impact_score(as_of: Column, shift: Column, prefix: str = "") -> Column:
    """0 to 100 from sources, confidence, social coverage, market, content and recency of an event row."""
    c = lambda name: F.col(prefix + name)
    market = F.when(c("market_odds").isNotNull(), F.abs(c("market_odds") - 0.5) * 2 * 8 + _capped(F.coalesce(c("market_volume"), F.lit(0.0)), 5e6, 7) + _capped(F.abs(shift), 0.15, 5)).otherwise(0.0)
    size = lambda name: F.coalesce(F.size(c(name)), F.lit(0))
    headline = F.lower(text_of(c("headline")))
    content = F.concat(headline, F.lit(" "), F.lower(text_of(c("summary"))))
    age = (as_of - c("latest_timestamp")) / 3600.0
    total = (
        _capped(F.coalesce(c("source_count"), F.lit(1)), 8.0, 25) + F.coalesce(c("confidence"), F.lit(0.5)) * 10 + _capped(F.coalesce(c("social_score"), F.lit(0.0)), 30.0, 10) + market
        + _capped(size("novel_facts"), 3.0, 6) + _capped(size("disputed_claims"), 2.0, 3) + _capped(size("timeline"), 3.0, 3) + _capped(size("entities"), 2.0, 3)
        + _capped(_hits(content, L.IMPACT_KEYWORDS), 3.0, 15) - F.when(_any(headline, L.DIGEST_TITLES), 20.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1.0 - age / 48.0) * 15
    )
    return F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(100.0))), 1)


def impact_label(score: Column | str, shift: Column | float, sources: Column | str) -> Column:
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    wide = col(sources) >= 3
    return F.when(wide & ((F.abs(shift) >= 0.10) | (col(score) >= 60)), "high").when(col(score) >= 32, "medium").otherwise("low")


def _best_label(entities: Column | str, text: Column | str, table: dict) -> Column:
    """Label of most keyword hits, the earlier on a tie; '' without a hit."""
    labels, terms = ["", *table], list(table.values())

    @F.arrow_udf(T.StringType())
    def best(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            hits = [0, *(sum(t in x for t in some) for some in terms)] if x else [0]
            out.append(labels[hits.index(max(hits))])
        return pa.array(out, pa.string())

    return best(F.concat(F.lower(F.array_join(col(entities), " ")), F.lit(" "), F.lower(text_of(text))))


def topic(entities: Column | str, text: Column | str) -> Column:
    return _best_label(entities, text, L.TOPICS)


def geography(entities: Column | str, text: Column | str) -> Column:
    return _best_label(entities, text, L.GEOGRAPHIES)


def ai_relevant(headline: Column | str, summary: Column | str) -> Column:
    """Whether a story is about AI: terms, companies or products in the headline, else the word with context, else two signals."""
    h = F.lower(text_of(headline))
    both = F.lower(F.concat(text_of(headline), F.lit(" "), text_of(summary)))
    word = h.rlike(edged(r"\bai\b")) & (F.length(h) < 200) & _any(both, L.AI_CONTEXT)
    signals = _hits(both, L.AI_STRONG)
    return _any(h, L.AI_STRONG) | _any(h, L.AI_COMPANIES) | _any(h, L.AI_PRODUCTS) | word | (signals >= 2) | ((signals >= 1) & _any(both, L.AI_COMPANIES))


def ai_keyword(*texts: Column | str) -> Column:
    """Whether any text has a keyword of the AI feed, in any case."""
    lower = [t.lower() for t in L.AI_KEYWORDS]
    out = F.lit(False)
    for t in texts:
        out = out | _any(F.lower(text_of(t)), lower)
    return out


def hype(headline: Column | str) -> Column:
    return _any(F.lower(text_of(headline)), L.AI_HYPE)


def divergence(impact: Column | str, score: Column | str, odds: Column | str) -> Column:
    """Why market and news disagree; '' if they do not."""
    i, o = col(impact), col(odds)
    return (
        F.when((i == "high") & (o < 0.30), "High news impact but low market probability — market may be discounting the event")
        .when((i == "low") & (o > 0.70), "Low news impact but high market probability — market sees higher significance")
        .when((col(score) > 60) & (o < 0.25), "High computed impact score but low market odds")
        .otherwise("")
    )


def social_score(coverage: Column | str, articles: Column | str) -> Column:
    """Log-scaled coverage with a bonus for each social article, 0 to 100."""
    total = F.least(F.least(F.log10(col(coverage) + 1.0) * 20, F.lit(100.0)) + col(articles) * 5, F.lit(100.0))
    return F.when(col(coverage) > 0, F.round(total, 1)).otherwise(0.0)


def clean_slug(slug: Column | str) -> Column:
    """Slug without a tail of eight or more numbers."""
    s = col(slug)
    return F.when(s.rlike(r"^\d{3,}(-\d{3,}){7,}$"), "").otherwise(F.regexp_replace(s, r"(?:-\d{3,}){8,}$", ""))


def valid_slug(slug: Column | str) -> Column:
    s = F.trim(text_of(slug))
    return s.rlike(r"^[a-zA-Z0-9\-_]{2,120}$") & (F.size(F.regexp_extract_all(s, F.lit(r"-(\d{3,})"), F.lit(1))) < 5)


def market_url(slug: Column | str, source: Column | str) -> Column:
    s = clean_slug(slug)
    host = F.when(col(source) == "callsheet", "https://callsheet.com/event/").when(col(source) == "kalshi", "https://kalshi.com/markets/").otherwise("https://polymarket.com/event/")
    return F.when(valid_slug(s), F.concat(host, s)).otherwise("")


def expired(end_date: Column | str, as_of: Column | float) -> Column:
    """Whether an ISO end date with a zone lies before the reference time; junk and dates without a zone do not."""
    s = text_of(end_date)
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))
    now = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    return F.coalesce(F.unix_micros(zoned) / 1e6 < now, F.lit(False))


def unusual_reason(volume: Column | str, day: Column | str, probability: Column | str, previous_day: Column | str | None = None) -> Column:
    """What is unusual about a market, joined by '; '; '' if nothing is."""
    v, d, p = col(volume), col(day), col(probability)
    reasons = [
        F.when(v > 5e6, F.format_string("High total volume: $%.1fM", v / 1e6)),
        F.when(d > 5e5, F.format_string("High 24h volume: $%.1fM", d / 1e6)),
        F.when(((p > 0.95) | (p < 0.05)) & (v > 1e6), F.format_string("Extreme odds (%.0f%%) with significant volume", p * 100)),
    ]
    if previous_day is not None:
        b = F.coalesce(col(previous_day), F.lit(0.0))
        reasons.append(F.when((b > 0) & (d > b * 2) & (d > 1e5), F.format_string("Volume spike: %.1fx increase in 24h volume", d / b)))
    return F.concat_ws("; ", *reasons)


def market_category(question: Column | str) -> Column:
    """Rough subject of a market's question, by the first pattern that it matches."""
    q = F.lower(text_of(question))
    out = F.when(F.lit(False), "")
    for label, pattern in L.MARKET_CATEGORIES:
        out = out.when(q.rlike(pattern), label)
    return out.otherwise("Culture")
