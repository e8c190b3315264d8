"""Which texts contain which patterns, by an inverted index of short character runs instead of a nested loop."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 3


def without_case(x: Column | str) -> Column:
    """A-Z in lower case; other letters keep theirs."""
    return F.translate(x if isinstance(x, Column) else F.col(x), string.ascii_uppercase, string.ascii_lowercase)


def _runs(text: Column, n: Column | int) -> Column:
    """Distinct runs of n characters; none if the text is shorter."""
    size = n if isinstance(n, Column) else F.lit(n)
    many = F.length(text) - size + 1
    return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text): all pairs in which the text contains the pattern, each once; empty and null ones take no part.

    A pattern meets the texts that have the rarest of its runs of three characters (of its own length, if that is shorter), and is
    compared with these alone; a pattern with a run that no text has is out.  Only runs that some pattern has are indexed.
    """
    p = patterns.select("pattern").filter("pattern <> ''").distinct()
    t = texts.select("text").filter("text <> ''").distinct()
    of_pattern = p.select("pattern", F.explode(_runs(F.col("pattern"), F.least(F.length("pattern"), F.lit(RUN)))).alias("run"))
    asked = of_pattern.select("run").distinct()
    each = F.concat(*[_runs(F.col("text"), n) for n in range(1, RUN + 1)])
    index = t.select("text", F.explode(each).alias("run")).join(asked, "run", "left_semi")
    held = index.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_pattern.join(held, "run", "left").groupBy("pattern").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.bool_and(F.col("n").isNotNull()).alias("held"))
    met = rarest.filter("held").select("pattern", "run").join(index, "run")
    return met.filter(F.contains("text", F.col("pattern"))).select("pattern", "text")
