"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import each_slice
from .textbytes import Words, string_buffers

ROWS_PER_BUCKET = 4096
OUTPUT = ("size", "source_size", "target", "taken", "words", "positions")


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of each text; null has none."""
    parts = [np.diff(w.first) for _, _, w in each_slice(text)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())


@F.arrow_udf(T.StringType())
def first_words(text: pa.Array, n: pa.Array) -> pa.Array:
    """The text up to the end of its n-th word; the whole text if it has no more words than that."""
    data, offsets = string_buffers(text)
    out = []
    for i, limit in enumerate(n.to_pylist()):
        raw = data[offsets[i] : offsets[i + 1]]
        if not len(raw):
            out.append("")
            continue
        words = Words(raw, np.array([0, len(raw)]))
        out.append(bytes(raw if limit is None or limit >= len(words.end) else raw[: words.end[limit - 1] if limit > 0 else 0]).decode("utf-8"))
    return pa.array(out, pa.string())


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """One row a source: rank (code-point order, null last), source_size, weight, target.

    Targets are in proportion to the weights and add up to `share` of all words; none is above `repeats` times its
    source's size, and what a source cannot take goes to the others by weight.  With sources ordered by the level
    at which they fill up, the common level is the largest that any cut of the order gives.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(repeats))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - (F.sum("most").over(fill) - F.col("most"))) / (
        F.sum("weight").over(everything) - (F.sum("weight").over(fill) - F.col("weight"))
    )
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).select("source", "rank", "source_size", "weight", "target")


def curriculum_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, ramp: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), ordered: bool = True,
) -> DataFrame:
    """Take words of each source up to its target and place every copy of a document on the training axis 0 to 1.

    A source's weight runs over training time t as weight * (1 + a * (2t - 1)), a being +ramp and -ramp in turn, so
    its demand up to t is the integral target * (t + a * (t * t - t)).  The source's documents stand in the order of
    md5(id), up to `repeats` times over; a copy that begins after x words of its source gets the time at which the
    demand reaches x.  A copy takes all its words, but the one at which the target is reached takes what is left.

    Returns the columns of `docs` named by `carry`, id, size, source_size (long), target (double), taken (long), words (array<long>: of
    each copy) and positions (array<double>, null where nothing is taken), ordered by the first position over range partitions unless the caller orders the copies (`ordered` false).
    A null source is a source; null and empty texts have size 0 and take nothing.  Ties of md5 go by id, size and text; rows of
    null id stand in the order of their texts' hashes.  Repeated rows are further documents, each with its own plan, told apart by nothing.
    Other columns are not read; a carried column that has the name of another output is left out; an empty table gives an empty result.
    """
    others = [c for c in dict.fromkeys(carry) if c not in (id_col, *OUTPUT)]
    row = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), *(F.col(c).alias(f"__carry{i}") for i, c in enumerate(others))]
    sizes = docs.select(*row[:4]).checkpoint()
    digits = max(1, math.ceil(math.log(max(sizes.count() / ROWS_PER_BUCKET, 1), 16)))
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("tie").cast("string"))).cast("binary"))
    targets = source_targets(sizes, weights, share, repeats)

    def in_buckets(rows: DataFrame) -> DataFrame:
        known = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
        return known.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))

    # the carried columns, whole texts perhaps, are read again instead of being kept
    placed = in_buckets(docs.select(*row) if others else sizes)
    sums = in_buckets(sizes).groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = sums.select("rank", "bucket", (F.sum("in_bucket").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    start = placed.withColumn("inside", inside).join(before, ["rank", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    whole = F.floor("target")
    begin = [F.col("start") + F.lit(p) * F.col("source_size") for p in range(repeats)]
    words = F.array(*[F.greatest(F.lit(0), F.least(F.col("size"), whole - x)) for x in begin])
    a = F.when(F.col("rank") % 2 == 1, F.lit(float(ramp))).otherwise(F.lit(-float(ramp)))
    time = [((a - 1.0) + F.sqrt((1.0 - a) * (1.0 - a) + 4.0 * a * (x / F.col("target")))) / (2.0 * a) for x in begin]
    timed = start.withColumn("words", words)
    positions = F.array(*[F.when(F.col("words")[p] > 0, t) for p, t in enumerate(time)])
    out = timed.withColumn("positions", positions).withColumn("taken", F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))
    out = out.select(*(F.col(f"__carry{i}").alias(c) for i, c in enumerate(others)), F.col("id").alias(id_col), "size", "source_size", "target", "taken", "words", "positions")
    return out.orderBy(F.col("positions")[0].asc_nulls_last(), id_col) if ordered else out


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: words taken of every document."""
    out = curriculum_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round(F.col("positions")[0], 9).alias("first_position"))


OP5_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS most FROM per),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER f - most)) / (sum(weight) OVER () - (sum(weight) OVER f - weight)) AS l
           FROM weighed WINDOW f AS (ORDER BY most::DOUBLE / weight, rank)),
targets AS (SELECT source, rank, source_size, least(most::DOUBLE, max(l) OVER () * weight) AS target FROM levels),
placed AS (SELECT doc_id, size, rank, source_size, target,
             CAST(sum(size) OVER (PARTITION BY rank ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
           FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
taken AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS w0, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS w1,
             CASE WHEN rank % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS a FROM placed)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
       CASE WHEN w0 > 0 THEN round(((a - 1) + sqrt((1 - a) * (1 - a) + 4 * a * (start / target))) / (2 * a) + 0.0, 9) END AS first_position
FROM taken
"""
