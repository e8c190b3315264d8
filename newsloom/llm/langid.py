"""Language identification with bit-sliced Bloom filters of letter n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out
from .textbytes import slices, string_buffers

RARE = 1 / 50_000  # an n-gram must make up this share of a language's: at most 50,000 a language
TYPICAL = 0.5  # and this share of what it makes up in the language that it is most frequent in
SLOT_BITS, PROBES = 20, 3
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every run of four bytes of lower-cased letters and single blanks, texts padded by a blank.

    Other ASCII characters count as blanks.  Four bytes fit an unsigned 32-bit integer, so n-grams are exact.
    """
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    folded = _FOLD[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    folded[capital] += 0x20
    text = np.full(len(data) + 2 * rows, 0x20, dtype=np.uint8)
    text[np.arange(len(data)) + 2 * row + 1] = folded
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != 0x20) | (text[:-1] != 0x20) | (owner[1:] != owner[:-1])
    text, owner = text[keep], owner[keep]
    if len(text) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    t = text.astype(np.uint32)
    gram = (t[:-3] << 24) | (t[1:-2] << 16) | (t[2:-1] << 8) | t[3:]
    inside = owner[:-3] == owner[3:]
    return owner[:-3][inside], gram[inside]


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return [((x >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


class Filters:
    """One Bloom filter a language, bit-sliced: slot s holds a mask of the languages that set it."""

    def __init__(self, languages: list[str], gram: np.ndarray, language: np.ndarray):
        self.languages = languages
        self.table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        bit = np.uint64(1) << (language % 64).astype(np.uint64)
        for slot in _slots(gram):
            np.bitwise_or.at(self.table, (slot, language // 64), bit)
        filled = np.array([(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = filled**PROBES  # chance that a filter claims an n-gram that it does not hold

    def languages_of(self, gram: np.ndarray) -> np.ndarray:
        """Mask of all languages whose filter has the n-gram."""
        a, *more = _slots(gram)
        mask = self.table[a]
        for b in more:
            mask &= self.table[b]
        return mask

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams that each language has, freed of the expected false claims."""
        n = len(offsets) - 1
        row, gram = grams(data, offsets)
        distinct, at = np.unique(gram, return_inverse=True)
        mask = self.languages_of(distinct)[at]
        total = np.bincount(row, minlength=n)
        out = np.zeros((n, len(self.languages)))
        for i in range(len(self.languages)):
            has = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(row[has.astype(bool)], minlength=n)
            out[:, i] = (hits / np.maximum(total, 1) - self.false[i]) / (1 - min(self.false[i], 0.999))
        return np.clip(out, 0.0, 1.0)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts: counted in each task, then added up in Spark."""

    def count(batches):
        names: dict[str, int] = {}
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], dtype=np.uint64)
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets):
                row, gram = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                new, count_ = np.unique((lang[i:j][row] << np.uint64(32)) | gram, return_counts=True)
                both = np.concatenate((keys, new))
                order = np.argsort(both, kind="stable")
                both, many = both[order], np.concatenate((n, count_))[order]
                first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
                keys, n = both[first], np.add.reduceat(many, first) if len(first) else many
        by = list(names)
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([by[x] for x in k >> np.uint64(32)], pa.string()), "gram": pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(n[i : i + 50_000], pa.int64())})

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_filters(docs: DataFrame) -> Filters:
    """Filters of all languages in `docs` (lang, text), from the n-gram counts of all its rows.

    A language's filter takes the n-grams that make up RARE of its own and TYPICAL of the largest share that any
    language has of them, so what strays into a language from another stays out; at most 1 / RARE come back for each.
    """
    counts = _counts(docs).checkpoint()
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(total, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= RARE * TYPICAL)
    share = share.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
    kept = share.filter((F.col("share") >= RARE) & (F.col("share") >= TYPICAL * F.col("top"))).select("lang", "gram").toArrow()
    languages = [r["lang"] for r in total.orderBy(F.col("total").desc(), "lang").collect()]
    at = {x: i for i, x in enumerate(languages)}
    return Filters(languages, kept["gram"].to_numpy(), np.array([at[x] for x in kept["lang"].to_pylist()], dtype=np.int64))


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of `docs` with lang_pred (string) and score (double, 0 to 1).

    Learns from the text and non-null language of the rows for which `train` holds; nothing but the text decides.
    score is the share of the text's n-grams that the language has, corrected for false positives; ties go to the
    language with more n-grams in training.  Null texts and texts without a letter are 'und' with score 0, as is
    everything if nothing was learned.  Columns of `docs` named lang_pred or score are replaced; repeated rows count
    each in training; an empty table gives an empty result.
    """
    learn = docs.filter(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    filters = fit_filters(learn)

    @F.arrow_udf("lang string, score double")
    def decide(text: pa.Array) -> pa.Array:
        data, offsets = string_buffers(text)
        best, score = [], []
        for i, j in slices(offsets):
            share = filters.shares(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            best.append(share.argmax(axis=1))
            score.append(share.max(axis=1))
        names = np.array(filters.languages, dtype=object)[np.concatenate(best)] if best else []
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["lang", "score"])

    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not filters.languages:
        return docs.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    made = docs.select(*others, letters.alias("__letters"), decide(F.col(text_col)).alias("__best"))
    known = F.col("__letters")
    return made.select(*others, F.when(known, F.col("__best.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("__best.score")).otherwise(0.0).alias("score"))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
