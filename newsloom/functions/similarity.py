"""SimHash, set and vector similarity as column expressions and aggregates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, words


WORDS_AT_ONCE = 1 << 18
LANE_MOST = 255  # words whose bits add up in a byte


def token_hash(token: Column | str) -> Column:
    """64 bits of md5, as the BIGINT of the same bit pattern."""
    return F.conv(F.substring(F.md5(col(token).cast("binary")), 1, 16), 16, -10).cast("long")


def _set_bits(lanes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in consecutive runs of words; `lanes` holds a byte for each bit of a word, eight to a number.

    Eight bits are added at once: up to 255 words no byte runs over, and longer runs are added up by such parts.
    """
    parts = -(-length // LANE_MOST)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(length) - length, parts) + LANE_MOST * within
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
    return np.add.reduceat(sums, first, axis=0, dtype=np.int32)


@F.arrow_udf(T.LongType())
def _majority_of_words(words_: pa.Array) -> pa.Array:
    """Bits that most words of each row have set; each distinct word of a batch is hashed once."""
    length = np.asarray(words_.value_lengths().fill_null(0))
    edge = np.concatenate(([0], np.cumsum(length)))
    coded = words_.flatten().dictionary_encode()
    hashes = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in coded.dictionary.to_pylist()], dtype=">u8")
    lanes, at = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64), coded.indices.to_numpy()
    out = np.zeros(len(length), np.int64)
    rows = np.flatnonzero(length)
    while len(rows):  # a bounded number of words at once, one row at least
        n = max(1, int(np.searchsorted(edge[rows + 1], edge[rows[0]] + WORDS_AT_ONCE, side="right")))
        some, rows = rows[:n], rows[n:]
        ones = _set_bits(lanes[at[edge[some[0]] : edge[some[-1] + 1]]], length[some].astype(np.int64))
        out[some] = np.packbits(ones * 2 > length[some][:, None], axis=1).view(">i8").ravel()
    return pa.array(out)


def simhash_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, simhash): bit i is set if more word occurrences have it set than not; 0 without words.

    One row in, one row out: nothing is shuffled.  Repeated rows and rows of null id are each answered.
    """
    return docs.select(F.col(id_col), simhash_text(text_col).alias("simhash"))


def simhash_text(text: Column | str) -> Column:
    """The same fingerprint of whole texts and whole tables, in Arrow batches; not for use inside lambdas."""
    return _majority_of_words(words(text))


def simhash_column(text: Column | str) -> Column:
    """The same fingerprint of a short text such as a headline, in one expression."""
    # the array of hashes is bound once as a lambda's variable, not computed again for each bit
    return F.get(F.transform(F.array(F.transform(words(text), token_hash)), _majority), F.lit(0))


def _majority(hashes: Column) -> Column:
    def bit(i: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(1)) == 1))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    each = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def simhash_similarity(a: Column | str, b: Column | str) -> Column:
    return 1.0 - hamming(a, b) / 64.0


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(0.0)


def entity_jaccard(a: Column | str, b: Column | str) -> Column:
    lower = lambda x: F.transform(col(x), F.lower)
    return jaccard(lower(a), lower(b))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for vectors of different length, empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(col(a)) == F.size(col(b))) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def dedup_score(title: Column, content: Column, entities: Column, vectors: Column | None = None) -> Column:
    """Weighted similarity of two articles; with vectors where both have one."""
    plain = title * 0.4 + content * 0.3 + entities * 0.3
    if vectors is None:
        return plain
    return F.when(vectors.isNotNull(), vectors * 0.35 + entities * 0.3 + content * 0.2 + title * 0.15).otherwise(plain)


DUPLICATE = 0.70  # a score above this is a duplicate
