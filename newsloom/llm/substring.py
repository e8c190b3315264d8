"""Substring dedup: cut every passage of `window` words whose word sequence also starts elsewhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNK, buckets_for, chunk_key, each_slice, levels_of, member, shared_hashes, text_bytes
from .textbytes import joined, unique_sorted

OUTPUT = ("n_words", "n_removed", "kept_text", "removed")


def _window_hashes(text: pa.ChunkedArray, k: int) -> np.ndarray:
    parts = [w.windows(w.hashes(), k)[1] for _, _, w in each_slice(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop each word that a repeated window covers, in every place where the window stands.

    Every window of `window` consecutive words of one document is hashed (Rabin-Karp) and counted over the
    whole corpus; overlapping repeated windows merge into maximal intervals.  Words are runs of bytes other
    than white space (0x20, 0x09-0x0D), compared unchanged, and judged on the input alone.

    Returns the columns of `docs` with n_words, n_removed (long), kept_text (kept words joined by one space)
    and removed (array of struct(start, stop): word intervals, stop excluded).  Null and empty texts have no
    words: 0, 0, '' and an empty array.  Repeated rows count as further documents.  A column of `docs` that
    has the name of an output column is replaced.  An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in OUTPUT or c in (id_col, text_col)]
    # columns go by number inside, so a name of the caller's cannot clash with one of ours
    docs = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    carried, id_col, text_col = docs.columns, f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    total = text_bytes(docs, text_col)
    chunks = docs.select(*carried, chunk_key(id_col, text_col, total).alias(CHUNK))

    def hashes_of(table: pa.Table) -> np.ndarray:
        return unique_sorted(_window_hashes(table[text_col], window))

    n_buckets = buckets_for(total, 8)
    found = shared_hashes(chunks, hashes_of, n_buckets)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        text = left[text_col]
        distinct, count = np.unique(_window_hashes(text, window), return_counts=True)
        repeated = distinct[(count > 1) | (levels_of(right, distinct, n_buckets) > 0)]
        n_words, n_removed, pieces, ends, starts, stops, spans, done = [], [], [], [np.zeros(1, np.int64)], [], [], [np.zeros(1, np.int64)], 0
        n_spans = 0
        for _, _, w in each_slice(text):
            at, hashes = w.windows(w.hashes(), window)
            at = at[member(hashes, repeated)]
            cover = np.zeros(len(w.start) + 1, dtype=np.int64)
            cover[at] += 1
            cover[at + window] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
            after = np.concatenate((gone[1:], [False])) if len(gone) else gone
            first_of_row = np.zeros(len(gone), dtype=bool)
            first_of_row[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
            last_of_row = np.zeros(len(gone), dtype=bool)
            last_of_row[w.first[1:][w.first[:-1] < w.first[1:]] - 1] = True
            begin = np.flatnonzero(gone & (~before | first_of_row))
            finish = np.flatnonzero(gone & (~after | last_of_row)) + 1
            origin = w.first[w.row[begin]]
            starts.append(begin - origin)
            stops.append(finish - origin)
            spans.append(n_spans + np.searchsorted(begin, w.first[1:], side="left"))
            n_spans += len(begin)
            upto = np.concatenate(([0], np.cumsum(gone)))[w.first]
            n_words.append(np.diff(w.first))
            n_removed.append(np.diff(upto))
            out, offsets = joined(w, ~gone)
            pieces.append(out)
            ends.append(offsets[1:] + done)
            done += len(out)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        kept = pa.Array.from_buffers(pa.string(), left.num_rows, [None, pa.py_buffer(join(ends, np.int32)), pa.py_buffer(join(pieces, np.uint8))])
        interval = pa.StructArray.from_arrays([pa.array(join(starts, np.int32)), pa.array(join(stops, np.int32))], ["start", "stop"])
        made = {"n_words": pa.array(join(n_words, np.int64)), "n_removed": pa.array(join(n_removed, np.int64)), "kept_text": kept, "removed": pa.ListArray.from_arrays(pa.array(join(spans, np.int32)), interval)}
        return pa.table([left[c] for c in carried] + list(made.values()), carried + list(made))

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(span))]
    schema = T.StructType([docs.schema[c] for c in carried] + made)
    out = chunks.groupBy(CHUNK).cogroup(found.groupBy("chunk")).applyInArrow(cut, schema)
    return out.select(*(F.col(c).alias(name) for c, name in zip(carried, names, strict=True)), *OUTPUT)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: digests of each document's kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM rep, unnest(range(i, i + 35)) t(p)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
