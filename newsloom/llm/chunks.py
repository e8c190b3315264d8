"""Counting hashes over all documents without a row for each hash.

Documents are dealt to chunks of a few MB of text.  Each chunk sends its distinct 64-bit hashes once, cut
into hash ranges ("buckets"), as packed binary rows; each bucket counts what all chunks sent and answers
every chunk with what it asked for.  A hash that is hot in the corpus therefore crosses the network at
most once a chunk, and neither a chunk nor a bucket grows with the corpus: their number does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import Words, slices, string_buffers

CHUNK = "__chunk"
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of text in the whole table: one scan of that column, one number back."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def chunk_key(id_col: str, text_col: str, total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """Chunk of a document: even, and the same at every evaluation whatever the order of rows."""
    n = max(1, math.ceil(total_bytes / chunk_bytes))
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n))


def copy_numbers(hashes: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How often each hash came before in this task; `seen` has the counts so far."""
    out = np.zeros(len(hashes), np.int64)
    for i, h in enumerate(hashes.tolist()):
        out[i] = n = seen.get(h, 0)
        seen[h] = n + 1
    return out


def buckets_for(total_bytes: int, bytes_each: int, bytes_per_item: float = 6.0) -> int:
    """Buckets that hold about BUCKET_BYTES each if every `bytes_per_item` bytes of text send one item."""
    return max(1, math.ceil(total_bytes / bytes_per_item * bytes_each / BUCKET_BYTES))


def each_slice(text: pa.ChunkedArray):
    """(first row, last row, Words) over a text column, a bounded number of bytes at a time."""
    data, offsets = string_buffers(text)
    for i, j in slices(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def cuts(sorted_hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, boundaries) of the non-empty hash ranges in a sorted array."""
    bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return bucket[edge].astype(np.int32), np.append(edge, len(bucket))


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[edges[i]:edges[i + 1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows one after another, row boundaries)."""
    data, offsets = string_buffers(column)
    return np.frombuffer(data.tobytes(), dtype), offsets // np.dtype(dtype).itemsize


def shared_hashes(chunks: DataFrame, hashes_of: Callable[[pa.Table], np.ndarray], n_buckets: int, exact: bool = True) -> DataFrame:
    """(chunk, bucket, bits, level): which of the hashes that a chunk sent to a bucket other chunks sent too.

    `hashes_of` gives a chunk's distinct hashes, sorted.  bits has one bit for each hash of that chunk and bucket in
    this order; level has a byte for each bit that is set, growing with the number of chunks.  What repeats inside
    one chunk only is not reported: the chunk sees that itself.  If not `exact`, hashes are compared by bucket and 32
    bits, which halves what is sent and may report some that are not shared.
    """
    kind = np.uint64 if exact else np.uint32

    def send(table: pa.Table) -> pa.Table:
        h = hashes_of(table)
        bucket, edge = cuts(h, n_buckets)
        chunk = table[CHUNK][0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(bucket), pa.int64()), "bucket": pa.array(bucket, pa.int32()), "hashes": packed(h.astype(kind), edge)})

    def answer(table: pa.Table) -> pa.Table:
        h, edge = unpacked(table["hashes"], kind)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        runs = np.diff(np.append(first, len(s)))
        level = np.empty(len(h), dtype=np.uint8)
        level[order] = np.repeat(np.minimum(4 * np.log2(runs), 255).astype(np.uint8), runs)
        bits, levels, rows = [], [], []
        for i in range(len(edge) - 1):
            part = level[edge[i] : edge[i + 1]]
            if part.any():
                rows.append(i)
                bits.append(np.packbits(part > 0).tobytes())
                levels.append(part[part > 0].tobytes())
        return pa.table({"chunk": table["chunk"].take(pa.array(rows, pa.int64())), "bucket": table["bucket"].take(pa.array(rows, pa.int64())), "bits": pa.array(bits, pa.binary()), "level": pa.array(levels, pa.binary())})

    sent = chunks.groupBy(CHUNK).applyInArrow(send, "chunk long, bucket int, hashes binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, bits binary, level binary")


def levels_of(answers: pa.Table, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Level of each of a chunk's distinct, sorted hashes; 0 where no other chunk has it."""
    bucket, edge = cuts(hashes, n_buckets)
    out = np.zeros(len(hashes), dtype=np.uint8)
    place = np.searchsorted(bucket, answers["bucket"].to_numpy())
    for at, bits, level in zip(place, answers["bits"].to_pylist(), answers["level"].to_pylist(), strict=True):
        part = out[edge[at] : edge[at + 1]]
        part[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)] = np.frombuffer(level, np.uint8)
    return out


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values the sorted set holds."""
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values
