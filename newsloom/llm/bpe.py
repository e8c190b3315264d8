"""Byte-level BPE encoding and decoding by rounds of merges over padded matrices."""

from __future__ import annotations

import base64
import math
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import boundaries
from .textbytes import _byte_values, _powers, _sums, mix, slices, string_buffers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.uint32(0xFFFFFFFF)
CELLS = 1 << 17  # cells of one padded matrix
LONG = 2048  # bytes above which a pre-token is a row of its own, whose equal pairs merge together
KEPT = 150_000  # pre-tokens whose ids a worker keeps between batches


def read_vocabulary(path: str) -> bytes:
    """The rank file as it is; a file of fixed size, which travels with the function to the executors."""
    return Path(path).read_bytes()


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]."""
    power, inverse = _powers(0, len(data) + 1)
    sums = _sums(_byte_values(False)[data] * power[: len(data)])
    return mix((sums[end] - sums[start]) * inverse[start])


def gather(flat: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array one after another, and their boundaries."""
    length = edges[rows + 1] - edges[rows]
    upto = np.concatenate(([0], np.cumsum(length)))
    return flat[np.repeat(edges[rows] - upto[:-1], length) + np.arange(upto[-1])], upto


class Vocabulary:
    """Ranks by token, and by pair of tokens in an open-addressing hash table."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = {v: k for k, v in ranks.items()}
        ids = np.array(sorted(self.tokens), dtype=np.int64)
        self.edges = np.concatenate(([0], np.cumsum([len(self.tokens.get(i, b"")) for i in range(ids[-1] + 1)])))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(ids[-1] + 1)), np.uint8)
        whole = spans_hash(self.bytes, self.edges[ids], self.edges[ids + 1])
        order = np.argsort(whole)
        self.whole, self.whole_id = whole[order], ids[order].astype(np.uint32)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.uint32)
        a, b, c = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    c.append(rank)
        self._build(self._key(np.array(a, np.uint64), np.array(b, np.uint64)), np.array(c, np.uint32))

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, math.ceil(math.log2(max(1, len(keys)))) + 2)
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**64 - 1, dtype=np.uint64), np.full(size, NONE, dtype=np.uint32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            won = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the pair is no token."""
        key = self._key(a.ravel(), b.ravel())
        slot, out, open_ = self._slot(key), np.full(len(key), NONE, dtype=np.uint32), None
        for _ in range(self.probes + 1):
            k, s = (key, slot) if open_ is None else (key[open_], slot[open_])
            there = self.keys[s]
            hit = there == k
            rows = np.flatnonzero(hit) if open_ is None else open_[hit]
            out[rows] = self.values[s[hit]]
            miss = ~hit & (there != np.uint64(2**64 - 1))
            open_ = np.flatnonzero(miss) if open_ is None else open_[miss]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return out.reshape(a.shape)

    def merge(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the rows of a padded matrix of byte ids: (ids, length) after the last merge.

        In each round every row merges its leftmost pair of least rank; finished rows leave the matrix.
        """
        rows, width = ids.shape
        out, count, live = ids.copy(), length.copy(), np.arange(rows)
        pair = self.rank(ids[:, :-1], ids[:, 1:])
        pair[np.arange(1, width)[None, :] >= length[:, None]] = NONE
        column = np.arange(width)
        while width > 1:
            best = pair.argmin(axis=1)
            new = pair[np.arange(len(live)), best]
            more = new != NONE
            if not more.all():
                done = live[~more]
                out[done, :width] = ids[~more]
                count[done] = length[~more]
                ids, pair, length, live, best, new = ids[more], pair[more], length[more], live[more], best[more], new[more]
            if not len(live):
                return out, count
            at = np.arange(len(live))
            ids[at, best] = new
            width -= 1
            pick = column[None, :width] + (column[None, :width] > best[:, None])
            ids = np.take_along_axis(ids, pick, axis=1)
            length = length - 1
            if width == 1:
                break
            pair = np.take_along_axis(pair, pick[:, : width - 1] if width > 1 else pick, axis=1)
            for shift in (-1, 0):
                col = best + shift
                ok = (col >= 0) & (col + 1 < length)
                row, c = at[ok], col[ok]
                pair[row, c] = self.rank(ids[row, c], ids[row, c + 1])
            tail = best + 1 >= length
            pair[at[tail & (best < width - 1)], best[tail & (best < width - 1)]] = NONE
        out[live, :width] = ids
        count[live] = length
        return out, count

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Encode one long row of byte ids: a round merges all places of the least rank, from the left.

        That is what merging the leftmost one again and again does, up to the first place whose merge makes a pair
        of that rank or a lower one with a neighbour; there the round ends.  Ranks of pairs are kept and only those next to
        a merge are looked up again, so the cost is that of one pass over the row for each distinct rank.
        """
        pair = self.rank(ids[:-1], ids[1:])
        while len(pair) and (least := pair.min()) != NONE:
            at = np.flatnonzero(pair == least)
            begin = np.concatenate(([True], np.diff(at) != 1))
            at = at[(at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0]  # places overlap in a run: every second one
            ends_here = np.concatenate(([False], at[1:] == at[:-1] + 2))
            left = np.where(ends_here, least, ids[np.maximum(at - 1, 0)])
            right = ids[np.minimum(at + 2, len(ids) - 1)]
            merged = np.full(len(at), least, dtype=ids.dtype)
            made = np.minimum(np.where(at > 0, self.rank(left, merged), NONE), np.where(at + 2 < len(ids), self.rank(merged, right), NONE))
            early = np.flatnonzero(made <= least)
            at = at[: early[0] + 1] if len(early) else at
            ids[at] = least
            ids, pair = np.delete(ids, at + 1), np.delete(pair, at)
            new = at - np.arange(len(at))
            for i in (new[new > 0] - 1, new[new < len(pair)]):
                pair[i] = self.rank(ids[i], ids[i + 1])
        return ids

    def encode_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, boundaries) of byte strings data[start:end]; one that is a token itself is that token."""
        n = len(start)
        length = end - start
        at = np.searchsorted(self.whole, hashes)
        at[at == len(self.whole)] = 0
        whole = self.whole[at] == hashes
        size = np.ones(n, dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(~whole & (length > LONG)):
            ids = self.merge_long(self.byte_id[data[start[i] : end[i]]])
            size[i] = len(ids)
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        todo = np.flatnonzero(~whole & (length <= LONG))
        bucket = np.ceil(np.log2(np.maximum(length[todo], 2))).astype(np.int64)
        for b in np.unique(bucket):
            members, width = todo[bucket == b], 1 << int(b)
            for i in range(0, len(members), max(1, CELLS // width)):
                rows = members[i : i + max(1, CELLS // width)]
                wide = int(length[rows].max())
                column = np.arange(wide)
                inside = column[None, :] < length[rows][:, None]
                ids = np.where(inside, self.byte_id[data[np.minimum(start[rows][:, None] + column[None, :], len(data) - 1)]], np.uint32(0))
                ids, count = self.merge(ids, length[rows].astype(np.int64))
                size[rows] = count
                parts.append((rows, ids[np.arange(wide)[None, :] < count[:, None]], count))
        edges = np.concatenate(([0], np.cumsum(size)))
        flat = np.empty(edges[-1], dtype=np.uint32)
        flat[edges[:-1][whole]] = self.whole_id[at[whole]]
        for rows, ids, count in parts:
            upto = np.cumsum(count) - count
            flat[np.repeat(edges[rows] - upto, count) + np.arange(len(ids))] = ids
        return flat, edges


class Encoder:
    """Ids of whole texts; pre-tokens seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.edges, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.known) > KEPT:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if not new.any():
            return
        flat, edges = self.vocabulary.encode_spans(data, start[new], end[new], hashes[new])
        self.row = np.insert(self.row, at[new], np.arange(new.sum()) + len(self.edges) - 1)
        self.known = np.insert(self.known, at[new], hashes[new])
        self.edges = np.concatenate((self.edges, edges[1:] + self.edges[-1]))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, boundaries by text)."""
        start, first = boundaries(data, offsets)
        end = np.append(start[1:], len(data)).astype(np.int64)
        hashes, index, inverse = np.unique(spans_hash(data, start, end), return_index=True, return_inverse=True)
        self._learn(data, start[index], end[index], hashes)
        rows = self.row[np.searchsorted(self.known, hashes)] if len(hashes) else np.zeros(0, np.int64)
        ids, upto = gather(self.flat, self.edges, rows[inverse])
        return ids, upto[first]


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(Vocabulary(raw))


def _packed_ids(column: pa.Array, raw: bytes) -> pa.Array:
    encoder, (data, offsets) = _encoder(raw), string_buffers(column)
    out, ends, done = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets):
        got, upto = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append(got)
        ends.append(upto[1:] + done)
        done += len(got)
    flat = np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((np.concatenate(ends) * 4).astype(np.int32)), pa.py_buffer(flat)])


def _decoded(column: pa.Array, raw: bytes) -> pa.Array:
    vocabulary, (data, offsets) = _encoder(raw).vocabulary, string_buffers(column)
    out, ends, done = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets, 4 << 20):
        got, upto = gather(vocabulary.bytes, vocabulary.edges, np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u4").astype(np.int64))
        out.append(got)
        ends.append(upto[(offsets[i + 1 : j + 1] - offsets[i]) // 4] + done)
        done += len(got)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(np.concatenate(ends).astype(np.int32)), pa.py_buffer(flat)])


def encode(text: Column, raw: bytes) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers (binary); null gives no ids."""
    return F.arrow_udf(lambda column: _packed_ids(column, raw), "binary")(text)


def decode(ids: Column, raw: bytes) -> Column:
    """The bytes that packed ids stand for; null gives none."""
    return F.arrow_udf(lambda column: _decoded(column, raw), "binary")(ids)


def bpe_round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The columns of `docs` with ids (binary, little-endian unsigned 32-bit) and decoded (binary).

    Every match of the public pre-token pattern in a whole text is encoded separately by the ranks in `path`, without
    special tokens; a null or empty text has no ids and decodes to nothing; repeated rows are each encoded.  No row moves between tasks, so skew of
    any key does not matter; a column of `docs` named ids or decoded is replaced; an empty table gives an empty result.
    """
    raw = read_vocabulary(path)

    @F.arrow_udf("ids binary, decoded binary")
    def both(column: pa.Array) -> pa.Array:
        ids = _packed_ids(column, raw)
        return pa.StructArray.from_arrays([ids, _decoded(ids, raw)], ["ids", "decoded"])

    others = [c for c in docs.columns if c not in ("ids", "decoded")]
    made = docs.select(*others, both(F.col(text_col)).alias("__both"))
    return made.select(*others, "__both.ids", "__both.decoded")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: token counts and digests of ids and decoded bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
