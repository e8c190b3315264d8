"""Vectorised word handling on the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D inside one text; as those bytes never
occur inside a multi-byte UTF-8 sequence, bytes and code points give the same words.  Hashes are
polynomial (Rabin-Karp) modulo 2**64 over random byte values, followed by a bit mixer, so a word or a
window of words costs a few array operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # text handled at once; a longer text is handled alone
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2**64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(_SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept between calls and grown when needed."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _POWERS[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most `limit` bytes together (one row may hold more)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a run of texts: start, end (byte positions), row, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        n = len(data)
        space = IS_SPACE[data]
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        if n:
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            edges = offsets[:-1]
            before[edges[edges < n]] = True
            after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.space = space
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        #: words of row i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets, side="left")

    @cached_property
    def row(self) -> np.ndarray:
        return np.searchsorted(self.offsets, self.start, side="right") - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        power, inverse = _powers(0, max(n, 1))
        sums = _sums(_byte_values(lower)[self.data] * power[:n])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start]) if n else np.zeros(0, np.uint64)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, inverse = _powers(1, len(hashes))
        sums = _sums(hashes * power)
        at = np.flatnonzero(self.row[: m] == self.row[k - 1 :])
        return at, mix((sums[at + k] - sums[at]) * inverse[at])


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's kept words joined by one space."""
    n = len(words.data)
    out = words.data.copy()
    mask = np.zeros(n + 1, dtype=np.int8)
    mask[words.start[keep]] += 1
    mask[words.end[keep]] -= 1
    mask = np.cumsum(mask[:n], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    if len(kept):
        row = words.row[kept]
        later = kept[1:][row[1:] == row[:-1]]
        gap = words.start[later] - 1
        out[gap] = 0x20
        mask[gap] = True
    ends = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(mask, out=ends[1:])
    return out[mask], ends[words.offsets]


def unique_sorted(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
