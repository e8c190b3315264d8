"""LM scoring with a probabilistic suffix tree of words."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import copy_numbers, cuts, text_bytes
from .quality import held_out
from .textbytes import Words, mix, slices, string_buffers

END = np.uint64(0x9AE16A3B2F90404F)  # stands for the end of a text
DEPTH = 3  # longest context in words
LEAST = 2  # occurrences that a context needs to be a candidate: one alone, left out of its own prediction, gains nothing
GAIN = 3.0  # nats that a context must gain over its suffix, each occurrence predicted without itself
SMOOTHING = (5.0, 50.0, 500.0, 5000.0)  # weights of the shorter context's distribution, in occurrences; each context takes its best
CHUNK_BYTES = 8 << 20  # text in a chunk: the larger, the fewer n-grams are sent twice
PACK_BYTES = 32 << 20  # text that a task holds while it packs
BUCKET_TOKENS, BUCKET_ENTRIES = 38_000_000, 9_000_000  # bytes of text whose words, and whose n-grams of one length, fill a bucket
HOT = 500_000  # occurrences above which the next words of a context are dealt to several buckets
NATS = 256  # steps in a nat of what a bucket is told about the shorter context's prediction


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the unsigned numbers x in rising order, equal ones as they come; x in that order).

    Numbers are sorted with their places as last bits, several times faster than places by their numbers.  If there is no room for the
    places, they stand for the last bits of the numbers, and where this does not give the order, which is seen, places are sorted after all.
    """
    bits = np.uint64(max(len(x) - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    room = not len(x) or int(x.max()) >> (64 - int(bits)) == 0
    key = x << bits if room else x & ~low
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    order = (key & low).view(np.int64)
    if room:
        return order, key >> bits
    in_order = x[order]
    if (in_order[1:] < in_order[:-1]).any():
        order = x.argsort(kind="stable")
        in_order = x[order]
    return order, in_order


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, a place of each, index of each value among the distinct ones)."""
    order, sorted_ = _order(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], at


def _distinct_pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair (a, b), index of each pair among the distinct ones), in the order of `key`, a number made from the pair.

    Where different pairs have one key, which is seen here, the pairs of that key are sorted among themselves.
    """
    order, in_order = _order(key)
    ordered = a[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = in_order[1:] != in_order[:-1]
    other = np.zeros(len(key), dtype=bool)
    other[1:] = ordered[1:] != ordered[:-1]
    ordered = b[order]
    other[1:] |= ordered[1:] != ordered[:-1]
    other &= ~new
    first, at = order[new], np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    if not other.any():
        return first, at
    distinct, other = first, order[other]
    mixed = np.zeros(len(distinct), dtype=bool)
    mixed[at[other]] = True
    some = np.flatnonzero(mixed[at])
    some = some[np.lexsort((b[some], a[some], at[some]))]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (at[some][1:] != at[some][:-1]) | (a[some][1:] != a[some][:-1]) | (b[some][1:] != b[some][:-1])
    more = np.bincount(at[some[new]], minlength=len(distinct)) - mixed  # pairs of a key besides its first
    moved = np.arange(len(distinct)) + np.cumsum(more) - more
    out = np.empty(len(distinct) + int(more.sum()), np.int64)
    out[moved[~mixed]] = first[~mixed]
    at = moved[at]
    begin = np.flatnonzero(new)
    key_of = at[some[begin]]
    nth = np.arange(len(begin)) - np.searchsorted(key_of, key_of)
    out[key_of + nth] = some[begin]
    at[some] += nth[np.cumsum(new) - 1]
    return out, at


def _with_ends(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each text's words followed by one end."""
    length = np.diff(w.first) + 1
    stop = np.cumsum(length) - 1
    token = np.full(length.sum(), END, dtype=np.uint64)
    inside = np.ones(len(token), dtype=bool)
    inside[stop] = False
    token[inside] = w.hashes(lower=True)
    return np.repeat(np.arange(w.rows), length), token


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on as one compressed string: a number of bytes for each array, as many as its largest needs, then of each all first bytes, all second bytes and so on."""
    widths = [(int(x.max()).bit_length() + 7) // 8 if len(x) else 0 for x in arrays]
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :w].T.tobytes() for x, w in zip(arrays, widths, strict=True)]
    return zstandard.compress(bytes(widths) + b"".join(planes), 1)


def _spread(data: bytes, *parts: tuple[int, type]) -> list[np.ndarray]:
    """The arrays of _squeezed, given their lengths and types."""
    raw, at, out = np.frombuffer(zstandard.decompress(data) if data else bytes(len(parts)), np.uint8), len(parts), []
    for (n, kind), w in zip(parts, raw[: len(parts)].tolist(), strict=True):
        x = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        x[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(x.view(kind).ravel())
        at += n * w
    return out


PACKED = "chunk long, ids array<{kind}>, train binary, sizes binary, text binary"


def _packed(docs: DataFrame, n_chunks: int, kind: str) -> DataFrame:
    """Texts dealt to chunks, compressed a chunk at a time.  Copies of one row go to chunks one after another."""

    def pieces(rows: pa.Table):
        rows = rows.sort_by("chunk")
        chunk = rows["chunk"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True])))
        data, offsets = string_buffers(rows["text"])
        ids, train = rows["id"].combine_chunks(), rows["train"].to_numpy().astype(np.uint8)
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk[i]], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids[i:j]), "train": pa.array([train[i:j].tobytes()], pa.binary()),
                "sizes": pa.array([np.diff(offsets[i : j + 1]).tobytes()], pa.binary()), "text": pa.array([zstandard.compress(data[offsets[i] : offsets[j]].tobytes(), 1)], pa.binary()),
            })

    def pack(batches):
        held, size, seen = [], 0, {}
        for batch in batches:
            h = batch.column("h").to_numpy()
            chunk = (h + copy_numbers(h, seen)) % n_chunks
            held.append(pa.table({"id": batch.column("id"), "text": batch.column("text"), "train": batch.column("train"), "chunk": pa.array(chunk, pa.int64())}))
            size += batch.nbytes
            if size > PACK_BYTES:
                yield from pieces(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from pieces(pa.concat_tables(held))

    return docs.select("id", "text", "train", F.xxhash64("id", "text").alias("h")).mapInArrow(pack, PACKED.format(kind=kind))


class Model:
    """What tasks need to know: sizes, candidates, test and weights."""

    def __init__(self, total: int, n_chunks: int, depth: int, least: int, gain: float, smoothing: tuple[float, ...], skip_equal: bool):
        self.depth, self.least, self.gain, self.weights, self.skip_equal = depth, least, gain, np.array([np.inf, *smoothing]), skip_equal
        self.word_buckets, self.buckets = max(1, math.ceil(total / BUCKET_TOKENS)), max(1, math.ceil(total / BUCKET_ENTRIES))
        self.hot = max(HOT, n_chunks)


class Level:
    """Distinct n-grams of one length in a chunk, in pieces by the bucket that they are sent to."""

    def __init__(
        self, which: np.ndarray, code: np.ndarray, context: np.ndarray | Callable[[np.ndarray], np.ndarray] | None, occ: np.ndarray | None, model: Model, names: np.ndarray | None = None, bits: int = 32
    ):
        """`code` names the chunk's tokens: whole hashes before any bucket has answered, then the numbers that buckets gave them.

        `context` has or gives the 64 bits that name the context of a token.  `names` tells the n-grams of the tokens `which` apart: a number of the
        context, then `bits` bits for the token, which rise with its code; they are made here if they are not given.
        """
        self.which = which
        if names is None:
            names = code[which] if context is None else (_distinct(context[which])[2] << 32 | _distinct(code[which].view(np.uint64))[2]).view(np.uint64)
        distinct, self.first, self.gram = _distinct(names)
        n = len(self.first)
        part, asks = np.zeros(n, np.int32), []
        if context is None:
            bucket = (((distinct >> np.uint64(32)) * np.uint64(model.word_buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.arange(n)
        else:
            token = which[self.first]
            number, occ, before = code[token], occ[token], distinct >> np.uint64(bits)
            new = np.ones(n, dtype=bool)
            new[1:] = before[1:] != before[:-1]
            self.run = np.cumsum(new) - 1  # number of each one's context
            named = context(token[new]) if callable(context) else context[token[new]]
            bucket = (((named >> np.uint64(32)) * np.uint64(model.buckets)) >> np.uint64(32)).astype(np.int64)[self.run]
            parts = -(-occ // model.hot)
            hot, cold = np.flatnonzero(parts > 1), np.flatnonzero(parts <= 1)
            named = named[self.run[hot]]
            cold = cold[_order(bucket[cold].view(np.uint64))[0]]
            bucket[hot] = -1 - (named >> np.uint64(1)).astype(np.int64)
            part[hot] = ((_combined(named, number[hot].view(np.uint64)) >> np.uint64(32)) * parts[hot].astype(np.uint64)) >> np.uint64(32)
            order = np.concatenate((cold, hot[np.lexsort((number[hot], part[hot], bucket[hot]))]))
            # a hot context's gain is the sum over all parts: parts without an n-gram of this chunk are asked too
            for b, i in zip(*np.unique(bucket[hot], return_index=True), strict=True):
                n_parts = parts[hot[i]]
                asks += [(b, p) for p in np.setdiff1d(np.arange(n_parts), part[hot][bucket[hot] == b])]
        bucket, part = bucket[order], part[order]
        self.edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]), [True]))) if n else np.zeros(1, np.int64)
        self.bucket, self.part = bucket[self.edge[:-1]], part[self.edge[:-1]]
        self.order, self.asks = order, asks
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.at = back[self.gram]  # place of each asked token's n-gram in the order sent

    def runs(self, i: int, j: int) -> np.ndarray:
        """Where contexts begin among the n-grams i to j in the order sent, and j."""
        c = self.run[self.order[i:j]]
        return np.append(i + np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))), j)


class Tokens:
    """Tokens of a chunk and what the buckets have answered about them so far."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, levels: int, model: Model):
        rows, tokens, train, upto, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], 0, []
        for piece in table.select(["train", "sizes", "text"]).to_pylist():
            data = np.frombuffer(zstandard.decompress(piece["text"]) if piece["text"] else b"", np.uint8)
            offsets = np.concatenate(([0], np.cumsum(np.frombuffer(piece["sizes"], np.int64))))
            for i, j in slices(offsets):
                row, token = _with_ends(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                rows.append(row + i + upto)
                tokens.append(token)
            train.append(np.frombuffer(piece["train"], np.uint8))
            upto += len(offsets) - 1
        self.rows, self.row, self.token = upto, np.concatenate(rows), np.concatenate(tokens)
        self.train_row = np.concatenate(train).astype(bool)
        self.train = self.train_row[self.row]
        self.model, n = model, len(self.row)
        self.levels = [Level(np.arange(n), self.token, None, None, model)]
        if levels == 0:
            return
        self.trained = int(answers["n"].to_numpy().max())
        self.norm = self.trained + 0.1 * (int(answers["v"].to_numpy().max()) + 1)
        level, bucket, part = answers["level"].to_numpy(), answers["bucket"].to_numpy(), answers["part"].to_numpy()
        replies = {(a, b, c): d for a, b, c, d in zip(level.tolist(), bucket.tolist(), part.tolist(), answers["data"].to_pylist(), strict=True)}
        words = self.levels[0]
        count, code = np.zeros(len(words.order), np.int64), np.zeros(len(words.order), np.int64)
        for b, i, j in zip(words.bucket.tolist(), words.edge[:-1], words.edge[1:], strict=True):
            rank, count[i:j] = _spread(replies[0, b, 0], (j - i, np.int64), (j - i, np.int64))
            code[i:j] = rank * model.word_buckets + b
        self.code, self.count = code[words.at], count[words.at]
        rank = np.empty(len(code), np.int64)
        rank[_order(code.view(np.uint64))[0]] = np.arange(len(code))
        self.word = rank[words.at]  # words of the chunk, numbered in the order of their codes
        self.gram = self.word  # the n-gram that ends with each token, numbered in the chunk, or -1 if it was not asked for
        # of the model so far: each token's prediction, which scores need, or the same without the token itself, which buckets are told
        self.root = (self.count + 0.1) / self.norm
        self.p = self.root.copy() if levels > model.depth else None
        self.without = (np.maximum(self.count - 1, 0) + 0.1) / max(self.norm - 1, 0.1) if self.p is None else None
        self.known = self.count > 0
        self.occ = np.zeros(n, np.int64)
        for length in range(1, min(levels, model.depth) + 1):
            self._ask(length)
            if length < levels:
                self._learn(length, replies)

    def _ask(self, length: int) -> None:
        """The n-grams after contexts of `length` words that have enough occurrences."""
        n = len(self.row)
        occ, before = np.zeros(n, np.int64), np.full(n, -1)
        occ[1:], before[1:] = self.count[:-1], self.gram[:-1]
        has = np.zeros(n, dtype=bool)
        has[length:] = self.row[length:] == self.row[:-length]
        # a context that stands wherever its suffix stands has the same next words: nothing to tell apart
        self.same = has & (occ == self.occ) & (length > 1 and self.model.skip_equal)
        self.occ = occ
        # what was not asked for is rare or the same as a shorter n-gram, and so is whatever goes on from it
        which = np.flatnonzero(has & (occ >= self.model.least) & ~self.same & (before >= 0))
        bits = len(self.levels[0].first).bit_length()  # no more than the words need: places fit in beside
        names = (before[which] << bits | self.word[which]).view(np.uint64)
        self.levels.append(Level(which, self.code, lambda token: self._context(token, length), occ, self.model, names, bits))
        self.gram = np.full(n, -1)
        self.gram[which] = self.levels[-1].gram

    def _context(self, token: np.ndarray, length: int) -> np.ndarray:
        """64 bits that name the `length` words before each token."""
        context = np.full(len(token), 1, np.uint64)
        for k in range(length):
            context = _combined(context, self.code[token - length + k].view(np.uint64))
        return context

    def _learn(self, length: int, replies: dict) -> None:
        level, model = self.levels[length], self.model
        count, choice, gains = np.zeros(len(level.order), np.int64), np.zeros(len(level.order), np.uint8), {}
        for b, p in level.asks:
            gains[b] = gains.get(b, 0) + np.frombuffer(replies[length, int(b), int(p)], np.float64)
        for b, p, i, j in zip(level.bucket.tolist(), level.part.tolist(), level.edge[:-1], level.edge[1:], strict=True):
            if b >= 0:
                run = level.runs(i, j)
                count[i:j], each = _spread(replies[length, b, p], (j - i, np.int64), (len(run) - 1, np.uint8))
                choice[i:j] = np.repeat(each, np.diff(run))
            else:
                reply, width = replies[length, b, p], 8 * (len(model.weights) - 1)
                gains[b] = gains.get(b, 0) + np.frombuffer(reply[:width], np.float64)
                count[i:j] = _spread(reply[width:], (j - i, np.int64))[0]
        for b, p, i, j in zip(level.bucket.tolist(), level.part.tolist(), level.edge[:-1], level.edge[1:], strict=True):
            if b < 0:
                choice[i:j] = _choice(gains[b][None, :], model.gain)[0]
        which, weight = level.which, model.weights[choice[level.at]]
        self.count = np.where(self.same, self.count, 0)
        self.count[which] = count[level.at]
        kept = which[np.isfinite(weight)]
        weight = weight[np.isfinite(weight)]
        c, occ = self.count[kept], self.occ[kept]
        if self.p is not None:
            self.p[kept] = (c + weight * self.p[kept]) / (occ + weight)
        else:
            self.without[kept] = (np.maximum(c - 1, 0) + weight * self.without[kept]) / (np.maximum(occ - 1, 0) + weight)

    def sent(self, chunk: int, length: int) -> pa.Table:
        """Rows for the buckets: of each distinct n-gram its words, occurrences in training texts, and how its last word is predicted so far."""
        level = self.levels[length]
        n = np.bincount(level.at, weights=self.train[level.which], minlength=len(level.order)).astype(np.int64)
        token = level.which[level.first][level.order]  # one place of each n-gram
        out = {"entries": [], "runs": [], "occ": [], "data": []}
        if length:
            q = np.clip(np.rint(-NATS * np.log(self.without[token])), 0, 65535).astype(np.uint16)
        for b, i, j in zip(level.bucket.tolist(), level.edge[:-1], level.edge[1:], strict=True):
            out["entries"].append(j - i)
            out["occ"].append(int(self.occ[token[i]]) if b < 0 else 0)
            if length == 0:
                out["runs"].append(0)
                out["data"].append(np.ascontiguousarray(self.token[token[i:j]]).tobytes() + _squeezed(n[i:j]))
                continue
            run = level.runs(i, j)
            out["runs"].append(len(run) - 1)
            words = [self.code[token[run[:-1]] - length + k] for k in range(length)]
            last = self.code[token[i:j]]
            rise = np.diff(last, prepend=0)  # numbers rise inside a context: steps are smaller
            rise[run[:-1] - i] = last[run[:-1] - i]
            out["data"].append(_squeezed(*words, np.diff(run).astype(np.int32), rise, n[i:j], q[i:j]))
        bucket, part = [*level.bucket.tolist(), *(b for b, _ in level.asks)], [*level.part.tolist(), *(p for _, p in level.asks)]
        blank = [0] * len(level.asks)
        return pa.table({
            "chunk": pa.array([chunk] * len(bucket), pa.int64()), "bucket": pa.array(bucket, pa.int64()), "part": pa.array(part, pa.int32()), "entries": pa.array(out["entries"] + blank, pa.int32()),
            "runs": pa.array(out["runs"] + blank, pa.int32()), "occ": pa.array(out["occ"] + blank, pa.int64()), "data": pa.array(out["data"] + [b""] * len(blank), pa.binary()),
        })


SENT = "chunk long, bucket long, part int, entries int, runs int, occ long, data binary"
REPLY = "chunk long, level int, bucket long, part int, data binary"


def _choice(gains: np.ndarray, least: float) -> np.ndarray:
    """1 + which weight gains most, or 0 where none gains more than `least`."""
    return np.where(gains.max(axis=1) > least, 1 + gains.argmax(axis=1), 0).astype(np.uint8)


def _replies(table: pa.Table, level: int, data: list[bytes]) -> pa.Table:
    return pa.table({"chunk": table["chunk"], "level": pa.array([level] * table.num_rows, pa.int32()), "bucket": table["bucket"], "part": table["part"], "data": pa.array(data, pa.binary())})


def _words_of_bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, their counts in training texts, place of each one sent)."""
    n = [np.zeros(0, np.int64)]
    h = [np.zeros(0, np.uint64)]
    for entries, data in zip(table["entries"].to_pylist(), table["data"].to_pylist(), strict=True):
        h.append(np.frombuffer(data[: 8 * entries], np.uint64))
        n += _spread(data[8 * entries :], (entries, np.int64))
    distinct, _, at = _distinct(np.concatenate(h))
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, at, np.concatenate(n))
    return distinct, count, at


def _answer_words(table: pa.Table) -> pa.Table:
    """Count of each token, and its rank by count in the bucket, which with the bucket names it from here on."""
    distinct, count, at = _words_of_bucket(table)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -count))] = np.arange(len(distinct))
    data, i = [], 0
    for entries in table["entries"].to_pylist():
        mine = at[i : i + entries]
        data.append(_squeezed(rank[mine], count[mine]))
        i += entries
    return _replies(table, 0, data)


def _size_of_bucket(table: pa.Table) -> pa.Table:
    _, count, _ = _words_of_bucket(table)
    return pa.table({"n": pa.array([int(count.sum())]), "v": pa.array([int((count > 0).sum())])})


def _answer_contexts(table: pa.Table, length: int, model: Model) -> pa.Table:
    """Counts of the n-grams sent, and the divergence test of their contexts."""
    runs, entries, occs = table["runs"].to_pylist(), table["entries"].to_pylist(), table["occ"].to_numpy()
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]]
    for r, e, data in zip(runs, entries, table["data"].to_pylist(), strict=True):
        *words, span, rise, n, q = _spread(data, *[(r, np.int64)] * length, (r, np.int32), (e, np.int64), (e, np.int64), (e, np.uint16))
        context = np.full(r, 1, np.uint64)
        for w in words:
            context = _combined(context, w.view(np.uint64))
        begin, upto = np.cumsum(span) - span, np.cumsum(rise)
        token = upto - np.repeat(upto[begin] - rise[begin], span)
        for column, x in zip(columns, (np.repeat(context, span), token, n, q), strict=True):
            column.append(x)
    context, token, n, q = (np.concatenate(x) for x in columns)
    first, at = _distinct_pairs(_combined(context, token.view(np.uint64)), context, token)
    count = np.bincount(at, weights=n, minlength=len(first)).astype(np.int64)
    distinct, _, of = _distinct(context[first])
    hot = bool(len(occs) and table["bucket"][0].as_py() < 0)
    occ = np.full(len(distinct), occs.max()) if hot else np.bincount(of, weights=count, minlength=len(distinct))
    p = np.exp(-q[first].astype(np.float64) / NATS)
    gains = np.zeros((len(distinct), len(model.weights) - 1))
    live = np.flatnonzero(count)
    for i, w in enumerate(model.weights[1:]):
        each = count[live] * np.log((count[live] - 1 + w * p[live]) / ((occ[of[live]] - 1 + w) * p[live]))
        gains[:, i] = np.bincount(of[live], weights=each, minlength=len(distinct))
    choice = _choice(gains, model.gain) if len(gains) else np.zeros(0, np.uint8)
    total = gains.sum(axis=0).tobytes()  # of a hot context's part: it holds one context only
    data, i = [], 0
    for r, e in zip(runs, entries, strict=True):
        mine = at[i : i + e]
        if hot:
            data.append(total + (_squeezed(count[mine]) if e else b""))
        else:
            c = context[i : i + e]
            begin = np.concatenate(([True], c[1:] != c[:-1])) if e else np.zeros(0, bool)
            data.append(_squeezed(count[mine], choice[of[mine[begin]]]))
        i += e
    return _replies(table, length, data)


def suffix_tree_scores(
    docs: DataFrame, train: Column, least: int = LEAST, gain: float = GAIN, smoothing: tuple[float, ...] = SMOOTHING, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text",
    skip_equal: bool = True,
) -> DataFrame:
    """Score whole texts by a suffix tree over words, learned from all rows for which `train` holds.

    Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased) and one end for each text.  The root
    predicts a token of count c by (c + 0.1) / (N + 0.1 (V + 1)).  A context of one to `depth` words that occurs
    `least` times is kept if its smoothed next-token distribution gains `gain` nats over that of the longest kept suffix,
    each occurrence being predicted without itself by both.  A context of as many occurrences as its suffix of one word less has the same
    next tokens and no divergence; it is not tested unless `skip_equal` is false.  A kept context predicts (count + weight * shorter
    context's) / (occurrences + weight), with the weight of `smoothing` that gains most (ties go to the first); each token is
    predicted by the longest kept context before it.

    Returns id_col, train (boolean), n_tokens, n_known, train_tokens (long), base_score (root only) and score (double, log10).
    A null or empty text is its end alone; repeated rows each count and are each returned; null ids are allowed; without
    training rows every token is unknown.  Other columns are not read; an empty table gives an empty result.

    Texts are packed into chunks (see chunks.py), which ask hash buckets about their distinct words once and then, one
    context length after another, about their distinct n-grams.  Words are counted by whole 64-bit hashes; from
    then on a word is a number that its bucket gave it.  A context is named by 64 bits made from its words' numbers, and the next words of a
    context are compared by their numbers, so no count goes to another word.  A bucket
    sees all next words of a context and takes the test; those of a context of over HOT occurrences are dealt to
    several buckets, and each chunk adds up their parts of the gain.  The tree is never in one place.
    """
    total = text_bytes(docs, text_col)
    n_chunks = max(1, math.ceil(total / CHUNK_BYTES))
    model = Model(total, n_chunks, depth, least, gain, tuple(smoothing), skip_equal)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = docs.schema[id_col].dataType.simpleString()
    words = _packed(base, n_chunks, kind).groupBy("chunk")

    def ask(length: int):
        return lambda left, right: Tokens(left, right, length, model).sent(left["chunk"][0].as_py(), length)

    def answer(length: int):
        return lambda table: _answer_contexts(table, length, model)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left, right, depth + 1, model)
        n = np.bincount(t.row, minlength=t.rows)
        sums = lambda x: np.bincount(t.row, weights=x, minlength=t.rows)
        return pa.table({
            "id": pa.chunked_array([c.flatten() for c in left["ids"].chunks]),
            "train": pa.array(t.train_row), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(sums(t.known).astype(np.int64)), "train_tokens": pa.array(np.full(t.rows, t.trained), pa.int64()),
            "base_score": pa.array(sums(np.log10(t.root))), "score": pa.array(sums(np.log10(t.p))),
        })

    first = words.applyInArrow(lambda table: Tokens(table, None, 0, model).sent(table["chunk"][0].as_py(), 0), SENT).groupBy("bucket", "part")
    size = first.applyInArrow(_size_of_bucket, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    answers = first.applyInArrow(_answer_words, REPLY).crossJoin(F.broadcast(size)).repartition("chunk")  # one row of two numbers; dealt once: unions keep the partitioning
    for length in range(1, depth + 1):
        asked = words.cogroup(answers.groupBy("chunk")).applyInArrow(ask(length), SENT).groupBy("bucket", "part")
        replies = asked.applyInArrow(answer(length), REPLY)
        answers = answers.unionByName(replies.select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v")).repartition("chunk"))
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return words.cogroup(answers.groupBy("chunk")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def op8_lm(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: base and model score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_tree_scores(docs, ~held_out("doc_id", 10, 0))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
