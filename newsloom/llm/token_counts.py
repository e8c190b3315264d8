"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, read_vocabulary, spans_hash
from .pretokens import boundaries
from .textbytes import _byte_values, _powers, _sums, mix, slices, string_buffers

TRIE_BYTES = 1 << 20  # text whose distinct pre-tokens share one trie
LONG = 512  # bytes above which a pre-token shares no trie: a line without branches gains nothing by levels
POSITIONS = 1 << 16  # of a long pre-token whose tokens are looked up at once
STEP = 1 << 20  # a cost counts in units of this, the tokens in the rest, so equal costs go to fewer tokens


class Unigram:
    """Cost of every token: 1000 times minus the log of its chance under Zipf's law over ranks, as a whole number."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        tokens = list(ranks)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        norm = math.log(sum(1 / (r + 2) for r in ranks.values()))
        cost = np.array([round(1000 * (math.log(ranks[t] + 2) + norm)) for t in tokens], dtype=np.int64) * STEP + 1
        hashes, length = spans_hash(np.frombuffer(b"".join(tokens), np.uint8), edges[:-1], edges[1:]), np.diff(edges)
        self.by_length = {}
        for k in np.unique(length):
            mine = np.flatnonzero(length == k)
            mine = mine[np.argsort(hashes[mine])]
            self.by_length[int(k)] = (hashes[mine], cost[mine])
        self.longest = max(self.by_length)

    def costs(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the strings of k bytes are tokens, their costs)."""
        known, cost = self.by_length[k]
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == hashes)
        return hit, cost[at[hit]]

    def best(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least cost of each distinct pre-token data[start:end].

        The pre-tokens enter a trie level by level.  A node's forward cost is the least over all tokens that end at it
        of the token's cost and that of the node where it begins; nodes of a prefix that many share are
        computed once, and a pre-token's cost is that of its terminal node.
        """
        out, length = np.zeros(len(start), dtype=np.int64), end - start
        for i in np.flatnonzero(length > LONG):
            out[i] = self._of_long(int(start[i]), int(end[i]))
        live = np.flatnonzero(length <= LONG)
        node = np.zeros(len(live), dtype=np.int64)
        forward, window, depth = np.zeros((1, 1), dtype=np.int64), 1, 0  # forward costs of the last `longest` ancestors of each node
        while len(live):
            more = length[live] > depth
            done = live[~more]
            out[done] = forward[node[~more], -1]
            live, node = live[more], node[more]
            if not len(live):
                break
            depth += 1
            key, index, inverse = np.unique(node * 256 + data[start[live] + depth - 1], return_index=True, return_inverse=True)
            ancestors, stop = forward[key // 256], start[live[index]] + depth
            cost = np.full(len(key), np.iinfo(np.int64).max)
            for k in range(1, min(self.longest, depth, window) + 1):
                if k in self.by_length:
                    hit, token = self.costs(k, spans_hash_at(self.sums, stop - k, stop))
                    cost[hit] = np.minimum(cost[hit], ancestors[hit, -k] + token)
            forward = np.concatenate((ancestors[:, -(self.longest - 1) :] if self.longest > 1 else ancestors[:, :0], cost[:, None]), axis=1)
            window, node = forward.shape[1], inverse
        return out

    def _of_long(self, start: int, end: int) -> int:
        """Least cost of one long pre-token: all tokens in it by where they end, then one step for each."""
        forward = [0] + [1 << 62] * (end - start)
        for low in range(start, end, POSITIONS):
            stops, lengths, costs = [], [], []
            for k in self.by_length:
                stop = np.arange(max(low + 1, start + k), min(low + POSITIONS, end) + 1)
                hit, cost = self.costs(k, spans_hash_at(self.sums, stop - k, stop))
                stops.append(stop[hit] - start)
                lengths.append(np.full(len(hit), k))
                costs.append(cost)
            stop, length, cost = map(np.concatenate, (stops, lengths, costs))
            order = np.argsort(stop, kind="stable")
            for at, k, c in zip(stop[order].tolist(), length[order].tolist(), cost[order].tolist(), strict=True):
                if forward[at - k] + c < forward[at]:
                    forward[at] = forward[at - k] + c
        return forward[-1]

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens, tokens, cost in thousandths) of each text."""
        start, first = boundaries(data, offsets)
        end = np.append(start[1:], len(data)).astype(np.int64)
        self.sums = prefix_sums(data)
        _, index, inverse = np.unique(spans_hash_at(self.sums, start, end), return_index=True, return_inverse=True)
        cost = self.best(data, start[index], end[index])[inverse]
        upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
        return np.diff(first), upto(cost % STEP), upto(cost // STEP)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(0, len(data) + 1)
    return _sums(_byte_values(False)[data] * power[: len(data)]), inverse


def spans_hash_at(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of spans_hash from sums that are made once a text."""
    total, inverse = sums
    return mix((total[end] - total[start]) * inverse[start])


@lru_cache(maxsize=2)
def _unigram(raw: bytes) -> Unigram:
    return Unigram(raw)


def unigram_token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The columns of `docs` with n_pretokens, n_tokens (long) and log_prob (double, natural log).

    A whole text is split by the public pre-token pattern; each pre-token takes its likeliest segmentation into tokens
    of the rank file at `path`, whose chances fall with rank by Zipf's law (all single bytes are tokens, so there always
    is one; equal chances go to fewer tokens).  Null and empty texts have 0, 0 and 0.0; repeated rows are each counted.  No row moves between tasks.
    Columns of `docs` of these names are replaced; an empty table gives an empty result.
    """
    raw = read_vocabulary(path)

    @F.arrow_udf("n_pretokens long, n_tokens long, log_prob double")
    def count(column: pa.Array) -> pa.Array:
        model, (data, offsets) = _unigram(raw), string_buffers(column)
        parts = [model.of_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, TRIE_BYTES)]
        a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(-c / 1000.0 + 0.0, pa.float64())], ["n_pretokens", "n_tokens", "log_prob"])

    others = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens", "log_prob")]
    return docs.select(*others, count(F.col(text_col)).alias("__counts")).select(*others, "__counts.*")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return unigram_token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_pretokens", "n_tokens", "log_prob")
