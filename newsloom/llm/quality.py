"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import each_slice
from .textbytes import Words

#: Labelled rows that the model is fitted on at most: the only sample taken.
TRAINING_ROWS = 8_000
STATISTICS = (
    "words", "word_bytes", "upper", "digit", "punctuation", "symbol", "symbol_words", "capital_words", "no_letter_words",
    "distinct_words", "top_word", "repeats", "distinct_pairs", "lines", "line_words", "repeated_lines", "sentence_ends", "odd_bytes",
)

_UPPER, _DIGIT, _PUNCT, _SYMBOL, _LETTER = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SYMBOL[:] = _PUNCT
_SYMBOL[[ord(c) for c in ".,;:?'\"()-"]] = False
_ODD = np.zeros(256, dtype=bool)
_ODD[:0x20] = True
_ODD[[0x09, 0x0A, 0x0D]] = False
_ODD[0x7F] = True


def _per_row(words: Words, value: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
    return upto[words.first[1:]] - upto[words.first[:-1]]


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, largest count of a value) by row."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    count = np.diff(np.append(new, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], count)
    return np.bincount(r[new], minlength=n).astype(np.float64), top


def statistics_of(w: Words) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n, data = w.rows, w.data
    byte = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[data])))[w.offsets]).astype(np.float64)
    within = lambda table: np.concatenate(([0], np.cumsum(table[data])))
    count = np.diff(w.first).astype(np.float64)
    some, pairs = np.maximum(count, 1), np.maximum(count - 1, 1)
    size = np.maximum(np.diff(w.offsets).astype(np.float64), 1)
    letters = within(_LETTER)
    has = lambda sums: sums[w.end] - sums[w.start]
    length = (w.end - w.start).astype(np.float64)
    hashes = w.hashes(lower=True)
    at, pair = w.windows(hashes, 2)
    distinct, top = _distinct(w.row, hashes, n)
    distinct_pairs, _ = _distinct(w.row[at], pair, n)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    symbol, upper = within(_SYMBOL), within(_UPPER)
    # lines: hashed by the words in them
    newline = np.concatenate(([0], np.cumsum(data == 0x0A)))
    line = newline[w.start] if len(w.start) else np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])))) if len(line) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)))
    ends = np.append(start[1:], len(line))
    line_hash = sums[ends] - sums[start] if len(start) else np.zeros(0, np.uint64)
    line_row = w.row[start]
    n_lines = np.bincount(line_row, minlength=n).astype(np.float64)
    distinct_lines, _ = _distinct(line_row, line_hash, n)
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    stop = np.isin(last, [0x2E, 0x21, 0x3F])
    columns = (
        count, _per_row(w, length) / some, byte(_UPPER) / np.maximum(byte(_LETTER), 1), byte(_DIGIT) / size, byte(_PUNCT) / size, byte(_SYMBOL) / size,
        _per_row(w, has(symbol) > 0) / some, _per_row(w, has(upper) == has(letters)) / some, _per_row(w, has(letters) == 0) / some,
        distinct / some, top / some, _per_row(w, again) / pairs, distinct_pairs / pairs, n_lines, count / np.maximum(n_lines, 1),
        (n_lines - distinct_lines) / np.maximum(n_lines, 1), _per_row(w, stop) / some, byte(_ODD) / size,
    )
    return np.stack(columns, axis=1)


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS]))
def statistics(text: pa.Array) -> pa.Array:
    """Struct of STATISTICS of each whole text; null counts as empty."""
    parts = [statistics_of(w) for _, _, w in each_slice(text)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])], list(STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which hold


def _tree(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, features: np.ndarray, path: Rule, rules: set, out: np.ndarray, rows: np.ndarray, least: int) -> None:
    """Grow one regression tree on the residuals and note the path to each of its nodes."""
    out[rows] = residual[rows].sum() / max(weight[rows].sum(), 1e-6)
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * least:
        return
    best, total, n = (1e-9, -1, 0.0), residual[rows].sum(), len(rows)
    for f in features:
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        s, g = v[order], np.cumsum(residual[rows][order])[:-1]
        k = np.arange(1, n)
        ok = (s[1:] > s[:-1]) & (k >= least) & (n - k >= least)
        if ok.any():
            gain = np.where(ok, g**2 / k + (total - g) ** 2 / (n - k) - total**2 / n, -np.inf)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (s[i] + s[i + 1]) / 2)
    if best[1] < 0:
        return
    _, f, cut = best
    above = x[rows, f] > cut
    for side in (True, False):
        _tree(x, residual, weight, depth - 1, features, (*path, (int(f), side, float(cut))), rules, out, rows[above == side], least)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, shrinkage: float = 0.3, penalty: float = 2e-3, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, weighted rules): paths of boosted trees, weighted by logistic regression under an L1 penalty.

    Without rows of both classes, or with too few to split, there are no rules and the intercept is that of a chance of (ones + 1) / (rows + 2).
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return base, []
    rng, score, rules = np.random.default_rng(seed), np.full(len(y), base), set()
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.permutation(len(y))[: max(2 * least, len(y) // 2)])
        features = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        step, grown = np.zeros(len(y)), set()
        _tree(x, y - p, p * (1 - p), depth, features, (), grown, step, rows, least)
        rules |= grown
        whole = [(r, holds(r, x)) for r in grown]
        for r, inside in sorted(whole, key=lambda z: len(z[0])):
            picked = inside[rows]
            if picked.any():
                step[inside] = step[rows[picked][0]] if len(r) == depth else step[inside]
        score = score + shrinkage * np.clip(step, -4, 4)
    rules = sorted(rules)
    alike = {np.packbits(holds(r, x)).tobytes(): r for r in reversed(rules)}  # rules alike on all rows are one
    rules = sorted(alike.values())
    if not rules:
        return base, []
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    # accelerated proximal gradient
    w, b, v, c, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    rate_ = 4.0 / (np.linalg.eigvalsh(z.T @ z)[-1] / len(y) + 1)
    for _ in range(300):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        new, new_b = v - rate_ * (z.T @ g) / len(y), c - rate_ * g.mean()
        new = np.sign(new) * np.maximum(np.abs(new) - rate_ * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return float(b), [(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-4]


def compiled(intercept: float, rules: list[tuple[Rule, float]], stats: str) -> Column:
    """The score as a column over the struct `stats`: the logistic of the weights of all rules that hold."""
    total = F.lit(intercept)
    for rule, weight in rules:
        conditions = [F.col(f"{stats}.{STATISTICS[f]}") > cut if above else F.col(f"{stats}.{STATISTICS[f]}") <= cut for f, above, cut in rule]
        holds_all = conditions[0]
        for more in conditions[1:]:
            holds_all = holds_all & more
        total = total + F.when(holds_all, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def quality_scores(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, training_rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The columns of `docs` with score (double, 0 to 1: chance of label 1) and predicted (int: score >= threshold).

    The model learns from labelled documents that are not `held_out` (a condition on the id column), from at most
    `training_rows` of them, picked by a hash of the id; everything else covers all rows.  Inputs of a score are
    statistics of the whole text alone.  Null and empty texts are scored on zeros.  A document with several labels
    counts by their mean, one with several texts is learned by the smallest, a null label not at all; if no label is left, every score is the prior 0.5.  Columns of `docs` named score or
    predicted are replaced; repeated rows are scored alike; an empty table gives an empty result.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("__label"))
    if held_out is not None:
        known = known.filter(~held_out)
    # at most training_rows rows of 17 bytes: small enough to send to every task
    picked = known.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(training_rows)
    learn = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, "__label").agg(F.min(text_col).alias("text"))
    learn = learn.select("__label", statistics(F.col("text")).alias("s"), id_col)
    sample = learn.orderBy(id_col).toArrow()
    s = sample["s"].combine_chunks()
    x = np.stack([s.field(i).to_numpy() for i in range(len(STATISTICS))], axis=1) if len(sample) else np.zeros((0, len(STATISTICS)))
    intercept, rules = fit_rules(x, sample["__label"].to_numpy() if len(sample) else np.zeros(0))
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*others, statistics(F.col(text_col)).alias("__stats")).withColumn("score", compiled(intercept, rules, "__stats"))
    return scored.select(*others, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` modulo `parts`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality_scores(docs, labels, held_out("doc_id", 5, 0))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
