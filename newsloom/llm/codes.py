"""Operator 13: vector code compression by Lloyd's rounds that send only what changed.

Each vector is cut into parts, and each part gets the index of its nearest codebook entry.  The rows with their previous
assignments are persisted between rounds; a round assigns anew, and only parts whose assignment changed send their
components: minus to the old entry, plus to the new one, added up in each task before the shuffle.  The driver holds
the running sums, which are integers of the size of the codebooks, so entries are exact whatever the order of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, ragged, shape

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LINEAGE = 8  # rounds after which the persisted state is checkpointed
NUMBER = pa.decimal128(38, 0)
CODED = "code binary, error decimal(38,0)"


class Codebooks:
    """Entries by part, entry and place as exact integers, and how vectors are cut and compared."""

    def __init__(self, entries: np.ndarray, dim: int, exact: bool):
        self.entries, self.dim = entries, dim
        #: floats hold every product and sum exactly, or else Python's integers are used
        self.kind = np.float64 if exact else object
        self.parts, self.size, self.width = entries.shape

    def cut(self, column: pa.Array) -> np.ndarray:
        """(row, part, place) integers of vectors that all have `dim` components; zeros fill the last part."""
        values = ragged(column)[0].reshape(-1, self.dim) * SCALE
        x = np.floor(values) if self.kind is np.float64 else np.array([[math.floor(c) for c in row] for row in values.tolist()], dtype=object).reshape(values.shape)
        out = np.zeros((len(x), self.parts * self.width), dtype=self.kind)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry by row and part, squared distances summed over parts); ties go to the lower index."""
        code, error = np.zeros((len(x), self.parts), np.uint8), np.zeros(len(x), dtype=self.kind)
        for p in range(self.parts):
            entry = self.entries[p].astype(self.kind)
            far = (entry * entry).sum(axis=1)[None, :] - 2 * x[:, p].dot(entry.T)
            code[:, p] = far.argmin(axis=1)
            error += far[np.arange(len(x)), code[:, p]] + (x[:, p] * x[:, p]).sum(axis=1)
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()


def _bytes(code: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in code], pa.binary())


def _next_state(books: Codebooks):
    """Rows with the new code and the code they had before."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = books.nearest(books.cut(batch["vector"]))
            yield pa.RecordBatch.from_arrays([batch["vector"], _bytes(code), batch["code"]], ["vector", "code", "was"])

    return step


def _changes(books: Codebooks):
    """What the parts with a new assignment add to and take from each entry: one row a task for each (part, entry, place)
    that changes; place -1 is the count."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((books.parts, books.size, books.width + 1), dtype=object)
        for batch in batches:
            was, now = batch["was"].to_pylist(), batch["code"].to_pylist()
            moved = [i for i in range(len(now)) if was[i] != now[i]]
            if not moved:
                continue
            x = books.cut(batch["vector"].take(pa.array(moved, pa.int64())))
            new = np.frombuffer(b"".join(now[i] for i in moved), np.uint8).reshape(-1, books.parts)
            none = bytes([255]) * books.parts
            old = np.frombuffer(b"".join(was[i] or none for i in moved), np.uint8).reshape(-1, books.parts)
            for p in range(books.parts):
                other = new[:, p] != old[:, p]
                for code, sign in ((new, 1), (old, -1)):
                    for e in np.unique(code[other, p]):
                        if e < books.size:
                            part = x[other & (code[:, p] == e), p]
                            total[p, e, 0] += sign * len(part)
                            total[p, e, 1:] += sign * np.array([int(c) for c in part.sum(axis=0)], dtype=object)
        part, entry, place = np.nonzero(total)
        value = pa.array([int(v) for v in total[part, entry, place]], NUMBER)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place - 1, pa.int32()), value], ["part", "entry", "place", "value"])

    return step


def _coded(books: Codebooks):
    def step(column: pa.Array) -> pa.Array:
        code, error = books.nearest(books.cut(column))
        if books.kind is np.float64:
            far = pa.array(error.astype(np.int64)).cast(NUMBER)
        else:
            far = pa.array([e if e < 10**38 else None for e in error.tolist()], NUMBER)
        return pa.StructArray.from_arrays([_bytes(code), far], ["code", "error"])

    return step


def fit(vectors: DataFrame, first: list[list[float]], dim: int, peak: float, parts: int, rounds: int) -> Codebooks:
    """Codebooks after `rounds` rounds over `vectors` (vector), from the parts of the vectors `first`."""
    width = -(-dim // parts)
    exact = 4 * (peak * SCALE + 1) ** 2 * width * parts < 2**53
    books = Codebooks(np.zeros((parts, len(first), width), dtype=object), dim, exact)
    flat = books.cut(pa.array(first, pa.list_(pa.float64())))
    books.entries = np.array([int(c) for c in flat.transpose(1, 0, 2).ravel()], dtype=object).reshape(books.entries.shape)
    sums = np.zeros(books.entries.shape, dtype=object)
    counts = np.zeros(books.entries.shape[:2], dtype=object)
    state = vectors.select("vector", F.lit(None).cast("binary").alias("code"))
    kind = vectors.schema["vector"].dataType.simpleString()
    for r in range(rounds):
        now = state.mapInArrow(_next_state(books), f"vector {kind}, code binary, was binary")
        now = now.checkpoint() if r % LINEAGE == LINEAGE - 1 else now.persist(StorageLevel.MEMORY_AND_DISK)
        sent = now.mapInArrow(_changes(books), "part int, entry int, place int, value decimal(38,0)")
        for row in sent.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect():  # one number for each component of the codebooks
            if row["place"] < 0:
                counts[row["part"], row["entry"]] += int(row["value"])
            else:
                sums[row["part"], row["entry"], row["place"]] += int(row["value"])
        state.unpersist()
        state = now
        used = counts > 0
        entries = books.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        books = Codebooks(entries, dim, exact)
    state.unpersist()
    return books


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every usable vector.

    Each component becomes floor(4096 * x).  Vectors are cut into `parts` equal consecutive parts (zeros fill the last one
    if their number does not divide the length); each part's codebook starts as that part of the `entries` (at most 255) rows with the smallest
    ids (null last; equal ids by their vectors), fewer if there are fewer rows.  After `rounds` rounds, code has two hex digits
    for each part, error the squared distances summed over parts, label_error its sum over equal labels (nulls together).  All
    arithmetic is in exact integers.  Rows whose vector is null, empty, holds null or non-finite components or is
    not of the commonest length are dropped; repeated rows count each; other columns of `vectors` are not returned; an empty table gives
    no rows; an error beyond a long is null.  Between rounds tasks send sums of the size of the codebooks, whatever the rows.
    """
    if not 1 <= entries <= 255:
        raise ValueError("entries must be 1 to 255")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).filter(finite("vector"))
    dim, _, peak = shape(rows, "vector")
    rows = rows.filter(F.size("vector") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # at most `entries` rows
    if first:
        books = fit(rows.select("vector"), [list(r["vector"]) for r in first], dim, peak, parts, rounds)
    else:
        books = Codebooks(np.zeros((parts, 0, 0), dtype=object), 0, True)
    both = F.arrow_udf(_coded(books), "code binary, error decimal(38,0)")(F.col("vector"))
    coded = rows.select("vec_id", "label", both.alias("both")).select("vec_id", "label", F.lower(F.hex("both.code")).alias("code"), F.col("both.error").alias("error"))
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", F.expr("try_cast(error AS long)").alias("error"), F.expr("try_cast(label_error AS long)").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: codes, errors and the digest of the codebooks."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql() -> str:
    """DuckDB: parts as lists, every round as a table of assignments and one of entries."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT p.vec_id, p.label, p.part, p.x, min({'far': FAR, 'entry': b.entry}) AS best FROM parts p JOIN bookR b ON p.part = b.part GROUP BY ALL".replace("FAR", far)
    steps = [
        """vecs AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM vecs, range({PARTS}) AS r(part))",
        f"book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < {ENTRIES})",
    ]
    for r in range(ROUNDS):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.replace('bookR', f'book{r}')})")
        steps.append(
            f"""mean{r} AS (SELECT part, best.entry AS entry, i, CAST(floor(sum(x[i + 1]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS c FROM near{r}, range(len(x)) AS k(i) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM mean{r} GROUP BY ALL) n ON b.part = n.part AND b.entry = n.entry)"""
        )
    steps.append(f"last AS MATERIALIZED ({nearest.replace('bookR', f'book{ROUNDS}')})")
    steps.append("codes AS (SELECT vec_id, label, string_agg(format('{:02x}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM last GROUP BY vec_id, label)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"


OP13_SQL = _op13_sql()
