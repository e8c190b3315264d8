"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, buckets_for, chunk_key, each_slice, levels_of, packed, shared_hashes, text_bytes, unpacked
from .graph import components
from .textbytes import Words, mix, unique_sorted

KEYS = 2  # independent min-hash keys that bring similar documents into one block
BLOCK_ROWS = 512  # documents in one block of the product
BLOCK_BYTES = 4 << 20  # and bytes of their shingles' hashes
ROWS_AT_ONCE = 16  # rows of the left factor multiplied at once
PRODUCTS = 1 << 18  # products that are added up at once
HOT_COLUMN = 64  # components above which a shingle's list is dealt to several keys


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a text of fewer than k words is one shingle of its own kind."""
    hashes = words.hashes(lower=True)
    at, shingle = words.windows(hashes, k)
    rows, values = [words.row[at]], [shingle]
    length = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(length == n)
        value = np.full(len(short), n, dtype=np.uint64)
        for i in range(n):
            value = mix(value * np.uint64(0x100000001B3) + hashes[words.first[short] + i])
        rows.append(short)
        values.append(value)
    return np.concatenate(rows), np.concatenate(values)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs ordered by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _needed(size_a, size_b, percent: int):
    """Least overlap of two linked sets: overlap / (a + b - overlap) >= percent / 100, in whole numbers."""
    return -((-percent * (size_a + size_b)) // (100 + percent))


def overlaps(left: np.ndarray, columns: np.ndarray, lists: np.ndarray, rows_of: np.ndarray, m: int, n: int) -> np.ndarray:
    """Rows of the product of two incidence matrices: overlap counts of n left rows with m right ones.

    The left factor has ones at (left, columns); column c of the right one holds the rows rows_of[lists[c]:lists[c + 1]].
    Counts accumulate over blocks of columns of at most PRODUCTS products, so memory does not grow with the factors.
    """
    out = np.zeros(n * m, np.int32)
    length = lists[columns + 1] - lists[columns]
    upto = np.concatenate(([0], np.cumsum(length)))
    i = 0
    while i < len(columns):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PRODUCTS, side="right")) - 1)
        some = length[i:j]
        at = np.repeat(lists[columns[i:j]] - (upto[i:j] - upto[i]), some) + np.arange(upto[j] - upto[i])
        out += np.bincount(np.repeat(left[i:j] * m, some) + rows_of[at], minlength=n * m).astype(np.int32)
        i = j
    return out.reshape(n, m)


def linked_in_block(hashes: np.ndarray, edges: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Component label (smallest row) of each row of a block, by a blocked sparse product.

    Row i of the incidence matrix has a one in each column of hashes[edges[i]:edges[i + 1]].  A few rows at a
    time are multiplied with all rows that have no label yet: overlap counts accumulate over the shared columns,
    pairs below the bound that their sizes give are discarded, and the rest take the label and come next.
    Rows that have a label are not multiplied again, as their component is known, and leave the columns.
    """
    m = len(sizes)
    row = np.repeat(np.arange(m), np.diff(edges))
    column = np.unique(hashes, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows_of, lists = row[order], np.concatenate(([0], np.cumsum(np.bincount(column))))
    label, free, held = np.full(m, -1), np.ones(m, dtype=bool), m
    for start in range(m):
        if not free[start]:
            continue
        free[start], label[start], front = False, start, [start]
        while front and (left := int(free.sum())):
            if left <= held // 2:  # rows with a label leave the right factor
                stay = free[rows_of]
                rows_of, lists, held = rows_of[stay], np.concatenate(([0], np.cumsum(stay)))[lists], left
            rows, front = front[:ROWS_AT_ONCE], front[ROWS_AT_ONCE:]
            cols = [column[edges[r] : edges[r + 1]] for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
            overlap = overlaps(of, np.concatenate(cols), lists, rows_of, m, len(rows))
            bound = _needed(sizes[rows][:, None], sizes[None, :], percent)
            new = np.flatnonzero(((overlap >= bound) & (overlap > 0)).any(axis=0) & free)
            free[new], label[new] = False, start
            front += new.tolist()
    return label


def products_of_pairs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """The product's entries at given pairs: the overlap of row i of `a` with row i of `b`, over blocks of pairs of bounded size."""
    (x, ex), (y, ey) = unpacked(a, np.uint64), unpacked(b, np.uint64)
    out = np.zeros(len(ex) - 1, np.int64)
    upto, i = ex + ey, 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PRODUCTS, side="right")) - 1)
        pair = np.concatenate((np.repeat(np.arange(i, j), np.diff(ex[i : j + 1])), np.repeat(np.arange(i, j), np.diff(ey[i : j + 1]))))
        value = np.concatenate((x[ex[i] : ex[j]], y[ey[i] : ey[j]]))
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        out[i:j] = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])] - i, minlength=j - i)
        i = j
    return out


def _class_and_sets(chunks: DataFrame, id_col: str, text_col: str, total: int, k: int, percent: int) -> DataFrame:
    """Per document its shingle count and, if it can have a link at all, its set's fingerprint and shared shingles.

    Only shingles that two documents have can be shared, so a document of which fewer than `percent` of the
    shingles occur elsewhere has no link.  `shared` has the others' shingles in one order for all documents, by
    the level of their spread over chunks and then the hash, so rare ones stand first; of a chunk's equal sets one carries it.
    """

    def hashes_of(table: pa.Table) -> np.ndarray:
        parts = [_shingles(w, k)[1] for _, _, w in each_slice(table[text_col])]
        return unique_sorted(np.concatenate(parts))

    n_buckets = buckets_for(total, 4)
    found = shared_hashes(chunks, hashes_of, n_buckets, exact=False)

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, values, upto = [], [], 0
        for i, j, w in each_slice(left[text_col]):
            row, value = _distinct(*_shingles(w, k))
            rows.append(row + i)
            values.append(value)
        row, value = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (values, np.uint64)))
        n = left.num_rows
        size = np.bincount(row, minlength=n)
        distinct, at, twice = np.unique(value, return_inverse=True, return_counts=True)
        level = levels_of(right, distinct, n_buckets)
        shared = ((level > 0) | (twice > 1))[at]
        chunks_with = level[at]
        some = np.bincount(row, weights=shared, minlength=n).astype(np.int64)
        open_ = (size > 0) & (100 * some >= percent * size)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=first[1:])
        sums = [np.concatenate(([0], np.cumsum(mix(value ^ np.uint64(c))))).astype(np.uint64) for c in (0, 0x5851F42D4C957F2D)]
        print_ = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]
        # one carrier of each set: the smallest id of the chunk
        ids = left[id_col].to_numpy()
        carrier = np.zeros(n, dtype=bool)
        live = np.flatnonzero(open_)
        if len(live):
            by = live[np.lexsort((ids[live], size[live], print_[1][live], print_[0][live]))]
            carrier[by[np.concatenate(([True], (np.diff(print_[0][by]) != 0) | (np.diff(print_[1][by]) != 0) | (np.diff(size[by]) != 0)))]] = True
        use = shared & carrier[row]
        r, v, c = row[use], value[use], chunks_with[use]
        order = np.lexsort((v, c, r))
        r, v = r[order], v[order]
        edge = np.searchsorted(r, np.arange(n + 1))
        keys = []
        for i in range(KEYS):
            key = np.zeros(n, dtype=np.uint64)
            has = np.flatnonzero(edge[1:] > edge[:-1])
            if len(has):
                key[has] = np.minimum.reduceat(mix(v ^ np.uint64(0xA0761D6478BD642F * (i + 1) & (2**64 - 1))), edge[has])
            keys.append(key.view(np.int64))
        null = ~carrier
        return pa.table({
            "id": left[id_col],
            "n": pa.array(size, pa.int64()),
            "f1": pa.array(print_[0], mask=~open_),
            "f2": pa.array(print_[1], mask=~open_),
            "shared": _masked(packed(v, edge), null),
            "keys": _masked(pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * n + 1, KEYS, dtype=np.int32)), pa.array(np.stack(keys, axis=1).ravel() if n else np.zeros(0, np.int64))), null),
        })

    schema = "id long, n long, f1 long, f2 long, shared binary, keys array<long>"
    return chunks.groupBy(CHUNK).cogroup(found.groupBy("chunk")).applyInArrow(describe, schema)


def _masked(column: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(~null), column, pa.scalar(None, column.type))


def _block_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v), one fewer than members for each component found inside a block of equal min-hash.

    Sets are range-sorted by key and a hash of the id; a block is what stands together under one key, up to BLOCK_ROWS rows
    or BLOCK_BYTES.  A key with a third of all rows is thus many blocks in many tasks, other ones under each min-hash.
    """
    keyed = sets.select("id", "n", "shared", F.posexplode("keys").alias("k", "key"))
    keyed = keyed.withColumn("salt", F.xxhash64("id", "k")).repartitionByRange("k", "key", "salt").sortWithinPartitions("k", "key", "salt", "id")

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        rows.sort(key=lambda r: r[0])
        ids, sizes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        edges = np.concatenate(([0], np.cumsum([len(r[2]) // 8 for r in rows])))
        label = linked_in_block(np.frombuffer(b"".join(r[2] for r in rows), np.uint64), edges, sizes, percent)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_pydict({"u": pa.array(ids[label[far]], pa.int64()), "v": pa.array(ids[far], pa.int64())}) if len(far) else None

    def multiply(batches):
        block, at, size = [], None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "n", "shared", "k", "key")]
            for i in range(batch.num_rows):
                id_, n, shared, k, key = (c[i].as_py() for c in columns)
                if (k, key) != at or len(block) >= BLOCK_ROWS or size + len(shared) > BLOCK_BYTES:
                    if (found := links(block)) is not None:
                        yield found
                    block, at, size = [], (k, key), 0
                block.append((id_, n, shared))
                size += len(shared)
        if (found := links(block)) is not None:
            yield found

    return keyed.mapInArrow(multiply, "u long, v long")


def _remaining_links(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of the components so far between which there is a link; no link is missed.

    Two linked sets share a shingle among the first n_shared - ceil(percent * n) + 1 of each (any fewer and the
    rest could not hold enough).  Lists of documents by such a shingle are compared between components only; the
    positions in both lists and the sizes bound the overlap, and of what stays the product is taken at these pairs.
    """
    held = F.floor(F.octet_length("shared") / 8)
    least = F.ceil(F.lit(percent) * F.col("n") / 100)

    @F.arrow_udf("array<long>")
    def prefix(shared: pa.Array, length: pa.Array) -> pa.Array:
        v, edge = unpacked(pa.chunked_array([shared]), np.int64)
        take = np.minimum(np.maximum(length.to_numpy(zero_copy_only=False), 0), np.diff(edge))
        at = np.concatenate(([0], np.cumsum(take)))
        pick = np.repeat(edge[:-1] - at[:-1], take) + np.arange(at[-1])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v[pick], pa.int64()))

    rare = sets.select("id", "n", held.alias("held"), prefix("shared", held - least + 1).alias("rare"))
    known = rare.join(labels.withColumnRenamed("node", "id"), "id", "left")
    lists = known.select("id", "n", F.coalesce("component", "id").alias("component"), "held", F.posexplode("rare").alias("at", "h"))
    # of two linked sets, one has at most (1 + 100 / percent) * rest - n shingles if the other has n, `rest` of them from
    # this one on in its list of shared ones: who finds no such partner in a list leaves it
    lists = lists.withColumn("rest", F.col("held") - F.col("at")).withColumn("most", F.floor((F.col("rest") * (100 + percent)) / percent - F.col("n")))
    for _ in range(2):
        others = lists.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("n0"), F.max("most").alias("m1")).filter("c0 < c1")
        # what is left is few, and is read several times from here on
        lists = lists.join(others, "h").filter("n <= m1 and most >= n0").select("h", "component", "id", "n", "rest", "most").checkpoint()
    sides = lists.groupBy("h", "component").agg(F.min("n").alias("n"), F.max("most").alias("most"))
    # a column of many components is dealt to several keys: one factor once to each, the other one to one of them
    hot = sides.groupBy("h").agg(F.floor(F.count(F.lit(1)) / HOT_COLUMN).cast("int").alias("parts")).filter("parts > 0")
    sides = sides.join(hot, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    one = sides.withColumn("part", F.pmod(F.xxhash64("component"), F.col("parts") + 1).cast("int"))
    all_ = sides.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    between = one.alias("a").join(all_.alias("b"), ["h", "part"]).filter("a.component < b.component and a.n <= b.most and b.n <= a.most")
    between = between.select("h", F.col("a.component").alias("ca"), F.col("b.component").alias("cb"))
    a = lists.select("h", F.col("component").alias("ca"), F.col("id").alias("u"), F.col("n").alias("nu"), F.col("rest").alias("ru"))
    b = lists.select("h", F.col("component").alias("cb"), F.col("id").alias("v"), F.col("n").alias("nv"), F.col("rest").alias("rv"))
    enough = F.least("ru", "rv") * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))
    pairs = between.join(a, ["h", "ca"]).join(b, ["h", "cb"]).filter(enough).select("u", "v", "nu", "nv", F.col("ca").alias("cu"), F.col("cb").alias("cv")).distinct()

    @F.arrow_udf("long")
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(products_of_pairs(pa.chunked_array([a]), pa.chunked_array([b])))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shared").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("shared").alias("sv")), "v")
    counted = both.withColumn("o", overlap("su", "sv"))
    return counted.filter(F.col("o") * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))).select(F.col("cu").alias("u"), F.col("cv").alias("v"))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components under Jaccard similarity >= percent / 100 of distinct k-word shingles.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a text of fewer than k words is
    one shingle, a null or empty text has none and links with nothing.  Returns id_col, n_shingles (long) and
    component_id (long: the smallest id that can be reached by links, itself included); ids are distinct integers.
    A row of null id has a null component and links with nothing, a repeated row gets what its id gets.  Ties need no
    order, equal texts are one class, other columns are not read, and an empty table gives an empty result.

    Equal sets are joined by fingerprint.  Blocks of equal min-hash then find most links by a blocked sparse
    product.  For the rest, columns of rare shingles pick the pairs of rows in different components at which the
    product is taken, so every link between components is found.
    """
    total = text_bytes(docs, text_col)
    chunks = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(CHUNK, chunk_key("id", "text", total))
    info = _class_and_sets(chunks, "id", "text", total, k, percent).checkpoint()
    live = info.filter("f1 is not null and id is not null")
    classes = live.groupBy("f1", "f2", "n").agg(F.min("id").alias("first"))
    equal = live.select("id", "f1", "f2", "n", F.col("shared").isNotNull().alias("carries")).join(classes, ["f1", "f2", "n"]).select("id", "first", "carries")
    sets = live.filter("shared is not null").select("id", "n", "shared", "keys")
    links = _block_links(sets, percent).unionByName(equal.filter("carries and id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))).checkpoint()
    labels = components(links).checkpoint()
    # links that blocks missed join components, so the second search is over these alone
    more = components(_remaining_links(sets, labels, percent)).select(F.col("node").alias("component"), F.col("component").alias("further"))
    joined = labels.join(more, "component", "left").select(F.col("node").alias("first"), F.coalesce("further", "component").alias("reached"))
    alone = more.join(labels, more["component"] == labels["node"], "left_anti").select(F.col("component").alias("first"), F.col("further").alias("reached"))
    member_of = equal.join(joined.unionByName(alone), "first", "left").select("id", F.coalesce("reached", "first").alias("component_id")).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = info.select("id", "n").join(member_of, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: shingle count and component of every document."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
