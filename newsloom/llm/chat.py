"""Operator 11: chat formatting as packed prefix trees.

Conversations that start with the same turns share them.  Distinct conversations are range-sorted by the hashes of their turns,
which is depth-first order, and cut into packs of bounded size; inside a pack each turn that several of them share is one node,
emitted once, with the position of its first token on its path and the token intervals of its ancestors to attend to.
A tree larger than a pack goes on in the next one, which starts with the shared turns again, as attention cannot leave a
sequence.  Only hashes and sizes of turns are sorted; texts are shuffled to their conversation's pack once it is known.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, _decoded, _packed_ids, read_vocabulary

PACK_CHARS = 1 << 18
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
# Each character on the left never stands inside an escaped text, so neither does a control string; backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED = "assistant"
TURN_CHARS = len(HEAD + MIDDLE + END)

NODES = (
    "pack long, node int, parent int, tree int, depth int, ids binary, loss_from int, loss_to int, start long, position long, "
    "ancestors array<struct<start:long,stop:long>>, shared boolean, ends binary"
)
DIGESTS = "ends binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _escaped(column: pa.Array, rules) -> pa.Array:
    for plain, code in rules:
        column = pc.replace_substring(column, plain, code)
    return column


def _unescaped(text: str, rules) -> str:
    for plain, code in reversed(rules):
        text = text.replace(code, plain)
    return text


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text as empty strings."""
    named = {"role": F.coalesce(F.col(role_col), F.lit("")), "text": F.coalesce(F.col(text_col), F.lit(""))}
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *[x.alias(c) for c, x in named.items()])


def _hash() -> Column:
    """128 bits of role and text, as 32 digits; computed where it is needed rather than sent along with texts."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.substring(F.sha2(whole, 256), 1, 32)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes, leaf): the hashes of a conversation's turns in order as one string, the characters of each, and the
    hash of the path.  A conversation takes about 100 bytes a turn here, whatever its texts."""
    size = (F.char_length("role") + F.char_length("text") + F.lit(TURN_CHARS)).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", _hash().alias("hash"), size.alias("size"))))
    out = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    out = out.select("conv_id", F.array_join("turns.hash", "").alias("path"), F.col("turns.size").alias("sizes"))
    return out.withColumn("leaf", F.unhex(F.substring(F.sha2("path", 256), 1, 32)))


def _common(a: str, b: str) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b)) // 32
    x, y = (np.frombuffer(s[: n * 32].encode(), "<u8").reshape(n, 4) for s in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def _kept_depths(common: list[int]) -> list[list[int]]:
    """For each conversation of a pack, the depths to which a later one goes back and that it reached first."""
    out: list[list[int]] = [[] for _ in common]
    ahead: list[int] = []  # rising depths at which later conversations leave the current path
    for i in range(len(common) - 1, -1, -1):
        if i + 1 < len(common):
            while ahead and ahead[-1] >= common[i + 1]:
                ahead.pop()
            if common[i + 1]:
                ahead.append(common[i + 1])
        for depth in reversed(ahead):
            if depth <= common[i]:
                break
            out[i].append(depth)
    return out


def _cut_to_packs(pack_chars: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pack: list[tuple] = []  # conversations of the open pack, bounded by its size
        filled, before = 0, ""

        def closed() -> pa.RecordBatch:
            keep = _kept_depths([p[2] for p in pack])
            columns = [[p[0] for p in pack], [p[1] for p in pack], [number] * len(pack), range(len(pack)), [p[2] for p in pack], keep, [p[3] for p in pack]]
            kinds = (types[0], pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "leaf", "pack", "place", "common", "keep", "turns"])

        for batch in batches:
            types = [batch["conv_id"].type]
            for conv, leaf, path, sizes in zip(*(batch[c].to_pylist() for c in ("conv_id", "leaf", "path", "sizes")), strict=True):
                common = _common(before, path) if pack else 0
                new = sum(sizes[common:])
                if pack and filled + new > pack_chars:
                    yield closed()
                    number, pack, filled, common, new = number + 1, [], 0, 0, sum(sizes)
                pack.append((conv, leaf, common, len(sizes)))
                filled, before = filled + new, path
        if pack:
            yield closed()

    return step


def _nodes(raw: bytes):
    """Nodes of turns that come by pack, place in it and turn."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = place = None
        stops, indexes = array("q"), array("i")  # of the current path: last token + 1 and node, by depth
        tree = seq = node = filled = position = 0
        spans: list[list[int]] = []  # token intervals of the current path
        for batch in batches:
            head = [batch[c].to_pylist() for c in ("pack", "place", "common", "turns", "leaf", "keep")]
            new, about = [], []
            for i, (p, w, common, turns, leaf, keep) in enumerate(zip(*head, strict=True)):
                if (p, w) != (pack_seen := pack, place):
                    seq = 0
                    pack, place = p, w
                if seq >= common:
                    new.append(i)
                    about.append((p, p != pack_seen, seq, common, leaf if seq == turns - 1 else None, seq + 1 in keep))
                seq += 1
            rows = pa.array(new, pa.int64())
            role, text = batch["role"].take(rows), batch["text"].take(rows)
            n = len(new)
            starts = pc.binary_join_element_wise(HEAD, _escaped(role, ROLE_ESCAPES), MIDDLE, "")
            parts = pa.concat_arrays([starts, _escaped(text, ESCAPES), pa.array([END] * n, pa.string())])
            packed = _packed_ids(parts.take(pa.array(np.arange(3 * n).reshape(3, n).T.ravel())), raw)  # tokens never cross the edges of a text
            edges = np.frombuffer(packed.buffers()[1], np.int32)[: 3 * n + 1] // 4
            learned = pc.equal(role, LEARNED).to_pylist()
            out: list[tuple] = []
            for k, (p, fresh, depth, common, leaf, again) in enumerate(about):
                first, low, high, last = (int(e) for e in edges[3 * k : 3 * k + 4])
                if fresh:
                    node, filled, spans, stops, indexes = 0, 0, [], array("q"), array("i")
                if depth == common and len(stops) > depth:  # back to where this conversation leaves the path
                    del stops[depth:], indexes[depth:]
                    stop = stops[-1] if depth else 0
                    spans = [[a, min(b, stop)] for a, b in spans if a < stop]
                    position = sum(b - a for a, b in spans)
                elif fresh:
                    position = 0
                tree = node if depth == 0 else tree
                size = last - first
                loss = (low - first, high - first) if learned[k] else (0, 0)
                out.append((p, node, indexes[-1] if depth else None, tree, depth, *loss, filled, position, [{"start": a, "stop": b} for a, b in spans], again, leaf))
                if spans and spans[-1][1] == filled:
                    spans[-1][1] += size
                else:
                    spans.append([filled, filled + size])
                filled, position = filled + size, position + size
                stops.append(filled)
                indexes.append(node)
                node += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.bool_(), pa.binary())
            columns = [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)]
            ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges[::3] * 4).astype(np.int32)), packed.buffers()[2]])
            names = ["pack", "node", "parent", "tree", "depth", "ids", "loss_from", "loss_to", "start", "position", "ancestors", "shared", "ends"]
            yield pa.RecordBatch.from_arrays([*columns[:5], ids, *columns[5:]], names)

    return step


def chat_trees(
    rows: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = PACK_CHARS
) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of all conversations.

    A turn is formatted as "### role: text</turn>" and a line feed, in which backslash, # and < of role and text (and : of the role) are
    written as a backslash and a letter, so that no text holds a control string and reading back is exact.  Token ids are
    those of the ranks in `vocabulary`, role, text and end encoded apart, so that the loss mask ends where an assistant's text ends.

    nodes: pack (one training sequence of about `pack_chars` characters, more only for a conversation that is longer alone),
    node (its number in the pack, depth first), parent, tree (number of the root), depth (turn), ids (binary, little-endian
    unsigned 32-bit), loss_from and loss_to (tokens of this node under the loss mask), start (first token in the pack), position (position id of
    the first token, counted along the path), ancestors (intervals of the pack's tokens to attend to, besides the node's own up to each token;
    adjacent ones merged), shared (a later node that does not follow directly continues it), ends (leaf of the conversations that end here).
    members: conv_id and leaf; conversations of equal turns have the same leaf and one path.

    A conversation's rows go by turn (null first), then role, then the hash of role and text; repeated rows are turns each; a null role or
    text is empty; rows without conv_id form one conversation; other columns do not matter; an empty table gives no rows.
    Nothing but hashes and sizes (about 100 bytes a turn) of one conversation is ever held together: the texts of
    a very long one pass through its task row by row.  Rows come sorted by (pack, node) inside each partition.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    # packs must not change when a task is repeated, as ranges are cut by samples: both tables are written
    hashed = paths(turns).checkpoint()
    kind = hashed.schema["conv_id"].dataType.simpleString()
    distinct = hashed.groupBy("leaf").agg(F.min(F.struct("conv_id", "path", "sizes")).alias("one")).select("leaf", "one.*")
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    packs = ordered.mapInArrow(_cut_to_packs(pack_chars), f"conv_id {kind}, leaf binary, pack long, place int, common int, keep array<int>, turns int").checkpoint()
    texts = turns.join(packs.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv", "conv_id")
    texts = texts.repartition("pack").withColumn("hash", _hash()).sortWithinPartitions("pack", "place", "turn", "role", "hash")
    nodes = texts.select("pack", "place", "common", "turns", "leaf", "keep", "role", "text").mapInArrow(_nodes(read_vocabulary(vocabulary)), NODES)
    return nodes, hashed.select("conv_id", "leaf")


class _Path:
    """Running digests of the turns from a root to a node."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def copy(self) -> _Path:
        out = _Path()
        out.turns, out.loss = self.turns.copy(), self.loss.copy()
        out.n_turns, out.loss_chars, out.chars = self.n_turns, self.loss_chars, self.chars
        return out

    def add(self, formatted: str, learned: str) -> None:
        role, _, text = formatted.removeprefix(HEAD).removesuffix(END).partition(MIDDLE)
        self.turns.update(f"{_unescaped(role, ROLE_ESCAPES)}\n{_unescaped(text, ESCAPES)}\n".encode())
        masked = _unescaped(learned, ESCAPES)
        self.loss.update(masked.encode())
        self.n_turns += 1
        self.loss_chars += len(masked)
        self.chars += len(formatted)


def _slice_ids(ids: pa.Array, low: np.ndarray, high: np.ndarray) -> pa.Array:
    return pa.array([x[4 * a : 4 * b] for x, a, b in zip(ids.to_pylist(), low, high, strict=True)], pa.binary())


def _read(raw: bytes):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, path, open_paths = None, _Path(), []  # (depth, digests) of the current path's nodes that are continued later
        for batch in batches:
            whole = _decoded(batch["ids"], raw).to_pylist()
            masked = _decoded(_slice_ids(batch["ids"], batch["loss_from"].to_numpy(), batch["loss_to"].to_numpy()), raw).to_pylist()
            out: list[tuple] = []
            columns = (batch[c].to_pylist() for c in ("pack", "node", "parent", "depth", "shared", "ends"))
            for text, learned, p, node, parent, depth, shared, ends in zip(whole, masked, *columns, strict=True):
                if p != pack:
                    pack, open_paths = p, []
                if parent is None:
                    path, open_paths = _Path(), []
                elif parent != node - 1:
                    while open_paths[-1][0] >= depth:
                        open_paths.pop()
                    path = open_paths[-1][1].copy()
                path.add(text.decode("utf-8", "surrogatepass"), learned.decode("utf-8", "surrogatepass"))
                if shared:
                    open_paths.append((depth, path.copy()))
                if ends is not None:
                    out.append((ends, path.n_turns, path.turns.hexdigest(), path.loss_chars, path.loss.hexdigest(), path.chars))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], k) for c, k in enumerate(kinds)], ["ends", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return step


def read_back(nodes: DataFrame, vocabulary: str, in_order: bool = False) -> DataFrame:
    """(ends, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each distinct conversation, from the ids of its path.

    Texts are decoded and unescaped; what is under the loss mask is decoded by itself.  The digests of a node that several paths share are taken once.
    in_order says that `nodes` comes as chat_trees() makes it; a table that was written and read again is sorted first.
    """
    if not in_order:
        nodes = nodes.repartition("pack").sortWithinPartitions("pack", "node")
    return nodes.mapInArrow(_read(read_vocabulary(vocabulary)), DIGESTS)


PLANTED = ("user", "assistant")
PLANTED_TEXT = r"\### Assistant: </turn> ok"


def with_planted(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """`rows` and conversation -7, whose texts look like control strings."""
    role: Column = F.when(F.col("id") == 0, PLANTED[0]).otherwise(PLANTED[1])
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """Query of the contract: every conversation read back from the packs."""
    rows = with_planted(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    vocabulary = public_tokenizers.path(VOCABULARY)
    nodes, members = chat_trees(rows, vocabulary)
    out = members.join(read_back(nodes, vocabulary, in_order=True), F.col("leaf") == F.col("ends"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _op11_sql() -> str:
    text, role = "t.text", "t.role"
    coded = lambda column, characters: f"length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, '{c}', '')))" for c in characters)
    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, '{PLANTED[0]}', '{PLANTED_TEXT}' UNION ALL SELECT -7, 1, '{PLANTED[1]}', '{PLANTED_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({TURN_CHARS} + {coded(role, [p for p, _ in ROLE_ESCAPES])} + {coded(text, [p for p, _ in ESCAPES])}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


OP11_SQL = _op11_sql()
