import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from newsloom.llm import chat, codes, whitening
from newsloom.llm.bpe import VOCABULARY

TURNS = "conv_id long, turn long, role string, text string"
VECTOR = "vec_id long, embedding array<float>, label int"
PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def turns():
    """Conversations that share starts of every length, end inside others, repeat, and hold every awkward text."""
    rng = random.Random(4)
    texts = ["hi", "", None, "### user: </turn>\n", "\\", "\\b\\h\\l", "####", "<turn>", "été 😀 — a: b", "x " * 3000, chat.PLANTED_TEXT]
    out, known = [], [[]]
    for conv in range(120):
        path = list(rng.choice(known))[: rng.randint(0, 6)]
        for _ in range(rng.randint(1, 4)):
            path.append((rng.choice(["user", "assistant", "system"]), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}"))
        known.append(path)
        out += [(conv, i, r, t) for i, (r, t) in enumerate(path)]
    deep = [("assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    for conv, cut in ((200, 300), (201, 150), (202, 299), (203, 1)):
        out += [(conv, i, r, t) for i, (r, t) in enumerate(deep[:cut])]
    out += [(204, i, r, t) for i, (r, t) in enumerate([*deep[:40], ("user", "leaves")])]
    out += [(conv, i, r, t) for conv in range(300, 340) for i, (r, t) in enumerate(deep[:3])]  # copies
    out += [(400, None, "user", "no turn"), (400, 0, None, "no role"), (400, 1, "a: b<#\\:", "odd role"), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    out += [(401, 0, "user", "twice"), (401, 0, "user", "twice"), (402, 5, "user", "twice"), (402, 9, "user", "twice"), (403, -1, "assistant", "x")]
    return out


def by_conversation(turns):
    out = {}
    for conv, turn, role, text in turns:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for _, _, r, t in sorted(v)] for k, v in out.items()}


def formatted(role, text):
    coded = lambda s, more="": "".join({"\\": "\\b", "#": "\\h", "<": "\\l", **({":": "\\c"} if more else {})}.get(c, c) for c in s)
    return f"### {coded(role, ':')}: ", coded(text), "</turn>\n"


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("pack_chars", [60, 2000, chat.PACK_CHARS])
def test_chat_trees(spark, turns, encoder, pack_chars):
    df = spark.createDataFrame(turns, TURNS).repartition(5).withColumn("pack", F.lit("clash")).withColumn("hash", F.lit(1))
    nodes, members = chat.chat_trees(df, PATH, pack_chars=pack_chars)
    convs = by_conversation(turns)
    leaf = {bytes(r.leaf): r.conv_id for r in members.collect()}
    leaves = {}
    for r in members.collect():
        leaves.setdefault(bytes(r.leaf), []).append(r.conv_id)
    assert all(len({tuple(convs[c]) for c in same}) == 1 for same in leaves.values()) and sorted(map(str, sum(leaves.values(), []))) == sorted(map(str, convs))
    packs = {}
    for r in nodes.collect():
        packs.setdefault(r.pack, []).append(r)
    ended = []
    for rows in packs.values():
        rows.sort(key=lambda r: r.node)
        assert [r.node for r in rows] == list(range(len(rows)))
        stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
        assert [r.start for r in rows] == [sum(len(x.ids) // 4 for x in rows[:i]) for i in range(len(rows))]
        paths = {}
        for r in rows:
            path = (*paths.get(r.parent, ()), bytes(r.ids))
            assert path not in paths.values()  # a shared turn is there once
            paths[r.node] = path
            before = np.concatenate([stream[a.start : a.stop] for a in r.ancestors]) if r.ancestors else np.zeros(0, "<u4")
            assert before.astype("<u4").tobytes() == b"".join(path[:-1]) and r.position == len(before) and r.depth == len(path) - 1
            assert all(a.stop < b.start for a, b in zip(r.ancestors, r.ancestors[1:])) and rows[r.tree].parent is None
            if r.ends is not None:
                turns_of = convs[leaf[bytes(r.ends)]]
                want = [[encoder.encode_ordinary(p) for p in formatted(role, text)] for role, text in turns_of]
                assert b"".join(path) == np.array([t for turn in want for part in turn for t in part], "<u4").tobytes()
                last = want[-1]
                assert (r.loss_from, r.loss_to) == ((len(last[0]), len(last[0]) + len(last[1])) if turns_of[-1][0] == "assistant" else (0, 0))
                ended.append(bytes(r.ends))
    assert sorted(ended) == sorted(leaves)
    if pack_chars == chat.PACK_CHARS:
        assert sum(len(rows) for rows in packs.values()) < sum(len(v) for v in convs.values()) / 2
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for got in (chat.read_back(nodes, PATH, in_order=True), chat.read_back(nodes.repartition(3), PATH)):
        got = {bytes(r.ends): tuple(r)[1:] for r in got.collect()}
        assert set(got) == set(leaves)
        for ends, row in got.items():
            turns_of = convs[leaf[ends]]
            loss = "".join(t for r, t in turns_of if r == "assistant")
            assert row == (len(turns_of), sha("".join(f"{r}\n{t}\n" for r, t in turns_of)), len(loss), sha(loss), sum(len(p) for turn in turns_of for p in formatted(*turn)))


def test_chat_of_empty_table(spark):
    nodes, members = chat.chat_trees(spark.createDataFrame([], TURNS), PATH)
    assert nodes.count() == 0 and members.count() == 0 and chat.read_back(nodes, PATH).count() == 0


def test_depths_kept_are_those_that_later_conversations_go_back_to():
    rng = random.Random(2)
    for _ in range(200):
        common = [0] + [rng.randint(0, 5) for _ in range(rng.randint(0, 9))]
        kept = chat._kept_depths(common)
        for j, depth in enumerate(common):
            if depth:
                i = max(i for i in range(j) if common[i] < depth)  # emitted the node at that depth
                assert depth in kept[i]
        assert sum(map(len, kept)) <= len(common)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 24)) * rng.uniform(0.05, 0.6, size=24)
    x = [base[i % 12] + rng.normal(size=24) * 0.2 for i in range(400)] + [base[0]] * 60 + [np.zeros(24)]
    out = [(1000 - i, [float(np.float32(c)) for c in v], None if i % 29 == 5 else i % 4) for i, v in enumerate(x)]
    out += [out[7], out[7], (None, out[3][1], 2)]
    return out + [(5000, None, 1), (5001, [1.0] * 23 + [None], 1), (5002, [float("nan")] * 24, 1), (5003, [float("inf")] + [1.0] * 23, 1), (5004, [], 1), (5005, [1.0], 1)]


def usable(v):
    return v is not None and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v)


def lloyd(rows, parts, entries, rounds):
    """Plain rounds over exact integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)
    x = [[int(np.floor(4096 * c)) for c in v] + [0] * (width * parts - len(v)) for _, v, _ in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        code = [[near(v, p)[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(x, code) if c[p] == i]
                if own:
                    books[p][i] = [sum(col) // len(own) for col in zip(*own)]
    best = [[near(v, p) for p in range(parts)] for v in x]
    total = {}
    for (_, _, label), b in zip(rows, best):
        total[label] = total.get(label, 0) + sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), total[label], digest) for (i, _, label), b in zip(rows, best))


@pytest.mark.parametrize("parts, entries, rounds, lineage", [(8, 16, 6, 8), (5, 7, 3, 2), (3, 16, 0, 8)])
def test_vector_codes(spark, vectors, monkeypatch, parts, entries, rounds, lineage):
    monkeypatch.setattr(codes, "LINEAGE", lineage)
    df = spark.createDataFrame(vectors, VECTOR).repartition(4).withColumn("code", F.lit("clash")).withColumn("error", F.lit(0))
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(df, parts=parts, entries=entries, rounds=rounds).collect())
    assert got == lloyd([r for r in vectors if usable(r[1])], parts, entries, rounds)


def test_vector_codes_of_few_large_and_no_rows(spark, vectors):
    few = [r for r in vectors if usable(r[1])][:5]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(spark.createDataFrame(few, VECTOR)).collect()) == lloyd(few, 8, 16, 6)
    large = [(i, [float(c) * 3.0e8 for c in v], label) for i, v, label in few * 5]  # products beyond 2**53
    frame = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    want = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, d) for i, c, e, t, d in lloyd(large, 4, 3, 3)]
    got = codes.compressed(frame, parts=4, entries=3, rounds=3).collect()
    assert sorted(str((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == sorted(map(str, want))
    assert codes.compressed(spark.createDataFrame([], VECTOR)).count() == 0
    assert codes.compressed(spark.createDataFrame(vectors, VECTOR).filter("vec_id = 5000")).count() == 0


def test_rounds_send_only_what_changed(spark, vectors):
    """A state whose assignments are those of the codebooks sends nothing."""
    live = spark.createDataFrame(vectors, VECTOR).filter(F.col("vec_id") < 2000).filter(F.size("embedding") == 24).select(F.col("embedding").alias("vector"))
    first = [list(r.vector) for r in live.limit(16).collect()]
    books = codes.fit(live, first, 24, 4.0, 8, 2)
    once = live.select("vector", F.lit(None).cast("binary").alias("code")).mapInArrow(codes._next_state(books), "vector array<float>, code binary, was binary")
    again = once.select("vector", "code").mapInArrow(codes._next_state(books), "vector array<float>, code binary, was binary")
    kinds = "part int, entry int, place int, value decimal(38,0)"
    assert once.mapInArrow(codes._changes(books), kinds).filter("place = -1").agg(F.sum("value")).first()[0] == 8 * live.count()
    assert again.mapInArrow(codes._changes(books), kinds).count() == 0


def check_whitening(rows, got, components=16):
    live = [(i, v) for i, v, _ in rows if usable(v)]
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in live], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    value, axes = np.linalg.eigh(v)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    assert len(got) == len(live) * components
    by_row = {}
    for r in got:
        by_row.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r)
    far = ((n * x - s) ** 2).sum(axis=1)
    assert {k for k in by_row} == {(str(i), int(d)) for (i, _), d in zip(live, far)}
    white = ((n * x - s) / n) @ (axes / np.sqrt(value))
    signs = {}
    for (i, _), d, w in zip(live, far, white):
        for c in range(components):
            for r in by_row[str(i), int(d)][c + 1]:
                assert abs(abs(r.whitened) - abs(w[c])) < 1e-7 and r.n == n
                assert abs(r.explained - value[c] / np.trace(v)) <= 1e-6 * r.explained
                if abs(w[c]) > 1e-6:
                    signs.setdefault(c, set()).add(np.sign(r.whitened) * np.sign(w[c]))
    assert all(len(s) == 1 for s in signs.values())
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening(spark, vectors):
    df = spark.createDataFrame(vectors, VECTOR).repartition(4).withColumn("x", F.lit("clash")).withColumn("n", F.lit(0))
    check_whitening(vectors, whitening.whitened(df).collect())
    check_whitening(vectors, whitening.whitened(df, components=3).collect(), 3)


def test_whitening_with_wide_integers(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "LARGEST", 1)
    check_whitening(vectors, whitening.whitened(spark.createDataFrame(vectors, VECTOR)).collect())


def test_whitening_without_spread(spark):
    same = [(i, [1.0, 2.0, 3.0], 1) for i in range(5)]
    assert whitening.whitened(spark.createDataFrame(same, VECTOR)).count() == 0
    line = [(i, [float(i), 2.0, 3.0], 1) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(line, VECTOR)).collect()
    assert {r.component for r in got} == {1} and len(got) == 5 and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9
    assert whitening.whitened(spark.createDataFrame([], VECTOR)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], VECTOR)).count() == 0
