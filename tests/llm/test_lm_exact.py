"""Next words of one context are told apart however many there are."""

import numpy as np

from newsloom.llm import lm


def model(hot=10**9):
    out = lm.Model(10**6, 1, 2, 2, 3.0, lm.SMOOTHING, True)
    out.hot = hot
    return out


def test_pairs_of_one_key_are_told_apart():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 5000).astype(np.uint64), rng.integers(0, 40, 5000)
    for key in (np.zeros(5000, np.uint64), a, lm._combined(a, b.view(np.uint64))):
        first, at = lm._distinct_pairs(key, a, b)
        assert len(first) == len({*zip(a.tolist(), b.tolist())})
        assert (a[first][at] == a).all() and (b[first][at] == b).all()


def test_a_context_of_many_next_words():
    n = 300_000  # with 32 bits some ten of them would be confused
    rng = np.random.default_rng(2)
    code = rng.permutation(np.arange(n, dtype=np.int64) * 7)
    code = np.concatenate((code, code[: n // 3]))
    context = np.full(len(code), 0x1234567890ABCDEF, np.uint64)
    context[::5] = 0x1234567811111111  # another context with the same upper half
    occ = np.full(len(code), 100, np.int64)
    for hot in (10**9, 10):
        level = lm.Level(np.arange(len(code)), code, context, occ, model(hot))
        assert len(level.order) == len({*zip(context.tolist(), code.tolist())})
        place = level.which[level.first][level.order][level.at]
        assert (code[place] == code).all() and (context[place] == context).all()
    # numbers beyond 32 bits
    level = lm.Level(np.arange(len(code)), code << 20, context, occ, model())
    assert len(level.order) == len({*zip(context.tolist(), code.tolist())})


def test_order_of_numbers():
    """Places by number, equal ones as they come: with room for places beside the numbers, without, and where first bits do not tell numbers apart."""
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 900, 5000), rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 3000, 5000).astype(np.uint64) + np.uint64(2**63 - 1500), np.zeros(0), np.ones(1), np.full(7, 2**64 - 1, np.uint64)):
        x = x.astype(np.uint64)
        order, in_order = lm._order(x)
        assert order.tolist() == x.argsort(kind="stable").tolist() and (in_order == x[order]).all()


def test_arrays_are_squeezed_to_the_bytes_they_need():
    x, y, z = np.arange(3000) * 70_000, np.zeros(5, np.uint16), np.zeros(0, np.int32)
    data = lm._squeezed(x, y, z)
    for got, want in zip(lm._spread(data, (3000, np.int64), (5, np.uint16), (0, np.int32)), (x, y, z), strict=True):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()
    assert [len(v) for v in lm._spread(b"", (0, np.int64), (0, np.uint8))] == [0, 0]


def test_scores_ask_for_no_longer_contexts_than_the_depth(monkeypatch):
    """Scoring took one length of contexts more than there is, for nothing."""
    import pyarrow as pa
    import zstandard

    asked = []
    monkeypatch.setattr(lm.Tokens, "_learn", lambda self, length, replies: None)
    ask = lm.Tokens._ask
    monkeypatch.setattr(lm.Tokens, "_ask", lambda self, length: (asked.append(length), ask(self, length)))
    text = b"a b c a b c a b d"
    chunk = pa.table({"chunk": [0], "ids": [[1]], "train": pa.array([b"\x01"], pa.binary()), "sizes": pa.array([np.array([len(text)], np.int64).tobytes()], pa.binary()), "text": pa.array([zstandard.compress(text)], pa.binary())})
    first = lm.Tokens(chunk, None, 0, model()).sent(0, 0)
    answers = lm._answer_words(first).append_column("n", pa.array([10])).append_column("v", pa.array([5]))
    scored = lm.Tokens(chunk, answers, 3, model())
    assert asked == [1, 2] and scored.trained == 10
    level = scored.levels[1]  # numbers rise inside a context
    for i, j in zip(level.edge[:-1], level.edge[1:], strict=True):
        run = level.runs(i, j)
        last = scored.code[level.which[level.first][level.order[i:j]]]
        assert all((np.diff(last[a - i : b - i]) > 0).all() for a, b in zip(run[:-1], run[1:], strict=True))
