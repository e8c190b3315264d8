"""Cover trees in many dimensions: few children, and few pairs of rows evaluated where rows lie in clusters."""

import numpy as np
import pytest

from newsloom.llm import topk


def clustered(rng, n, clusters=40, dim=64, spread=4.0):
    centres = rng.normal(size=(clusters, dim)) * 32
    return np.floor(centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread)


@pytest.mark.parametrize("near", [True, False])
def test_tree_of_many_dimensions(near):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000) if near else np.floor(rng.normal(size=(3000, 64)) * 32)
    depth, sizes = 0, []

    def check(node, at):
        nonlocal depth
        depth = max(depth, at)
        away = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
        assert (away(x[node.rows], node.center) <= 2.0**node.level * (1 + 1e-9)).all()
        if not node.children:
            sizes.append(len(node.rows))
            return
        assert 2 <= len(node.children) <= topk.FANOUT
        centres = np.array([c.center for c in node.children])
        apart = away(centres[:, None, :], centres[None, :, :])
        assert apart[np.triu_indices(len(centres), 1)].min() >= 2.0 ** (node.level - 1) * (1 - 1e-9)
        assert all(c.radius <= 2.0 ** (node.level - 1) * (1 + 1e-9) for c in node.children)
        assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
        for c in node.children:
            check(c, at + 1)

    check(topk.Node(x, np.arange(len(x))), 0)
    assert depth <= 40 and sum(sizes) == 3000 and np.mean(sizes) > 2


def test_few_pairs_are_evaluated_among_clusters(monkeypatch):
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000)
    q = x[::20]
    evaluated = [0]
    scores = topk.Search._scores

    def counted(self, rows, cols):
        evaluated[0] += len(rows) * len(cols)
        scores(self, rows, cols)

    monkeypatch.setattr(topk.Search, "_scores", counted)
    s = topk.Search(q, np.arange(0, 4000, 20), np.full(len(q), -np.inf), x, np.arange(4000), 5)
    s.run(np.zeros(len(q), np.int64))
    products = q @ x.T
    products[np.arange(len(q)), np.arange(0, 4000, 20)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(4000), products.shape), -products), axis=1)[:, :5]
    assert (s.found == want).all()
    assert evaluated[0] < 0.5 * len(q) * len(x)
