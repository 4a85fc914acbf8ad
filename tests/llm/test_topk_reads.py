"""How far the lists are read, and scores against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from rerunlab.llm import topk


def best(values, ids, q, own, k):
    scores, other = values @ q, ids != own
    order = np.lexsort((ids[other], -scores[other]))[:k]
    return ids[other][order], scores[other][order]


@pytest.mark.parametrize("n", [0, 1, 5, 30, 41, 700])
def test_blocks_of_every_size_are_read(n):
    rng = np.random.default_rng(n)
    values, ids = rng.integers(-5, 6, (n, 7)).astype(float), rng.integers(0, max(n, 1), n)
    if not n:
        return
    lists = topk.Lists(values, ids)
    queries, own = np.concatenate([values, np.zeros((1, 7)), values[:1]]), np.concatenate([ids, [-1, -1]])
    for q, o, got in zip(queries, own, lists.top(queries, own, 10), strict=True):
        want = best(values, ids, q, o, 10)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_clustered_vectors_stop_early(monkeypatch):
    """Ten vectors that stand out in every dimension are settled by the heads of the lists."""
    monkeypatch.setattr(topk, "STRETCHES", 40)
    rng = np.random.default_rng(1)
    values = np.floor(rng.normal(0, 20, (4000, 16)))
    near = rng.choice(4000, 12, replace=False)
    values[near] += 500
    ids = np.arange(4000)
    q = np.full(16, 300.0)
    for sign in (1, -1):
        lists = topk.Lists(sign * values, ids)
        ((found, scores, read),), want = lists.top(sign * q[None], np.array([-1]), 10), best(values, ids, q, -1, 10)
        assert np.array_equal(found, want[0]) and np.array_equal(scores, want[1])
        assert read <= len(values) / 20
