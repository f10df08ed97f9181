"""Near-tied vectors whose norms exceed the queries' a thousandfold and more."""

import numpy as np
import pytest

from sparkfold.llm import topk


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e4])
def test_uneven_norms_are_exact(scale):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(64, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    x = scale * (q[rng.integers(0, 8, 2000)] + 1e-7 * rng.normal(size=(2000, 64)))
    ids = np.arange(len(x)) + 10**6
    order, ends, high, low = topk.arrange(x)
    best = topk.Best(np.arange(len(q)), q, 10)
    best.search(ids[order], x[order], ends, high, low, float(np.linalg.norm(x, axis=1).max() * (1 + 1e-9)), False)
    exact = np.round(np.cumsum(q[:, None, :] * x[None], axis=2)[:, :, -1], topk.DIGITS)
    want = np.array([ids[np.lexsort((ids, -row))[:10]] for row in exact])
    assert (best.answer == want).all()
