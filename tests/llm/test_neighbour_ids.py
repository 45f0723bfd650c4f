from __future__ import annotations

import numpy as np

from textloom.llm import neighbours as N


def test_an_id_of_many_rows_takes_one_place():
    rng = np.random.default_rng(4)
    near, far = rng.normal(size=(200, 8)) * 1e-3, 1e-2 + rng.normal(size=(30, 8)) * 1e-3
    x = np.concatenate([np.zeros((1, 8)), near, far]).astype(np.float32)
    ids = np.array([0] + [1] * 200 + list(range(2, 32)))
    index = N.Sorted(x, ids, 32, 3)
    places, _ = index._search(x[0].astype(np.float64), (x[0] @ index.a).astype(np.float64), 0, 10, 16, N.radius_factor(32, 0.5, 0.93), 100.0)
    d = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    want = sorted(range(2, 32), key=lambda i: d[199 + i])[:9]
    assert ids[places].tolist() == [1, *want]
