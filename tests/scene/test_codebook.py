"""Codebooks: nearest centroids with pruning, medians, falling costs, and the way back."""

import numpy as np
import pytest

from splatloom.operators import codebook as B


def test_nearest_equals_all_distances():
    r = np.random.default_rng(5)
    for n, k, d in ((700, 900, 7), (3, 1, 2), (400, 600, 1)):
        x, c = r.integers(0, 60, (n, d)), r.integers(0, 60, (k, d))
        far = np.abs(x[:, None] - c[None]).sum(-1)
        label, best = B.nearest(x, c)
        assert (label == far.argmin(1)).all() and (best == far.min(1)).all()


def test_codebook_equals_a_loop_and_costs_fall(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(m, 0.3, (150, 5)) for m in (-2, 0, 3)] + [np.ones((200, 5))])
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "gaussian_id long, v array<double>")
    book = B.codebook(rows, 20, 4)
    assert book.costs == sorted(book.costs, reverse=True) and book.costs[-1] < book.costs[0] and len(book.costs) == 5
    got = {z["key"]: (z["label"], z["distance"]) for z in book.labels.collect()}
    import hashlib

    levels = np.rint((x - x.min()) / (x.max() - x.min()) * 4095).astype(int)
    c = levels[sorted(range(len(x)), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:20]]
    for k in range(5):
        far = np.abs(levels[:, None] - c[None]).sum(-1)
        label = far.argmin(1)
        if k < 4:
            c = np.array([np.sort(levels[label == j], axis=0)[((label == j).sum() + 1) // 2 - 1] if (label == j).any() else c[j] for j in range(20)])
    assert [got[i] for i in range(len(x))] == [(int(a), int(far[i, a])) for i, a in enumerate(label)]
    back = {z["gaussian_id"]: z["v"] for z in B.decoded(book).collect()}
    centre = c / 4095 * (x.max() - x.min()) + x.min()
    step = (book.grid.high - book.grid.low) / book.grid.top
    assert all(np.abs(np.array(back[i]) - centre[label[i]]).max() <= step / 2 + 1e-9 for i in range(len(x)))


def test_codebook_of_few_and_awkward_vectors(spark):
    schema = "gaussian_id long, v array<double>"
    rows = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, None)], schema)
    book = B.codebook(rows, 10, 1)
    assert sorted((z["gaussian_id"], z["v"]) for z in B.decoded(book).collect()) == [(1, [1.0, 1.0]), (2, [1.0, 1.0])] and book.costs == [0, 0]
    assert B.decoded(B.codebook(rows.where("false"), 10, 1)).count() == 0
    with pytest.raises(ValueError):
        B.codebook(rows, 1 << 17)
