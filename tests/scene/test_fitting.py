"""Least squares and dilation against numpy."""

import numpy as np
import pytest

from splatloom.operators import fitting, masks


def test_solutions_equal_numpy(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(4):
        x = r.normal(size=(40, 3))
        if k == 3:
            x[:, 2] = 0  # no information: its unknown is 0
        y = x @ [1.0, -2.0, 0.5] + r.normal(0, 0.1, 40)
        rows += [(k, *map(float, a), float(b)) for a, b in zip(x, y, strict=True)]
        want[k] = np.linalg.lstsq(x, y, rcond=None)[0]
    table = spark.createDataFrame(rows, "k int, a double, b double, c double, t double")
    from pyspark.sql import functions as F

    for x in fitting.solved(fitting.normal_equations(table, ["k"], [F.col("a"), F.col("b"), F.col("c")], F.col("t")), ["k"], 3).collect():
        assert np.allclose([x["w0"], x["w1"], x["w2"]], want[x["k"]], atol=1e-9)


def _correct(img, ref, rounds, margin):
    """Five rounds of least squares with numpy's solver."""
    free = lambda z: (z >= margin) & (z <= 1 - margin)
    at = img.copy()
    for _ in range(rounds):
        a = np.column_stack([at[:, i] * at[:, j] for i in range(3) for j in range(i, 3)] + [at[:, i] for i in range(3)] + [np.ones(len(at))])
        w = [np.linalg.lstsq(a[m], ref[m, c], rcond=None)[0] for c in range(3) for m in [free(img[:, c]) & free(at[:, c]) & free(ref[:, c])]]
        at = np.clip(a @ np.stack(w, axis=1), 0, 1)
    return at


def test_quadratic_correction_equals_numpy(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for camera in range(2):
        img = np.clip(r.random((200, 3)) * 1.2 - 0.1, 0, 1)
        ref = np.clip(0.8 * img[:, [1, 0, 2]] ** 2 + 0.3 * img + 0.05 + r.normal(0, 0.02, (200, 3)), 0, 1)
        want |= {(camera, i): v for i, v in enumerate(_correct(img, ref, 3, 0.5 / 255))}
        rows += [(camera, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(img, ref, strict=True))]
    image = spark.createDataFrame(rows, "camera_id int, p int, r double, g double, b double, rr double, rg double, rb double")
    got = fitting.quadratic_correction(image, ["r", "g", "b"], ["rr", "rg", "rb"], rounds=3).collect()
    assert len(got) == 400
    for x in got:
        assert np.allclose([x["corrected_r"], x["corrected_g"], x["corrected_b"]], want[x["camera_id"], x["p"]], atol=1e-6)


def test_inverse_polynomials(spark):
    lenses = spark.createDataFrame([(1, 0.0, 1.0, 0.0, -0.05, 0.0, 0.004, 0.0, 1.2), (2, 0.0, 2.0, 0.1, 0.0, 0.0, 0.0, 0.0, 1.0), (3, 0.5, -1.0, 3.0, 0.0, 0.0, 0.0, -1.0, 1.0)], "lens int, " + ", ".join(f"f{k} double" for k in range(6)) + ", low double, high double")
    got = {r["lens"]: r for r in fitting.inverse_polynomials(lenses, "lens").collect()}
    assert got[1]["fits"] and got[2]["fits"] and not got[3]["fits"]
    y = np.polyval([0.004, 0, -0.05, 0, 1.0, 0.0], 0.7)
    assert abs(sum(got[1][f"k{k}"] * y**k for k in range(1, 6)) - 0.7) < 1e-3


@pytest.mark.parametrize("size", [1, 3, 5, 9, 21, 41, 81])
def test_dilation_equals_all_neighbours(spark, size):
    r = np.random.default_rng(size)
    images = [(r.random((7, 23)) < 0.05).astype(float), (r.random((30, 4)) < 0.05) * r.random((30, 4))]
    rows = [(k, x, y, float(v)) for k, im in enumerate(images) for (y, x), v in np.ndenumerate(im)]
    got = masks.dilated(spark.createDataFrame(rows, "camera_id int, x int, y int, mask double"), size).collect()
    assert len(got) == len(rows)
    h = size // 2
    for p in got:
        im = images[p["camera_id"]]
        assert p["mask"] == im[max(0, p["y"] - h) : p["y"] + h + 1, max(0, p["x"] - h) : p["x"] + h + 1].max()


def test_union_of_masks(spark):
    frames = spark.createDataFrame([(0, 1, 1, 0.2), (1, 1, 1, 0.9), (0, 2, 1, None), (1, 3, 1, 7.0)], "camera_id int, x int, y int, mask double")
    assert sorted(map(tuple, masks.union(frames).collect())) == [(1, 1, 0.9), (2, 1, 0.0), (3, 1, 1.0)]
    with pytest.raises(ValueError):
        masks.dilated(frames, 4)
