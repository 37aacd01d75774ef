"""Slopes of the projection against finite differences of a plain projection."""

import numpy as np
import pytest

from splatloom.operators import backward as B
from splatloom.operators.project import project

FX, FY, CX, CY, W, H = 60.0, 55.0, 31.0, 25.0, 64, 48


def _forward(g, c, model):
    """(mean x, mean y, conic a, b, c, depth) of a primitive (m, q, s) in a camera (R, t), all in one array each."""
    m, q, s, view, t = g[:3], g[3:7] / np.linalg.norm(g[3:7]), g[7:], c[:9].reshape(3, 3), c[9:]
    w, x, y, z = q
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    p = view @ m + t
    if model == "ortho":
        mean, jac = (FX * p[0] + CX, FY * p[1] + CY), np.array([[FX, 0, 0], [0, FY, 0]])
    else:
        tx = p[2] * min((W - CX) / FX + 0.15 * W / FX, max(-(CX / FX + 0.15 * W / FX), p[0] / p[2]))
        ty = p[2] * min((H - CY) / FY + 0.15 * H / FY, max(-(CY / FY + 0.15 * H / FY), p[1] / p[2]))
        mean, jac = (FX * p[0] / p[2] + CX, FY * p[1] / p[2] + CY), np.array([[FX / p[2], 0, -FX * tx / p[2] ** 2], [0, FY / p[2], -FY * ty / p[2] ** 2]])
    body = jac @ view @ turn @ np.diag(s)
    inverse = np.linalg.inv(body @ body.T + 0.3 * np.eye(2))
    return np.array([*mean, inverse[0, 0], inverse[0, 1], inverse[1, 1], p[2]])


@pytest.mark.parametrize("model", ["pinhole", "ortho"])
def test_slopes_equal_finite_differences(spark, model):
    r = np.random.default_rng(8)
    near = 1.0 if model == "pinhole" else 0.05
    scene = {i: np.concatenate([r.normal(0, 1.2, 2) * near, [r.uniform(2, 6)], r.normal(size=4), r.uniform(0.02, 0.5, 3)]) for i in range(12)}
    scene[0][:3] = [5.0, -4.0, 2.5]  # outside the widened view
    poses = {}
    for k in range(3):
        a = 0.2 * r.normal(size=3)
        cross = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
        poses[k] = np.concatenate([(np.eye(3) + cross + cross @ cross / 2).ravel(), r.normal(0, 0.2, 3)])
    weight = {(k, i): r.normal(size=6) * [1, 1, 20, 20, 20, 1] for k in poses for i in scene}
    gaussians = spark.createDataFrame([(i, *map(float, v)) for i, v in scene.items()], "gaussian_id long, " + ", ".join(f"{c} double" for c in (*B.CENTRE, *B.TURN, *B.SIZE)))
    cameras = spark.createDataFrame([(k, *map(float, v), FX, FY, CX, CY, W, H) for k, v in poses.items()], "camera_id int, " + ", ".join(f"{c} double" for c in (*B.POSE, "fx", "fy", "cx", "cy")) + ", width int, height int")
    slopes = spark.createDataFrame([(*key, *map(float, v)) for key, v in weight.items()] + [(0, 999, *[1.0] * 6)], "camera_id int, gaussian_id long, " + ", ".join(f"{c} double" for c in B.SLOPES))
    rows = B.projection_slopes(slopes, gaussians, cameras, model).cache()
    loss = lambda key, g, c: float(weight[key] @ _forward(g, c, model))

    def numeric(value, of):
        out = []
        for j in range(len(value)):
            step = np.zeros(len(value))
            step[j] = 1e-6
            out.append((of(value + step) - of(value - step)) / 2e-6)
        return np.array(out)

    for x in B.to_primitives(rows).collect():
        i = x["gaussian_id"]
        want = numeric(scene[i], lambda v, i=i: sum(loss((k, i), v, c) for k, c in poses.items()))
        got = np.array([x[f"v_{c}"] for c in (*B.CENTRE, *B.TURN, *B.SIZE)])
        assert np.allclose(got, want, rtol=1e-5, atol=1e-5), (i, got, want)
    for x in B.to_cameras(rows).collect():
        k = x["camera_id"]
        want = numeric(poses[k], lambda v, k=k: sum(loss((k, i), g, v) for i, g in scene.items()))
        assert np.allclose([x[f"v_{c}"] for c in B.POSE], want, rtol=1e-5, atol=1e-4), k
    seen = {(x["camera_id"], x["gaussian_id"]): x for x in project(gaussians.selectExpr("*", "0.9D as opacity"), cameras, model).collect()}
    for (k, i), x in seen.items():
        assert np.allclose([x[c] for c in ("mean2d_x", "mean2d_y", "conic_a", "conic_b", "conic_c", "depth")], _forward(scene[i], poses[k], model))
    assert len(seen) > 5


def test_missing_slopes_and_empty_tables(spark):
    empty = spark.createDataFrame([], "camera_id int, gaussian_id long, v_mean_x double")
    gaussians = spark.createDataFrame([(1, *[1.0] * 10)], "gaussian_id long, " + ", ".join(f"{c} double" for c in (*B.CENTRE, *B.TURN, *B.SIZE)))
    cameras = spark.createDataFrame([(0, *[1.0] * 16, 8, 8)], "camera_id int, " + ", ".join(f"{c} double" for c in (*B.POSE, "fx", "fy", "cx", "cy")) + ", width int, height int")
    assert B.to_primitives(B.projection_slopes(empty, gaussians, cameras)).count() == 0
    null = spark.createDataFrame([(0, 1, None)], empty.schema)
    assert B.to_primitives(B.projection_slopes(null, gaussians, cameras)).first()["v_mx"] == 0.0
    with pytest.raises(ValueError):
        B.projection_slopes(empty, gaussians, cameras, "fisheye")
