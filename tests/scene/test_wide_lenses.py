"""Wide lenses by the unscented transform against plain numpy."""

import numpy as np
import pytest

from splatloom.operators.unscented import project_unscented, weights
from splatloom.plans import wide_lenses
from splatloom.sources import views as V

SF = "/root/testdata/sf0.001"


def _point(model, lens, p, cam):
    flat = np.hypot(p[0], p[1])
    t = min(np.arctan2(flat, p[2]), lens["most"])
    if model == "fisheye":
        r = t * (1 + sum(c * t ** (2 * k + 2) for k, c in enumerate(lens["radial"])))
        return np.array([cam.fx * r * p[0] / flat + cam.cx, cam.fy * r * p[1] / flat + cam.cy])
    r = sum(c * t**k for k, c in enumerate(lens["polynomial"]))
    c, d, e = lens["affine"]
    u, v = r * p[0] / flat, r * p[1] / flat
    return np.array([c * u + d * v + cam.cx, e * u + v + cam.cy])


@pytest.mark.parametrize("model,lens", [("fisheye", wide_lenses.FISHEYE), ("ftheta", wide_lenses.FTHETA)])
def test_means_equal_a_loop(spark, model, lens):
    scene = V.gaussians(spark, SF)
    cams = V.cameras(spark, SF).where("camera_id = 3")
    seen = project_unscented(scene, cams, model=model, distortion=lens).collect()
    cam, rows = cams.first(), {g["gaussian_id"]: g for g in scene.collect()}
    turn = np.array([[cam[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    spread, centre, _, other = weights(0.1, 2.0, 0.0)
    assert len(seen) > 20
    for s in seen:
        g = rows[s["gaussian_id"]]
        w, x, y, z = (g[c] for c in ("qw", "qx", "qy", "qz"))
        rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        mid = turn @ np.array([g["mx"], g["my"], g["mz"]])
        arms = [turn @ rot[:, j] * g["s" + a] * spread for j, a in enumerate("xyz")]
        at = [_point(model, lens, p, cam) for p in (mid, *[mid + k * a for k in (1, -1) for a in arms])]
        want = centre * at[0] + other * sum(at[1:])
        assert np.allclose([s["mean2d_x"], s["mean2d_y"]], want, atol=1e-6)


def test_unknown_models_are_refused(spark):
    with pytest.raises(ValueError):
        project_unscented(V.gaussians(spark, SF), V.cameras(spark, SF), model="pin")
