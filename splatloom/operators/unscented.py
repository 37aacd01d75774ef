"""Projection by the unscented transform: seven points of each primitive go through the whole lens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.functions import lenses
from splatloom.functions import rotation as R

from .project import ALPHA_LEAST, COMPENSATION_LEAST, EXTENT, computed, spread_out

#: The least radial factor of a distorted lens that still counts as seen; a fixed value.
RADIAL_LEAST = 0.8


def weights(alpha: float, beta: float, kappa: float) -> tuple[float, float, float, float]:
    """(spread of the points, centre's weight in the mean, its weight in the covariance, weight of each other point)."""
    scaled = alpha * alpha * (3 + kappa)
    centre = (scaled - 3) / scaled
    return scaled**0.5, centre, centre + 1 - alpha * alpha + beta, 1 / (2 * scaled)


#: Stands for the distance from the axis of a point on it.
_ON_AXIS = 2.0**-52

#: ``model`` and what ``distortion`` has: pinhole any of ``lenses.opencv_distortion``; fisheye ``radial`` (see
#: ``lenses.odd_polynomial``) and ``most``, the angle up to which it sees; ftheta ``polynomial`` (pixels by angle),
#: ``affine`` (c, d, e: x = c u + d v, y = e u + v) and ``most``; ortho nothing.
MODELS = ("fisheye", "ftheta", "ortho", "pinhole")


def _image_point(p: R.Vector, model: str, distortion: Mapping[str, float | Sequence[float]] | None) -> tuple[Column, Column, Column]:
    """(x, y, whether it can be seen) of a point in camera space."""
    fx, fy, cx, cy = R.columns("fx", "fy", "cx", "cy")
    if model == "ortho":
        return fx * p[0] + cx, fy * p[1] + cy, p[2] > 0
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    if model in ("fisheye", "ftheta"):
        flat = F.greatest(F.sqrt(p[0] * p[0] + p[1] * p[1]), F.lit(_ON_AXIS))
        angle, most = F.atan2(flat, p[2]), float(distortion["most"])
        bent = F.least(angle, F.lit(most))  # points outside stand at the rim
        if model == "fisheye":
            share = lenses.odd_polynomial(bent, distortion["radial"]) / flat
            return fx * share * p[0] + cx, fy * share * p[1] + cy, (p[2] > 0) & (share > 0) & (angle < most)
        share, (c, d, e) = lenses.polynomial(bent, distortion["polynomial"]) / flat, distortion["affine"]
        u, v = share * p[0], share * p[1]
        return c * u + d * v + cx, e * u + v + cy, angle < most
    u, v = F.try_divide(p[0], p[2]), F.try_divide(p[1], p[2])
    if distortion:
        radial, du, dv = lenses.opencv_distortion(u, v, distortion)
        return fx * (radial * u + du) + cx, fy * (radial * v + dv) + cy, (p[2] > 0) & (radial > RADIAL_LEAST)
    front = p[2] > 0
    return F.when(front, fx * u + cx).otherwise(0.0), F.when(front, fy * v + cy).otherwise(0.0), front


def project_unscented(
    gaussians: DataFrame,
    cameras: DataFrame,
    model: str = "pinhole",
    distortion: Mapping[str, float | Sequence[float]] | None = None,
    near: float = 0.01,
    far: float = 1e10,
    blur: float = 0.3,
    radius_clip: float = 0.0,
    alpha: float = 0.1,
    beta: float = 2.0,
    kappa: float = 0.0,
    margin: float = 0.1,
    all_seen: bool = False,
) -> DataFrame:
    """One row for each camera and primitive that shows in it, with the columns of ``project``.

    ``model`` is one of ``MODELS``; F-Theta lenses take no focal length from the cameras.  Mean and covariance in the image are weighted sums over the primitive's centre and two points on
    each of its axes.  A primitive shows if its centre lies within [near, far], if any of the points
    (``all_seen``: each) falls into the image widened by ``margin`` of its size, if the covariance is
    positive, and by the tests of ``project`` on opacity (times the compensation), radius and box.
    """
    shape = ["mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz"]
    rest = [c for c in gaussians.columns if c not in shape]
    q, s, m = R.columns("qw", "qx", "qy", "qz"), R.columns("sx", "sy", "sz"), R.columns("mx", "my", "mz")
    spread, of_mean, of_cov, other = weights(alpha, beta, kappa)
    able = (R.dot(q, q) > 2**-23) & (s[0] > 2**-23) & (s[1] > 2**-23) & (s[2] > 2**-23)
    unit = spread_out(gaussians).where(able).select(*rest, *m, *s, *[c.alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), R.normalised(q), strict=True)])
    turn = R.rotation(q)
    scene = computed(unit, *rest, *m, *[(spread * turn[i][j] * s[j]).alias(f"a{i}{j}") for i in range(3) for j in range(3)])
    view, shift = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3)), R.columns("t0", "t1", "t2")
    depth = R.dot(view[2], m) + shift[2]
    seen = scene.join(cameras, (depth >= near) & (depth <= far))
    lens = ["fx", "fy", "cx", "cy", "width", "height"]
    axes = [R.columns(f"a0{j}", f"a1{j}", f"a2{j}") for j in range(3)]
    seen = computed(seen, "camera_id", *rest, *lens, *[(R.dot(view[i], m) + shift[i]).alias(f"p{i}") for i in range(3)], *[R.dot(view[i], axes[j]).alias(f"b{i}{j}") for i in range(3) for j in range(3)])
    centre, arms = R.columns("p0", "p1", "p2"), [R.columns(f"b0{j}", f"b1{j}", f"b2{j}") for j in range(3)]
    points = [centre, *[tuple(c + sign * a for c, a in zip(centre, arm, strict=True)) for sign in (1, -1) for arm in arms]]
    placed = [_image_point(p, model, distortion) for p in points]
    base = ["camera_id", *rest, "width", "height"]
    seen = computed(seen, *base, F.col("p2").alias("depth"), *[c.alias(f"{n}{k}") for k, at in enumerate(placed) for n, c in zip(("x", "y", "ok"), at, strict=True)])
    mean = {f"mean2d_{n}": of_mean * F.col(f"{n}0") + other * sum((F.col(f"{n}{k}") for k in range(2, 7)), F.col(f"{n}1")) for n in "xy"}
    within = lambda n, k, size: (F.col(f"{n}{k}") >= -F.col(size) * margin) & (F.col(f"{n}{k}") < F.col(size) * (1 + margin))
    shown = F.array(*[F.coalesce(F.col(f"ok{k}") & within("x", k, "width") & within("y", k, "height"), F.lit(False)) for k in range(7)])
    seen = computed(seen, *base, "depth", *[f"{n}{k}" for k in range(7) for n in "xy"], *[c.alias(n) for n, c in mean.items()], (F.forall(shown, lambda o: o) if all_seen else F.exists(shown, lambda o: o)).alias("ok")).where("ok")
    gap = lambda n, k: F.col(f"{n}{k}") - F.col(f"mean2d_{n}")
    product = lambda n, o: of_cov * gap(n, 0) * gap(o, 0) + other * sum((gap(n, k) * gap(o, k) for k in range(2, 7)), gap(n, 1) * gap(o, 1))
    base = [*base, "depth", "mean2d_x", "mean2d_y"]
    seen = computed(seen, *base, product("x", "x").alias("a0"), product("x", "y").alias("b"), product("y", "y").alias("c0_"))
    seen = computed(seen, *base, (F.col("a0") + blur).alias("a"), "b", (F.col("c0_") + blur).alias("c"), (F.col("a0") * F.col("c0_") - F.col("b") * F.col("b")).alias("sharp"))
    seen = seen.withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b")).where("det > 0 and a > 0 and c > 0")
    seen = computed(seen, *base, "a", "b", "c", "det", F.sqrt(F.greatest(F.col("sharp") / F.col("det"), F.lit(COMPENSATION_LEAST**2))).alias("compensation"))
    strength = F.col("opacity") * F.col("compensation")
    extent = F.least(F.lit(EXTENT), F.sqrt(2 * F.ln(strength / ALPHA_LEAST)))
    half = (F.col("a") + F.col("c")) / 2
    longest = F.sqrt(half + F.sqrt(F.greatest(half * half - F.col("det"), F.lit(0.01))))
    seen = computed(seen.where(strength >= ALPHA_LEAST), *base, "a", "b", "c", "compensation", extent.alias("extent"), longest.alias("longest"))
    # The inverse of the covariance with a millionth added to its diagonal.
    a, c, b = F.col("a") + 1e-6, F.col("c") + 1e-6, F.col("b")
    det = a * c - b * b
    conic = {"conic_a": c / det, "conic_b": -b / det, "conic_c": a / det}
    radii = {f"radius_{n}": F.ceil(F.col("extent") * F.least(F.sqrt(v), F.col("longest"))).cast("int") for n, v in (("x", "a"), ("y", "c"))}
    out = computed(seen, *base, *[v.alias(n) for n, v in conic.items()], "compensation", *[v.alias(n) for n, v in radii.items()])
    x, y, rx, ry = R.columns("mean2d_x", "mean2d_y", "radius_x", "radius_y")
    return out.where(((rx > radius_clip) | (ry > radius_clip)) & (x + rx > 0) & (x - rx < F.col("width")) & (y + ry > 0) & (y - ry < F.col("height")))
