"""Projection of Gaussian primitives through cameras: a cross join that is filtered as early as it can be.

The cameras are the small side; how small is checked by Spark's own broadcast threshold.  Cheap
tests (depth) stand in the join condition, and each further group of columns is computed only for
rows that passed the tests before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

#: Fixed values of the renderer.
ALPHA_LEAST = 1.0 / 255.0
EXTENT = 3.33
ALPHA_MOST = 0.99
TRANSMITTANCE_LEAST = 1e-4
COMPENSATION_LEAST = 0.005
#: The upper triangle of a symmetric 3x3 matrix.
TRIANGLE = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _jacobian(model: str, p: R.Vector, fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column):
    """((mean x, mean y), 2x3 Jacobian) of a camera model at a point in front of the camera."""
    x, y, z = p
    zero = F.lit(0.0)
    if model == "ortho":
        return (fx * x + cx, fy * y + cy), ((fx, zero, zero), (zero, fy, zero))
    if model == "fisheye":
        eps = 1e-7
        flat = F.sqrt(x * x + y * y) + eps
        theta = F.atan2(flat, z + eps)
        xx, yy, xy = x * x + eps, y * y, x * y
        far = xx + yy
        dist = far + z * z
        b = theta / flat / far
        a = z / dist / far
        jac = ((fx * (xx * a + yy * b), fx * xy * (a - b), -fx * x / dist), (fy * xy * (a - b), fy * (yy * a + xx * b), -fy * y / dist))
        return (fx * x * theta / flat + cx, fy * y * theta / flat + cy), jac
    # The slope for the Jacobian stays within the view widened by 30 %.
    wide_x, wide_y = 0.3 * (0.5 * width / fx), 0.3 * (0.5 * height / fy)
    tx = z * F.least((width - cx) / fx + wide_x, F.greatest(-(cx / fx + wide_x), x / z))
    ty = z * F.least((height - cy) / fy + wide_y, F.greatest(-(cy / fy + wide_y), y / z))
    return (fx * x / z + cx, fy * y / z + cy), ((fx / z, zero, -fx * tx / (z * z)), (zero, fy / z, -fy * ty / (z * z)))


#: Columns that ``computed`` passes on as they are, so that rows dealt out by them stay dealt out by them.
KEYS = ("camera_id", "tile_x", "tile_y", "stretch")


def computed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """A select whose columns are computed once: later filters are not rewritten in terms of their inputs."""
    rows = rows.select(*columns)
    keys = [c for c in rows.columns if c in KEYS]
    return rows.select(*keys, F.inline(F.array(F.struct(*[c for c in rows.columns if c not in keys])))).select(*rows.columns)


def spread_out(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores: a small table that fans out is no work for few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def project(gaussians: DataFrame, cameras: DataFrame, model: str = "pinhole", near: float = 0.01, far: float = 1e10, blur: float = 0.3, radius_clip: float = 0.0, antialiased: bool = False, keep_culled: bool = False) -> DataFrame:
    """One row for each camera and primitive that shows in it.

    Adds mean2d_x/y, depth, conic_a/b/c, radius_x/y and compensation to ids, opacity and the other
    columns of the primitives.  ``keep_culled`` keeps rows that don't show, with radii 0 and nulls.
    A primitive is culled outside [near, far], with opacity under 1/255 (times the compensation if
    ``antialiased``), with both radii at most ``radius_clip``, or when its box misses the image.
    """
    rest = [c for c in gaussians.columns if c not in {"mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz"}]
    q, s, m = R.columns("qw", "qx", "qy", "qz"), R.columns("sx", "sy", "sz"), R.columns("mx", "my", "mz")
    unit = spread_out(gaussians).select(*rest, *m, *s, *[c.alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), R.normalised(q), strict=True)])
    turn = R.rotation(q)
    unit = unit.select(*rest, *m, *[(turn[i][j] * s[j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    axes = tuple(R.columns(f"m{i}0", f"m{i}1", f"m{i}2") for i in range(3))
    scene = computed(unit, *rest, *m, *[R.dot(axes[i], axes[j]).alias(f"v{k}") for k, (i, j) in enumerate(TRIANGLE)])
    view = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    shift = R.columns("t0", "t1", "t2")
    depth = R.dot(view[2], m) + shift[2]
    seen = scene.crossJoin(cameras) if keep_culled else scene.join(cameras, (depth >= near) & (depth <= far))
    lens = ["fx", "fy", "cx", "cy", "width", "height"]
    in_camera = [(R.dot(view[k], m) + shift[k]).alias(n) for k, n in enumerate(("px", "py", "pz"))]
    body = R.symmetric(R.columns(*[f"v{k}" for k in range(6)]))
    seen = seen.select("camera_id", *rest, *lens, *view[0], *view[1], *view[2], *in_camera, *[R.dot(view[i], body[j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)])
    half = tuple(R.columns(f"h{i}0", f"h{i}1", f"h{i}2") for i in range(3))
    seen = computed(seen, "camera_id", *rest, *lens, "px", "py", "pz", *[R.dot(half[i], view[j]).alias(f"w{k}") for k, (i, j) in enumerate(TRIANGLE)])
    mean, jac = _jacobian(model, R.columns("px", "py", "pz"), *R.columns(*lens))
    seen = computed(seen, "camera_id", *rest, "width", "height", F.col("pz").alias("depth"), *[f"w{k}" for k in range(6)], mean[0].alias("mean2d_x"), mean[1].alias("mean2d_y"), *[jac[i][j].alias(f"j{i}{j}") for i in range(2) for j in range(3)])
    full = R.symmetric(R.columns(*[f"w{k}" for k in range(6)]))
    rows = [R.columns(f"j{i}0", f"j{i}1", f"j{i}2") for i in range(2)]
    base = ["camera_id", *rest, "width", "height", "depth", "mean2d_x", "mean2d_y"]
    seen = seen.select(*base, *rows[0], *rows[1], *[R.dot(full[k], rows[i]).alias(f"f{i}{k}") for i in range(2) for k in range(3)])
    half = [R.columns(f"f{i}0", f"f{i}1", f"f{i}2") for i in range(2)]
    seen = seen.select(*base, R.dot(half[0], rows[0]).alias("a"), R.dot(half[0], rows[1]).alias("b"), R.dot(half[1], rows[1]).alias("c"))
    seen = seen.select(*base, (F.col("a") + blur).alias("a"), "b", (F.col("c") + blur).alias("c"), (F.col("a") * F.col("c") - F.col("b") * F.col("b")).alias("sharp"))
    seen = seen.withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b"))
    seen = computed(seen, *base, "a", "b", "c", "det", F.sqrt(F.greatest(F.col("sharp") / F.col("det"), F.lit(COMPENSATION_LEAST**2))).alias("compensation"))
    strength = F.col("opacity") * F.col("compensation") if antialiased else F.col("opacity")
    extent = F.least(F.lit(EXTENT), F.sqrt(2 * F.ln(strength / ALPHA_LEAST)))
    valid = (F.col("depth") >= near) & (F.col("depth") <= far) & (F.col("det") > 0) & (strength >= ALPHA_LEAST)
    radii = {"radius_x": F.ceil(extent * F.sqrt("a")).cast("int"), "radius_y": F.ceil(extent * F.sqrt("c")).cast("int")}
    conic = {"conic_a": F.col("c") / F.col("det"), "conic_b": -F.col("b") / F.col("det"), "conic_c": F.col("a") / F.col("det")}
    if not keep_culled:
        seen = seen.where(valid)
    out = computed(seen, *base, "det", "compensation", *[c.alias(n) for n, c in (radii | conic).items()])
    x, y, rx, ry = R.columns("mean2d_x", "mean2d_y", "radius_x", "radius_y")
    inside = ((rx > radius_clip) | (ry > radius_clip)) & (x + rx > 0) & (x - rx < F.col("width")) & (y + ry > 0) & (y - ry < F.col("height"))
    columns = ["mean2d_x", "mean2d_y", "depth", "conic_a", "conic_b", "conic_c", "compensation"]
    if not keep_culled:
        return out.where(inside).select("camera_id", *rest, "width", "height", *columns, "radius_x", "radius_y")
    shown = F.coalesce(valid & inside, F.lit(False))
    return out.select("camera_id", *rest, "width", "height", *[F.when(shown, F.col(c)).alias(c) for c in columns], *[F.when(shown, F.col(c)).otherwise(0).alias(c) for c in ("radius_x", "radius_y")])
