"""Rays of moving cameras through image points, and compositing of primitives where these rays pass them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatloom.functions import lenses
from splatloom.functions import rotation as R

from .composite import BEFORE, near_pixels, near_tiles, tiles
from .project import ALPHA_LEAST, ALPHA_MOST, computed


def shutter_rays(points: DataFrame, cameras: DataFrame, distortion: dict[str, float] | None = None) -> DataFrame:
    """``points`` (camera_id, x, y) with the time share and the world ray (ox.., dx..) of each image point.

    ``cameras`` has lens, size, ``shutter`` (down, up, right, left; anything else: global) and the
    poses world-to-camera at the start and the end of the exposure: quaternions aw..az and bw..bz,
    shifts at0..2 and bt0..2.  Directions have length 1; a distorted lens is undistorted in 10 rounds.
    """
    keep = points.columns
    rows = points.join(cameras, "camera_id")
    u, v = (F.col("x") - F.col("cx")) / F.col("fx"), (F.col("y") - F.col("cy")) / F.col("fy")
    flat = lenses.opencv_undistorted(u, v, distortion) if distortion else F.struct(u.alias("u"), v.alias("v"))
    share = lenses.shutter_share(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("shutter"))
    a, b = R.columns("aw", "ax", "ay", "az"), R.columns("bw", "bx", "by", "bz")
    poses = [c for k in "ab" for c in (*(f"{k}{n}" for n in "wxyz"), *(f"{k}t{i}" for i in range(3)))]
    rows = computed(rows, *keep, *poses, share.alias("time"), flat.alias("flat"))
    near = R.slerp_shares(a, b, F.col("time"))
    rows = computed(rows, *keep, *poses, "time", R.norm((F.col("flat.u"), F.col("flat.v"), F.lit(1.0))).alias("long"), "flat", near[0].alias("sa"), near[1].alias("sb"))
    turn = [(F.col("sa") * x + F.col("sb") * y).alias(f"q{i}") for i, (x, y) in enumerate(zip(a, b, strict=True))]
    shift = R.lerp(R.columns("at0", "at1", "at2"), R.columns("bt0", "bt1", "bt2"), F.col("time"))
    rows = computed(rows, *keep, "time", "flat", "long", *turn, *[c.alias(f"t{i}") for i, c in enumerate(shift)])
    back = R.transposed(R.rotation(R.normalised(R.columns("q0", "q1", "q2", "q3"))))
    origin = [-c for c in R.apply(back, R.columns("t0", "t1", "t2"))]
    ray = R.apply(back, tuple(c / F.col("long") for c in (F.col("flat.u"), F.col("flat.v"), F.lit(1.0))))
    return rows.select(*keep, "time", *[c.alias(f"o{n}") for n, c in zip("xyz", origin, strict=True)], *[c.alias(f"d{n}") for n, c in zip("xyz", ray, strict=True)])


def with_precision(gaussians: DataFrame) -> DataFrame:
    """``gaussians`` with what ``ray_pairs`` needs kept through a projection: centre g0..2, scales gs0..2, inverse shape g00..g22."""
    turn = R.rotation(R.normalised(R.columns("qw", "qx", "qy", "qz")))
    scales = R.columns("sx", "sy", "sz")
    return gaussians.select("*", *[F.col(f"m{n}").alias(f"g{k}") for k, n in enumerate("xyz")], *[c.alias(f"gs{k}") for k, c in enumerate(scales)], *[F.try_divide(turn[j][i], scales[i]).alias(f"g{i}{j}") for i in range(3) for j in range(3)])


def ray_pairs(projected: DataFrame, cameras: DataFrame, tile: int = 16, mask: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """A row for each pixel and primitive whose alpha along the pixel's ray is at least 1/255.

    ``projected`` are rows of ``with_precision`` after a projection.  The alpha is the opacity times
    the primitive's density where the ray comes nearest to its centre, 0 if that lies behind.
    ``hit`` is the distance to that point, nx..nz the primitive's third axis turned against the ray.
    All pixels of the tiles that a primitive's box meets are looked at; only pairs that count go on
    to ``composite.contributions``.  ``mask`` (camera_id, tile_x, tile_y) lists tiles that are left out; ``limits``
    says how deep each pixel looks.
    """
    shape = [*(f"g{k}" for k in range(3)), *(f"gs{k}" for k in range(3)), *(f"g{i}{j}" for i in range(3) for j in range(3))]
    rest = [c for c in projected.columns if c not in shape]
    pose = ["fx", "fy", "cx", "cy", *(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2"]
    rows = projected.join(cameras.select("camera_id", *pose), "camera_id")
    view, body = ([R.columns(f"{n}{i}0", f"{n}{i}1", f"{n}{i}2") for i in range(3)] for n in "rg")
    away = tuple(-(R.dot(tuple(view[k][i] for k in range(3)), R.columns("t0", "t1", "t2")) + F.col(f"g{i}")) for i in range(3))
    # The primitive's frame as seen from the camera, so that a pixel's ray needs three products only.
    frame = [R.dot(body[i], view[k]).alias(f"h{i}{k}") for i in range(3) for k in range(3)]
    third = [(F.col(f"g2{k}") * F.col("gs2")).alias(f"n{n}") for k, n in enumerate("xyz")]
    lens = ["fx", "fy", "cx", "cy"]
    rows = computed(rows, *rest, *lens, "gs0", "gs1", "gs2", *[R.dot(body[i], away).alias(f"o{i}") for i in range(3)], *frame, *third, *[f"r{i}{j}" for i in range(3) for j in range(3)])
    facing = [R.dot(view[k], R.columns("nx", "ny", "nz")).alias(f"c{k}_") for k in range(3)]
    held = ["gs0", "gs1", "gs2", "o0", "o1", "o2", *(f"h{i}{k}" for i in range(3) for k in range(3)), "nx", "ny", "nz"]
    rows = tiles(computed(rows, *rest, *lens, *held, *facing), tile)
    rows = near_tiles(rows if mask is None else rows.join(mask, ["camera_id", "tile_x", "tile_y"], "left_anti"), limits)
    for at, size in (("y", "height"), ("x", "width")):
        last = F.least((F.col(f"tile_{at}") + 1) * tile, F.col(size)) - 1
        rows = rows.withColumn(at, F.explode(F.sequence(F.col(f"tile_{at}") * tile, last)))
    rows = near_pixels(rows, limits, tile)
    rest = [*rest, "x", "y", *([] if limits is None else BEFORE)]
    ray = (F.col("x") + 0.5 - F.col("cx")) / F.col("fx"), (F.col("y") + 0.5 - F.col("cy")) / F.col("fy"), F.lit(1.0)
    against = F.when(R.dot(ray, R.columns("c0_", "c1_", "c2_")) > 0, -1.0).otherwise(1.0)
    rows = computed(rows, *rest, "gs0", "gs1", "gs2", "o0", "o1", "o2", *[R.dot(ray, R.columns(f"h{i}0", f"h{i}1", f"h{i}2")).alias(f"e{i}_") for i in range(3)], *[(against * F.col(f"n{n}")).alias(f"n{n}") for n in "xyz"])
    step, start = R.columns("e0_", "e1_", "e2_"), R.columns("o0", "o1", "o2")
    size = R.norm(step)
    rows = computed(rows, *rest, "gs0", "gs1", "gs2", "nx", "ny", "nz", *start, *[(c / size).alias(f"u{i}") for i, c in enumerate(step)])
    step = R.columns("u0", "u1", "u2")
    wide = R.cross(step, start)
    rows = computed(rows, *rest, "gs0", "gs1", "gs2", "nx", "ny", "nz", *step, (-R.dot(step, start)).alias("t"), R.dot(wide, wide).alias("far")).where("t >= 0")
    alpha = F.least(F.lit(ALPHA_MOST), F.col("opacity") * F.exp(-0.5 * F.col("far")))
    hit = R.norm(tuple(F.col(f"gs{i}") * F.col(f"u{i}") * F.col("t") for i in range(3)))
    return computed(rows, *rest, "nx", "ny", "nz", hit.alias("hit"), alpha.alias("alpha")).where(F.col("alpha") >= ALPHA_LEAST)
