"""Flat primitives (surfels): ray transforms, boxes, and compositing with normals, distortion and median depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

from .composite import PIXEL, _spread, contributions, near_pixels, near_tiles
from .project import ALPHA_LEAST, ALPHA_MOST, EXTENT, computed, spread_out

#: Fixed value: the inverse square of the screen-space filter's width.
FILTER = 2.0
TILE = 16


def project_surfels(gaussians: DataFrame, cameras: DataFrame, near: float = 0.01, far: float = 1e10) -> DataFrame:
    """Ids and other columns of the surfels (none named a0..c2 or n0..n2) with mean2d, depth, radii, the normal towards the camera and the rows a, b, c of the ray transform.

    One row for each camera and surfel between the planes whose box meets the image.
    """
    rest = [c for c in gaussians.columns if c not in {"mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz"}]
    m, s = R.columns("mx", "my", "mz"), R.columns("sx", "sy")
    turn = R.rotation(R.columns("qw", "qx", "qy", "qz"))
    scale = (s[0], s[1], F.lit(1.0))
    scene = computed(spread_out(gaussians), *rest, *m, *[(turn[i][j] * scale[j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)])
    view = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    depth = R.dot(view[2], m) + F.col("t2")
    rows = scene.join(cameras, (depth > near) & (depth < far))
    axis = [R.columns(f"h0{j}", f"h1{j}", f"h2{j}") for j in range(3)]
    lens = ["fx", "fy", "cx", "cy", "width", "height"]
    rows = computed(rows, "camera_id", *rest, *lens, *[R.dot(view[i], axis[j]).alias(f"w{i}{j}") for i in range(3) for j in range(3)], *[(R.dot(view[i], m) + F.col(f"t{i}")).alias(f"p{i}") for i in range(3)])
    w = [R.columns(f"w{i}0", f"w{i}1", f"p{i}") for i in range(3)]
    screen = {"a": [F.col("fx") * x + F.col("cx") * z for x, z in zip(w[0], w[2], strict=True)], "b": [F.col("fy") * y + F.col("cy") * z for y, z in zip(w[1], w[2], strict=True)], "c": list(w[2])}
    flip = F.when(R.dot(R.columns("w02", "w12", "w22"), R.columns("p0", "p1", "p2")) < 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    base = ["camera_id", *rest, "width", "height"]
    rays = [f"{k}{i}" for k in "abc" for i in range(3)]
    rows = rows.select(*base, F.col("p2").alias("depth"), *[c.alias(f"{k}{i}") for k, v in screen.items() for i, c in enumerate(v)], *[(F.col(f"w{i}2") * flip).alias(f"n{i}") for i in range(3)])
    rows = rows.withColumn("d", F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1") - F.col("c2") * F.col("c2"))
    sign = (1, 1, -1)
    total = lambda x, y: sum((g * F.col(f"{x}{i}") * F.col(f"{y}{i}") / F.col("d") for i, g in list(enumerate(sign))[1:]), F.col(f"{x}0") * F.col(f"{y}0") / F.col("d"))
    rows = rows.select(*base, "depth", *rays, "n0", "n1", "n2", "d", total("a", "c").alias("mean2d_x"), total("b", "c").alias("mean2d_y"), total("a", "a").alias("aa"), total("b", "b").alias("bb"))
    extent = lambda mean, square: F.ceil(EXTENT * F.sqrt(F.greatest(F.lit(1e-4), F.col(mean) * F.col(mean) - F.col(square)))).cast("int")
    rows = computed(rows, *base, "depth", *rays, "n0", "n1", "n2", "d", "mean2d_x", "mean2d_y", extent("mean2d_x", "aa").alias("radius_x"), extent("mean2d_y", "bb").alias("radius_y"))
    x, y, rx, ry = R.columns("mean2d_x", "mean2d_y", "radius_x", "radius_y")
    return rows.where((F.abs("d") > 0) & (x + rx > 0) & (x - rx < F.col("width")) & (y + ry > 0) & (y - ry < F.col("height"))).drop("d")


def surfel_pairs(projected: DataFrame, mask: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """A row for each pixel of the tiles that a surfel's box meets, but not ``mask`` lists, whose alpha is at least 1/255; ``limits`` says how deep each pixel looks."""
    across = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    rows = _spread(projected, TILE, across("width"), across("height"), "tile_x", "tile_y")
    rows = near_tiles(rows if mask is None else rows.join(mask, ["camera_id", "tile_x", "tile_y"], "left_anti"), limits)
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("tile_y") * TILE, F.least(F.col("tile_y") * TILE + TILE, "height") - 1)))
    rows = rows.withColumn("x", F.explode(F.sequence(F.col("tile_x") * TILE, F.least(F.col("tile_x") * TILE + TILE, "width") - 1)))
    rows = near_pixels(rows, limits, TILE)
    rows = rows.drop("tile_x", "tile_y") if limits is None else rows
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    hu = [(px * F.col(f"c{i}") - F.col(f"a{i}")).alias(f"u{i}") for i in range(3)]
    hv = [(py * F.col(f"c{i}") - F.col(f"b{i}")).alias(f"v{i}") for i in range(3)]
    rest = [c for c in rows.columns if c not in {f"{k}{i}" for k in "abc" for i in range(3)}]
    rows = rows.select(*rest, *hu, *hv)
    cross = R.cross(R.columns("u0", "u1", "u2"), R.columns("v0", "v1", "v2"))
    rows = computed(rows, *rest, *[c.alias(f"k{i}") for i, c in enumerate(cross)]).where("k2 <> 0")
    flat = (F.col("k0") * F.col("k0") + F.col("k1") * F.col("k1")) / (F.col("k2") * F.col("k2"))
    dx, dy = F.col("mean2d_x") - px, F.col("mean2d_y") - py
    power = 0.5 * F.least(flat, FILTER * (dx * dx + dy * dy))
    rows = computed(rows, *rest, F.least(F.lit(ALPHA_MOST), F.col("opacity") * F.exp(-power)).alias("alpha"))
    return rows.where(F.col("alpha") >= ALPHA_LEAST)


def composite_surfels(projected: DataFrame, channels: list[str]) -> DataFrame:
    """(camera_id, x, y, n, alpha, channels, n0..n2, distortion, median_depth) of the pixels that any surfel meets."""
    rows = contributions(surfel_pairs(projected))
    before = Window.partitionBy(*PIXEL).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    prefix = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = rows.withColumns({"pw": prefix(F.col("weight")), "pd": prefix(F.col("weight") * F.col("depth")), "left": F.col("after") / (1 - F.col("alpha"))})
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in [*channels, "n0", "n1", "n2"]]
    bend = F.sum(2 * F.col("weight") * (F.col("depth") * F.col("pw") - F.col("pd"))).alias("distortion")
    return rows.groupBy(*PIXEL).agg(F.count("*").alias("n"), F.sum("weight").alias("alpha"), *sums, bend, F.max_by("depth", F.when(F.col("left") > 0.5, F.col("place"))).alias("median_depth"))
