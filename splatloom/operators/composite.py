"""Tiles, depth-ordered compositing and contributors.

A projected primitive is spread over the pixels of its own box, which bounds all places where its
alpha reaches 1/255, so pixels need no join with tiles.  One shuffle by (camera, pixel) serves the
ordered window and the sums after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .project import ALPHA_LEAST, ALPHA_MOST, EXTENT, TRANSMITTANCE_LEAST, computed

PIXEL = ["camera_id", "x", "y"]
TILE = ["camera_id", "tile_x", "tile_y"]
#: What pairs keep of the limits: their tile, and the logarithm of the transmittance and the pairs before their stretch of depth.
BEFORE = ["tile_x", "tile_y", "start", "before"]


def _span(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    return F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high), size).cast("int")


def _spread(rows: DataFrame, unit: float, width: Column, height: Column, x: str, y: str) -> DataFrame:
    """A row for each cell of ``unit`` pixels that the box [mean - radius, mean + radius) meets."""
    x0, x1 = _span((F.col("mean2d_x") - F.col("radius_x")) / unit, (F.col("mean2d_x") + F.col("radius_x")) / unit, width)
    y0, y1 = _span((F.col("mean2d_y") - F.col("radius_y")) / unit, (F.col("mean2d_y") + F.col("radius_y")) / unit, height)
    rows = computed(rows, *rows.columns, x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1")).where("_x1 > _x0 and _y1 > _y0")
    rows = rows.withColumn(y, F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1)))
    return rows.withColumn(x, F.explode(F.sequence(F.col("_x0"), F.col("_x1") - 1))).drop("_x0", "_x1", "_y0", "_y1")


def tiles(projected: DataFrame, tile: int = 16) -> DataFrame:
    """``projected`` with a row for each tile (tile_x, tile_y) that a primitive's box meets."""
    across = lambda c: F.ceil(F.col(c) / tile).cast("int")
    return _spread(projected, tile, across("width"), across("height"), "tile_x", "tile_y")


def tiles_by_ellipse(projected: DataFrame, tile: int = 16) -> DataFrame:
    """``tiles`` without those that the ellipse where alpha reaches 1/255 does not meet.

    In a row of tiles the ellipse spans one interval of x, whose ends lie at the ellipse's own
    extreme points if these are in the row, or else on the row's edge nearer to them.
    """
    across = lambda c: F.ceil(F.col(c) / tile).cast("int")
    a, b, c = F.col("conic_a"), F.col("conic_b"), F.col("conic_c")
    rows = computed(projected, *projected.columns, F.least(F.lit(EXTENT * EXTENT), 2 * F.ln(F.col("opacity") * 255)).alias("level"), (a * c - b * b).alias("det"))
    rows = computed(rows, *projected.columns, "level", F.sqrt(F.col("level") * c / F.col("det")).alias("far_x"), F.sqrt(F.col("level") * a / F.col("det")).alias("far_y"))
    y0, y1 = _span((F.col("mean2d_y") - F.col("radius_y")) / tile, (F.col("mean2d_y") + F.col("radius_y")) / tile, across("height"))
    rows = computed(rows, *rows.columns, y0.alias("_y0"), y1.alias("_y1")).where("_y1 > _y0")
    rows = rows.withColumn("tile_y", F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1)))
    low = F.greatest(F.col("tile_y") * tile - F.col("mean2d_y"), -F.col("far_y"))
    high = F.least((F.col("tile_y") + 1) * tile - F.col("mean2d_y"), F.col("far_y"))
    rows = computed(rows, *projected.columns, "tile_y", "level", "far_x", low.alias("low"), high.alias("high")).where("low <= high")
    within = lambda v: F.least(F.greatest(v, F.col("low")), F.col("high"))
    rows = rows.withColumns({"yr": within(-b / c * F.col("far_x")), "yl": within(b / c * F.col("far_x"))})
    root = lambda y: F.sqrt(F.greatest(F.lit(0.0), b * b * y * y - a * (c * y * y - F.col("level"))))
    right, left = (-b * F.col("yr") + root(F.col("yr"))) / a, (-b * F.col("yl") - root(F.col("yl"))) / a
    x0, x1 = _span((F.col("mean2d_x") + left) / tile, (F.col("mean2d_x") + right) / tile, across("width"))
    rows = computed(rows, *projected.columns, "tile_y", x0.alias("_x0"), x1.alias("_x1")).where("_x1 > _x0")
    return rows.withColumn("tile_x", F.explode(F.sequence(F.col("_x0"), F.col("_x1") - 1))).drop("_x0", "_x1")


def tile_offsets(met: DataFrame, cameras: DataFrame, tile: int = 16) -> DataFrame:
    """(camera_id, tile_y, tile_x, n, start): primitives of each tile, empty ones too, and those before it."""
    across = lambda c: F.ceil(F.col(c) / tile).cast("int")
    grid = cameras.select("camera_id", F.explode(F.sequence(F.lit(0), across("height") - 1)).alias("tile_y"), across("width").alias("w")).select("camera_id", "tile_y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("tile_x"))
    n = met.groupBy("camera_id", "tile_y", "tile_x").agg(F.count("*").alias("n"))
    dense = grid.join(n, ["camera_id", "tile_y", "tile_x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # One row for each tile: first the cameras' totals, then the tiles of each camera.
    before = dense.groupBy("camera_id").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("camera_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("camera_id").orderBy("tile_y", "tile_x").rowsBetween(Window.unboundedPreceding, -1)
    return dense.join(before.select("camera_id", "base"), "camera_id").select("camera_id", "tile_y", "tile_x", "n", (F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("start"))


def near_tiles(rows: DataFrame, limits: DataFrame | None) -> DataFrame:
    """Rows with a tile and a ``stretch`` of depth beside the limits of both; no rows where none are: no pixel looks as deep.

    Rows are dealt out by tile and stretch here, before their pixels are made, and windows of pixels over them take that
    as it is: pairs are not shuffled.
    """
    if limits is None:
        return rows
    key = [*TILE, "stretch"]
    # A hash spares the shuffle of what has no limits, and the join decides; a table by one long is broadcast in 1 MB, one by several columns in pages of up to 64 MB.
    mark = F.xxhash64(F.col("camera_id").cast("string"), *[F.col(c).cast("int") for c in key[1:]])
    rows = rows.withColumn("_mark", mark).join(limits.select(mark.alias("_mark")), "_mark", "left_semi").drop("_mark")
    return rows.join(limits.hint("merge"), key)


def near_pixels(rows: DataFrame, limits: DataFrame | None, tile: int = 16) -> DataFrame:
    """Rows of ``near_tiles`` after their pixels are made, without those whose pixel does not look as deep, with ``BEFORE``."""
    if limits is None:
        return rows
    place = (F.col("y") - F.col("tile_y") * tile) * tile + F.col("x") - F.col("tile_x") * tile + 1
    return rows.withColumns({"start": F.element_at("starts", place), "before": F.element_at("befores", place)}).where("start is not null").drop("starts", "befores")


def pairs(projected: DataFrame, requests: DataFrame | None = None, mask: DataFrame | None = None, tile: int = 16, limits: DataFrame | None = None) -> DataFrame:
    """A row for each pixel and primitive whose alpha there is at least 1/255.

    ``requests`` (camera_id, x, y) keeps only the pixels asked for; ``mask`` (camera_id, tile_x,
    tile_y) drops all pixels of the tiles that it lists; ``limits`` says how deep each pixel looks.
    """
    dx, dy = F.col("mean2d_x") - (F.col("x") + 0.5), F.col("mean2d_y") - (F.col("y") + 0.5)
    rows = _cells(projected, requests, mask, tile, limits)
    rows = rows.withColumn("power", 0.5 * (F.col("conic_a") * dx * dx + F.col("conic_c") * dy * dy) + F.col("conic_b") * dx * dy)
    rows = computed(rows, *rows.columns, F.least(F.lit(ALPHA_MOST), F.col("opacity") * F.exp(-F.col("power"))).alias("alpha"))
    return rows.where((F.col("power") >= 0) & (F.col("alpha") >= ALPHA_LEAST)).drop("power")


def _cells(projected: DataFrame, requests: DataFrame | None, mask: DataFrame | None, tile: int, limits: DataFrame | None = None) -> DataFrame:
    """A row for each primitive and pixel of its box; with requests, a mask or limits, tiles are joined before pixels are made."""
    if requests is None and mask is None and limits is None:
        return _spread(projected, 1, F.col("width"), F.col("height"), "x", "y")
    rows = tiles(projected, tile)
    if mask is not None:
        rows = rows.join(mask.select("camera_id", "tile_x", "tile_y"), ["camera_id", "tile_x", "tile_y"], "left_anti")
    rows = near_tiles(rows, limits)
    edge = lambda m, r, sign: F.floor(F.col(m) - F.col(r)) if sign < 0 else F.ceil(F.col(m) + F.col(r))
    if requests is not None:
        cell = lambda c: F.floor(F.col(c) / tile).cast("int")
        asked = requests.select(*PIXEL).distinct().withColumns({"tile_x": cell("x"), "tile_y": cell("y")})
        rows = rows.join(asked, ["camera_id", "tile_x", "tile_y"])
        for at in "xy":
            rows = rows.where((F.col(at) >= edge(f"mean2d_{at}", f"radius_{at}", -1)) & (F.col(at) < edge(f"mean2d_{at}", f"radius_{at}", 1)))
        return near_pixels(rows, limits, tile).select(*projected.columns, "x", "y", *([] if limits is None else BEFORE))
    kept = [*projected.columns, "x", "y", *([] if limits is None else BEFORE)]
    for at, size in (("y", "height"), ("x", "width")):
        low = F.greatest(edge(f"mean2d_{at}", f"radius_{at}", -1), F.col(f"tile_{at}") * tile)
        high = F.least(edge(f"mean2d_{at}", f"radius_{at}", 1), (F.col(f"tile_{at}") + 1) * tile, F.col(size)) - 1
        rows = rows.where(low <= high).withColumn(at, F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return near_pixels(rows, limits, tile).select(*kept)


def ordered(rows: DataFrame) -> DataFrame:
    """``pairs`` in depth order, with ``place`` and the transmittance ``after`` each; ties of the 32-bit depth go by gaussian_id.

    Pairs with limits say what stands before their stretch of depth, so each stretch of a pixel is ordered by itself.
    """
    near = "start" in rows.columns
    order = Window.partitionBy(*PIXEL, *([*TILE[1:], "stretch"] if near else [])).orderBy(F.col("depth").cast("float"), "gaussian_id")
    through, place = F.sum(F.log1p(-F.col("alpha"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(order)
    return rows.withColumns({"after": F.exp(F.col("start") + through if near else through), "place": F.col("before") + place if near else place})


def contributions(rows: DataFrame) -> DataFrame:
    """``ordered`` pairs up to the pixel's saturation, with weight = alpha times transmittance before.

    Transmittance never grows, so the filter keeps what a loop keeps that stops before the first pair that takes it to 1e-4 or less.
    """
    rows = ordered(rows).where(F.col("after") > TRANSMITTANCE_LEAST)
    return rows.withColumn("weight", F.col("alpha") * F.col("after") / (1 - F.col("alpha")))


def gradients(weighted: DataFrame, channel: str) -> DataFrame:
    """(gaussian_id, color, opacity): derivatives of the sum of ``channel`` over all pixels.

    Behind a pair stands what later pairs of its pixel add, which shrinks as its alpha grows: the
    suffix sum of the ordered window.  A clamped alpha passes nothing on to the opacity.
    """
    later = Window.partitionBy(*PIXEL).orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    behind = F.coalesce(F.sum(F.col("weight") * F.col(channel)).over(later), F.lit(0.0))
    by_alpha = F.col(channel) * F.col("after") / (1 - F.col("alpha")) - behind / (1 - F.col("alpha"))
    rows = weighted.select("gaussian_id", "weight", F.when(F.col("alpha") < ALPHA_MOST, by_alpha * F.col("alpha") / F.col("opacity")).otherwise(0.0).alias("v"))
    return rows.groupBy("gaussian_id").agg(F.sum("weight").alias("color"), F.sum("v").alias("opacity"))


def shape_gradients(weighted: DataFrame, channels: list[str]) -> DataFrame:
    """(camera_id, gaussian_id, v_...): derivatives of the sum of ``channels`` over all pixels by opacity, 2-D mean and conic.

    ``v_abs_x`` and ``v_abs_y`` sum the absolute values of what each pixel gives to the mean.  The
    suffix sum behind a pair is that of ``gradients``; a clamped alpha passes nothing on.
    """
    later = Window.partitionBy(*PIXEL).orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    shown = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    rows = weighted.select("camera_id", "gaussian_id", *PIXEL[1:], "place", "alpha", "after", "weight", "opacity", "conic_a", "conic_b", "conic_c", (F.col("mean2d_x") - F.col("x") - 0.5).alias("dx"), (F.col("mean2d_y") - F.col("y") - 0.5).alias("dy"), shown.alias("shown"))
    behind = F.coalesce(F.sum(F.col("weight") * F.col("shown")).over(later), F.lit(0.0))
    by_alpha = F.when(F.col("alpha") < ALPHA_MOST, (F.col("shown") * F.col("after") - behind) / (1 - F.col("alpha"))).otherwise(0.0)
    rows = rows.withColumn("v", by_alpha * F.col("alpha"))
    v, dx, dy, a, b, c = (F.col(n) for n in ("v", "dx", "dy", "conic_a", "conic_b", "conic_c"))
    to_mean = {"x": -v * (a * dx + b * dy), "y": -v * (b * dx + c * dy)}
    sums = {"v_opacity": v / F.col("opacity"), "v_conic_a": -0.5 * v * dx * dx, "v_conic_b": -v * dx * dy, "v_conic_c": -0.5 * v * dy * dy}
    sums |= {f"v_mean_{n}": g for n, g in to_mean.items()} | {f"v_abs_{n}": F.abs(g) for n, g in to_mean.items()}
    return rows.groupBy("camera_id", "gaussian_id").agg(*[F.sum(g).alias(n) for n, g in sums.items()])


def screen_gradients(slopes: DataFrame, projected: DataFrame, cameras: int, absolute: bool = False) -> DataFrame:
    """(gaussian_id, grad2d, n, radius) for densification: summed length of the slopes of 2-D means in
    screens from -1 to 1 and for ``cameras`` cameras, how often a primitive shows, its largest radius as a share of the image.

    ``slopes`` is what ``shape_gradients`` gives; a primitive that shows without any pixel adds 0.
    """
    kind = "v_abs" if absolute else "v_mean"
    rows = projected.join(slopes, ["camera_id", "gaussian_id"], "left")
    x, y = F.col(f"{kind}_x") * F.col("width") / 2 * cameras, F.col(f"{kind}_y") * F.col("height") / 2 * cameras
    long = F.coalesce(F.sqrt(x * x + y * y), F.lit(0.0))
    size = F.greatest("radius_x", "radius_y") / F.greatest("width", "height")
    return rows.groupBy("gaussian_id").agg(F.sum(long).alias("grad2d"), F.count("*").alias("n"), F.max(size).alias("radius"))


def pixels(cameras: DataFrame) -> DataFrame:
    rows = cameras.select("camera_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("camera_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")


def composite(weighted: DataFrame, grid: DataFrame, channels: list[str], background: list[float] | None = None) -> DataFrame:
    """(camera_id, x, y, n, alpha, channels...) for every pixel of ``grid``, empty ones too."""
    sums = weighted.groupBy(*PIXEL).agg(F.count("*").alias("n"), F.sum("weight").alias("alpha"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in channels])
    out = grid.join(sums.hint("merge"), PIXEL, "left")  # as many rows as pixels: nothing to broadcast
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    back = background or [0.0] * len(channels)
    return out.select(*PIXEL, F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("alpha").alias("alpha"), *[(zero(c) + (1 - zero("alpha")) * b).alias(c) for c, b in zip(channels, back, strict=True)])


def contributor_counts(weighted: DataFrame, grid: DataFrame) -> DataFrame:
    """(camera_id, x, y, n, alpha) for every pixel of ``grid``."""
    return composite(weighted, grid, [])


def contributor_lists(weighted: DataFrame) -> DataFrame:
    """(camera_id, x, y, ids, weights): the contributors of each pixel, nearest first."""
    listed = F.array_sort(F.collect_list(F.struct("place", "gaussian_id", "weight")))
    rows = weighted.groupBy(*PIXEL).agg(listed.alias("l"))
    return rows.select(*PIXEL, F.transform("l", lambda e: e["gaussian_id"]).alias("ids"), F.transform("l", lambda e: e["weight"]).alias("weights"))


def top_contributors(weighted: DataFrame, k: int) -> DataFrame:
    """(camera_id, x, y, rank, gaussian_id, weight): the k heaviest of each pixel, ranked by depth."""
    heavy = Window.partitionBy(*PIXEL).orderBy(F.desc("weight"), "place")
    rows = weighted.withColumn("h", F.row_number().over(heavy)).where(F.col("h") <= k)
    deep = Window.partitionBy(*PIXEL).orderBy("place")
    return rows.select(*PIXEL, F.row_number().over(deep).alias("rank"), "gaussian_id", "weight")


def active_tiles(requests: DataFrame, tile: int = 16) -> DataFrame:
    """(camera_id, tile_y, tile_x, n, words): tiles with requested pixels, their number, and a bit for each in words of 64."""
    cell = requests.select("camera_id", F.floor(F.col("y") / tile).cast("int").alias("tile_y"), F.floor(F.col("x") / tile).cast("int").alias("tile_x"), (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int").alias("bit"))
    word = cell.groupBy("camera_id", "tile_y", "tile_x", F.expr("bit div 64").cast("int").alias("w")).agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, bit % 64))").alias("bits"))
    tile_rows = word.groupBy("camera_id", "tile_y", "tile_x").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("l"))
    return tile_rows.select("camera_id", "tile_y", "tile_x", "n", F.array_join(F.transform("l", lambda e: F.concat_ws(":", e["w"].cast("string"), e["bits"].cast("string"))), ",").alias("words"))
