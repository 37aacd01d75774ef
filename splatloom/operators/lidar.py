"""Tiles of a spinning lidar that primitives meet; the azimuth may close to a full circle.

A sensor's tiling is a row with its field of view and three arrays: the tile row of each fine step of
elevation, and the two-dimensional running count of rays over fine cells.  A sensor has few steps, so the
row is small whatever the number of primitives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .project import computed


def ray_counts(rays: DataFrame, steps_azimuth: int, steps_elevation: int) -> DataFrame:
    """(sensor_id, row, col, n): rays before each corner of the fine grid, 0..steps in both directions.

    ``rays`` has sensor_id and the shares u (azimuth) and v (elevation) of the field of view, from 0 to
    1.  Rays are counted by cell first; the running sums go over cells only.
    """
    cell = lambda c, n: F.least(F.floor(F.col(c) * n), F.lit(n - 1)).cast("int")
    counts = rays.select("sensor_id", cell("v", steps_elevation).alias("r"), cell("u", steps_azimuth).alias("c")).groupBy("sensor_id", "r", "c").agg(F.count("*").alias("k"))
    grid = rays.select("sensor_id").distinct().select("sensor_id", F.explode(F.sequence(F.lit(0), F.lit(steps_elevation))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps_azimuth))).alias("col"))
    placed = grid.join(counts.select("sensor_id", (F.col("r") + 1).alias("row"), (F.col("c") + 1).alias("col"), "k"), ["sensor_id", "row", "col"], "left")
    along = placed.withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("sensor_id", "row").orderBy("col")))
    return along.select("sensor_id", "row", "col", F.sum("k").over(Window.partitionBy("sensor_id", "col").orderBy("row")).alias("n"))


def tile_rows(rays: DataFrame, steps_elevation: int, bins: int) -> DataFrame:
    """(sensor_id, step, tile_row): histogram equalisation, so that each row of tiles has about as many rays.

    The tile row of the corner ``step`` is the share of rays below it, in ``bins`` parts.
    """
    cell = F.least(F.floor(F.col("v") * steps_elevation), F.lit(steps_elevation - 1)).cast("int")
    counts = rays.select("sensor_id", (cell + 1).alias("step")).groupBy("sensor_id", "step").agg(F.count("*").alias("k"))
    grid = rays.select("sensor_id").distinct().select("sensor_id", F.explode(F.sequence(F.lit(0), F.lit(steps_elevation))).alias("step"))
    rows = grid.join(counts, ["sensor_id", "step"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    upto, total = F.sum("k").over(Window.partitionBy("sensor_id").orderBy("step")), F.sum("k").over(Window.partitionBy("sensor_id"))
    return rows.select("sensor_id", "step", F.least(F.floor(upto * bins / total), F.lit(bins - 1)).cast("int").alias("tile_row"))


def sensors(rays: DataFrame, views: DataFrame, steps_azimuth: int, steps_elevation: int, bins_elevation: int) -> DataFrame:
    """``views`` (sensor_id, ...) with the arrays ``row_of`` and ``counts`` that ``lidar_tiles`` looks up."""
    rows = tile_rows(rays, steps_elevation, bins_elevation).groupBy("sensor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "tile_row"))), lambda e: e["tile_row"]).alias("row_of"))
    counts = ray_counts(rays, steps_azimuth, steps_elevation).groupBy("sensor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "n"))), lambda e: e["n"]).alias("counts"))
    return views.join(rows, "sensor_id").join(counts, "sensor_id")


def lidar_tiles(primitives: DataFrame, tilings: DataFrame, steps_azimuth: int, steps_elevation: int, bins_azimuth: int, bins_elevation: int) -> DataFrame:
    """(sensor_id, tile_row, tile_col, gaussian_id): the tiles that a primitive's box of angles meets.

    ``primitives`` has sensor_id, gaussian_id, azimuth and elevation from the start of the field of view
    (azimuth in [0, 2 pi)), and the half sizes extent_a and extent_e, in radians.  ``tilings`` has
    sensor_id, span_a, span_e and the arrays of ``sensors``.

    Azimuths are an interval modulo the circle, once around at most.  The view cuts it into parts: what
    the interval, moved by no, one or minus one turn, shares with [0, span_a].  A part counts if it takes all
    fine columns, or if a ray is in its fine cells; a box that covers the view is one part.  The columns are
    those of the parts that count, each once.  Two rules widen them to the whole row: in an open view, parts
    that share a column; in a full circle, a part from one turn back without the part before the end.
    """
    circle, keep = 2 * math.pi, ["sensor_id", "gaussian_id"]
    rows = primitives.join(tilings, "sensor_id").where("extent_a > 0 and extent_e > 0")
    span, low, far = F.col("span_a"), F.col("azimuth") - F.col("extent_a"), F.col("azimuth") + F.col("extent_a")
    step = lambda c: F.greatest(F.lit(0.0), F.least(F.col("span_e"), c)) / F.col("span_e") * steps_elevation
    e0, e1 = F.floor(step(F.col("elevation") - F.col("extent_e"))), F.ceil(step(F.col("elevation") + F.col("extent_e")))
    rows = computed(rows, *keep, "span_a", "row_of", "counts", e0.cast("int").alias("e0"), e1.cast("int").alias("e1"), low.alias("low"), F.least(far, low + circle).alias("high"), ((low <= 0) & (far >= span)).alias("covers"))
    part = lambda turn, a, b: F.struct(F.lit(turn).alias("turn"), (a / span).alias("a"), (b / span).alias("b"))
    moved = [part(turn, F.greatest(F.lit(0.0), F.col("low") + turn * circle), F.least(span, F.col("high") + turn * circle)) for turn in (0, 1, -1)]
    parts = F.when(F.col("covers"), F.array(part(0, F.lit(0.0), span))).otherwise(F.filter(F.array(*moved), lambda p: p["b"] > p["a"]))
    cells = lambda p, n: (F.floor(p["a"] * n).cast("int"), F.ceil(p["b"] * n).cast("int"))
    before = lambda row, col: F.element_at("counts", F.col(row) * (steps_azimuth + 1) + col + 1)

    def counts(p: Column) -> Column:
        first, end = cells(p, steps_azimuth)
        rays = (before("e1", end) - before("e1", first)) - (before("e0", end) - before("e0", first))
        return (end - first >= steps_azimuth) | (rays > 0)

    rows = rows.where("e1 >= 1").withColumn("parts", F.filter(parts, counts)).where(F.size("parts") > 0)
    tile_row = lambda e: F.element_at("row_of", e + 1)
    bins = F.flatten(F.transform("parts", lambda p: F.sequence(cells(p, bins_azimuth)[0], cells(p, bins_azimuth)[1] - 1)))
    rows = computed(rows, *keep, "span_a", F.transform("parts", lambda p: p["turn"]).alias("turns"), bins.alias("bins"), tile_row(F.col("e0")).alias("r0"), tile_row(F.col("e1") - 1).alias("r1")).where("r0 <= r1")
    back_only = F.array_contains("turns", -1) & ~F.array_contains("turns", 0)
    widened = F.when(F.col("span_a") >= circle, back_only).otherwise(F.size(F.array_distinct("bins")) < F.size("bins"))
    columns = F.when(widened, F.sequence(F.lit(0), F.lit(bins_azimuth - 1))).otherwise(F.array_distinct("bins"))
    rows = computed(rows, *keep, "r0", "r1", columns.alias("columns"))
    return rows.select(*keep, "columns", F.explode(F.sequence("r0", "r1")).alias("tile_row")).select("sensor_id", "tile_row", F.explode("columns").alias("tile_col"), "gaussian_id")
