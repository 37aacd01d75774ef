"""Spatial joins on a grid: points in boxes, and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import first_of


def _cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def first_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(point_id, x, y, z, box_id): for each distinct point the box of smallest id that holds it, faces included; null if none.

    Of boxes in one place the first counts, and the rest is as with turned boxes.
    """
    places = boxes.groupBy("bx", "by", "bz", "half").agg(F.min("box_id").alias("box_id"))
    return first_of(points, places.select("box_id", "bx", "by", "bz", *[F.col("half").alias(f"h{a}") for a in "xyz"]), [], distinct=True).select("point_id", "x", "y", "z", "box.box_id")


#: Points in one list of ``nearest_neighbours``.
LISTED = 256


def _crowded(points: DataFrame, size: float) -> float:
    """How many points the cell of a point holds in the mean, itself included."""
    counts = points.groupBy(*[_cell(a, size).alias(f"g{a}") for a in "xyz"]).agg(F.count("*").cast("double").alias("n"))
    return counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]


def fitting_cell(points: DataFrame, size: float, most: float) -> float:
    """``size`` halved until a point's cell holds ``most`` points in the mean; where eight halvings in a row part none, as of copies, it is left."""
    best, now = size, _crowded(points, size)
    while now > most and size > best / 256:
        size /= 2
        less = _crowded(points, size)
        if less < 0.9 * now:
            best, now = size, less
    return best


def _lists(points: DataFrame, size: float) -> DataFrame:
    """(bx, by, bz, others): the points (o, ox, oy, oz) of each cell in lists of at most ``LISTED``."""
    cell = [f"b{a}" for a in "xyz"]
    rows = points.select(F.col("point_id").alias("o"), *[F.col(a).alias(f"o{a}") for a in "xyz"], *[_cell(a, size).alias(c) for a, c in zip("xyz", cell, strict=True)])
    rows = rows.withColumn("_part", F.expr(f"row_number() over (partition by {', '.join(cell)} order by o) div {LISTED}"))
    return rows.groupBy(*cell, "_part").agg(F.collect_list(F.struct("o", "ox", "oy", "oz")).alias("others")).drop("_part")


def nearest_neighbours(points: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """(point_id, rank, other_id, distance): the k nearest other points of each point, by distance and id.

    Each point looks into its own grid cell and the 26 around it.  Its result stands if it found k
    points within one cell size, since nothing outside these cells is nearer; the others look again
    on a grid of twice the size, until the grid has but a few cells.  The first grid is as fine as the
    points are dense where most of them are.  Points of a cell meet a look as one list, of which no more than k
    become rows; larger cells hold the same lists.  ``points`` has point_id, x, y, z.
    """
    from splatloom.sources.tables import written

    box = points.agg(F.count("*"), *[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    if box[0] < 2:
        return points.where("false").select("point_id", F.lit(1).alias("rank"), F.col("point_id").alias("other_id"), F.lit(0.0).alias("distance"))
    widest = max(box[2] - box[1], box[4] - box[3], box[6] - box[5], 1e-9)
    size = cell or fitting_cell(points, widest / max(1.0, (box[0] / (k + 1)) ** (1 / 3)), k + 1)
    open_, done = points.select("point_id", "x", "y", "z"), None
    lists, base = written(_lists(points, size), "lists"), size
    while True:
        last = size >= widest
        # Sizes are powers of two times the first, so that a cell holds whole cells of the first grid.
        other = lists.select("others", *[F.floor(F.col(f"b{a}") / (size / base)).alias(f"g{a}") for a in "xyz"])
        looks = open_.select("*", *[F.floor(_cell(a, base) / (size / base)).alias(f"_g{a}") for a in "xyz"])
        for a in "xyz":
            looks = looks.select("*", F.explode(F.sequence(F.col(f"_g{a}") - 1, F.col(f"_g{a}") + 1)).alias(f"g{a}")).drop(f"_g{a}")
        gap = lambda o: F.sqrt(sum(((F.col(a) - o[f"o{a}"]) * (F.col(a) - o[f"o{a}"]) for a in "yz"), (F.col("x") - o["ox"]) * (F.col("x") - o["ox"])))
        met = F.transform(F.filter("others", lambda o: o["o"] != F.col("point_id")), lambda o: F.struct(gap(o).alias("distance"), o["o"].alias("other_id")))
        found = looks.join(other.hint("merge"), ["gx", "gy", "gz"]).select("point_id", F.inline(F.slice(F.array_sort(met), 1, k)))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "other_id"))).where(F.col("rank") <= k)
        ranked = written(ranked.select("point_id", "rank", "other_id", "distance"), "near")
        sure = ranked.groupBy("point_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= size) if not last else F.lit(True)).select("point_id")
        settled = ranked.join(sure, "point_id", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        open_ = written(open_.join(sure, "point_id", "left_anti"), "open")
        if open_.isEmpty():
            return done
        size *= 2
