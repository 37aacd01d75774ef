"""Spinning lidars on moving mounts: rays of their elements, the column map, and points back to angles and times.

A sensor is a row: sensor_id, the arrays row_elevations, column_azimuths and row_offsets, the field of view (azimuth
``from_azimuth`` and ``span_azimuth`` in the direction ``spin``, 1 or -1; elevation ``from_elevation`` and
``span_elevation``, downwards), and poses world-to-sensor at the first and the last column: quaternions aw..az and
bw..bz, shifts at0..2 and bt0..2.  A column is read at its share of the turn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatloom.functions import lenses
from splatloom.functions import rotation as R
from splatloom.sources.tables import written

from .project import computed

CIRCLE = 2 * math.pi
POSES = [c for k in "ab" for c in (*(f"{k}{n}" for n in "wxyz"), *(f"{k}t{i}" for i in range(3)))]
VIEW = ["from_azimuth", "span_azimuth", "spin", "from_elevation", "span_elevation", "n_rows", "n_columns"]


def _turned(azimuth: Column) -> Column:
    """How far an azimuth lies behind the start of the view, in the direction of the spin, in [0, 2 pi)."""
    return F.pmod((azimuth - F.col("from_azimuth")) * F.col("spin"), F.lit(CIRCLE))


def _sized(sensors: DataFrame) -> DataFrame:
    return sensors.withColumns({"n_rows": F.size("row_elevations"), "n_columns": F.size("column_azimuths")})


def _posed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the pose at ``time`` between the two poses: q0..3 and t0..2."""
    a, b = R.columns("aw", "ax", "ay", "az"), R.columns("bw", "bx", "by", "bz")
    share = R.slerp_shares(a, b, F.col("time"))
    rows = computed(rows, *keep, "time", *POSES, share[0].alias("_sa"), share[1].alias("_sb"))
    turn = [(F.col("_sa") * x + F.col("_sb") * y).alias(f"_q{i}") for i, (x, y) in enumerate(zip(a, b, strict=True))]
    shift = R.lerp(R.columns("at0", "at1", "at2"), R.columns("bt0", "bt1", "bt2"), F.col("time"))
    rows = computed(rows, *keep, "time", *turn, *[c.alias(f"t{i}") for i, c in enumerate(shift)])
    return computed(rows, *keep, "time", *[c.alias(f"q{i}") for i, c in enumerate(R.normalised(R.columns("_q0", "_q1", "_q2", "_q3")))], "t0", "t1", "t2")


def elements(sensors: DataFrame) -> DataFrame:
    """(sensor_id, row, col, elevation, azimuth, time) of every element; azimuths in (-pi, pi]."""
    rows = _sized(sensors).select("sensor_id", "n_columns", "row_offsets", "column_azimuths", F.posexplode("row_elevations").alias("row", "elevation"))
    rows = rows.select("sensor_id", "n_columns", "row", "elevation", F.get("row_offsets", F.col("row")).alias("offset"), F.posexplode("column_azimuths").alias("col", "at"))
    azimuth = F.lit(math.pi) - F.pmod(F.lit(math.pi) - F.col("at") - F.col("offset"), F.lit(CIRCLE))
    return rows.select("sensor_id", "row", "col", "elevation", azimuth.alias("azimuth"), F.when(F.col("n_columns") > 1, F.col("col") / (F.col("n_columns") - 1)).otherwise(0.5).alias("time"))


def element_rays(sensors: DataFrame) -> DataFrame:
    """``elements`` with their world rays at their own times: origin ox..z and unit direction dx..z."""
    keep = ["sensor_id", "row", "col", "elevation", "azimuth"]
    rows = _posed(elements(sensors).join(sensors.select("sensor_id", *POSES), "sensor_id"), keep)
    back = R.transposed(R.rotation(R.columns("q0", "q1", "q2", "q3")))
    origin = [-c for c in R.apply(back, R.columns("t0", "t1", "t2"))]
    ray = R.apply(back, lenses.direction(F.col("elevation"), F.col("azimuth")))
    return rows.select(*keep, "time", *[c.alias(f"o{n}") for n, c in zip("xyz", origin, strict=True)], *[c.alias(f"d{n}") for n, c in zip("xyz", ray, strict=True)])


def column_map(sensors: DataFrame, factor: int = 4) -> DataFrame:
    """(sensor_id, cell_row, cell_col, row, col): the element whose unit ray is nearest to that of each grid point.

    The grid has ``factor`` times as many rows and columns as the sensor, ends included.  First, the nearest column of
    each row for each azimuth of the grid, by one ordered pass over both; then, for each grid point, the nearest of the rows
    whose elevation alone leaves them a chance.  Of equally near elements, that of the smaller row and column.
    """
    sized = _sized(sensors)
    step = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) * factor - 1))
    share = lambda cell, n: F.when(F.col(n) * factor > 1, F.col(cell) / (F.col(n) * factor - 1)).otherwise(0.0)
    across = sized.select("sensor_id", "span_azimuth", "n_columns", step("n_columns").alias("cell_col"))
    across = across.select("sensor_id", "cell_col", (F.col("span_azimuth") * share("cell_col", "n_columns")).alias("at"))
    down = sized.select("sensor_id", "from_elevation", "span_elevation", "n_rows", step("n_rows").alias("cell_row"))
    down = down.select("sensor_id", "cell_row", (F.col("from_elevation") - F.col("span_elevation") * share("cell_row", "n_rows")).alias("grid_elevation"))
    known = elements(sensors).join(sensors.select("sensor_id", "from_azimuth", "spin"), "sensor_id").select("sensor_id", "row", "col", "elevation", _turned(F.col("azimuth")).alias("at"))
    # A row's columns once before and once behind their turn, so that every azimuth has a neighbour on either side.
    around = known.select("sensor_id", "row", "col", F.explode(F.array(*[F.col("at") + k * CIRCLE for k in (-1, 0, 1)])).alias("at"), F.lit(None).cast("int").alias("cell_col"))
    asked = known.select("sensor_id", "row").distinct().join(across, "sensor_id").select("sensor_id", "row", F.lit(None).cast("int").alias("col"), "at", "cell_col")
    order = Window.partitionBy("sensor_id", "row").orderBy("at", F.col("cell_col").asc_nulls_first(), "col")
    held = F.when(F.col("col").isNotNull(), F.struct("at", "col"))
    both = around.unionByName(asked).withColumns({"before": F.last(held, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "behind": F.first(held, True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    off = lambda side: F.abs(F.col("at") - F.col(f"{side}.at"))
    pick = F.least(F.struct(off("before").alias("off"), F.col("before.col").alias("col")), F.struct(off("behind").alias("off"), F.col("behind.col").alias("col")))
    near = both.where("cell_col is not null").select("sensor_id", "row", "cell_col", pick.alias("p")).select("sensor_id", "row", "cell_col", F.col("p.off").alias("off"), F.col("p.col").alias("col"))
    rows = down.join(known.select("sensor_id", "row", "elevation").distinct(), "sensor_id").withColumn("tilt", F.abs(F.col("elevation") - F.col("grid_elevation")))
    # No grid point is farther from its nearest element than the widest gap of azimuth and that of elevation together.
    tilt = rows.groupBy("sensor_id", "cell_row").agg(F.min("tilt").alias("t")).groupBy("sensor_id").agg(F.max("t").alias("tilt_most"))
    most = near.groupBy("sensor_id").agg(F.max("off").alias("off_most")).join(tilt, "sensor_id")
    rows = rows.join(most, "sensor_id").where(F.col("tilt") <= F.col("off_most") + F.col("tilt_most") + 1e-9)
    met = rows.select("sensor_id", "cell_row", "row", "elevation", "grid_elevation").join(near, ["sensor_id", "row"])
    chord = 2 - 2 * (F.sin("elevation") * F.sin("grid_elevation") + F.cos("elevation") * F.cos("grid_elevation") * F.cos("off"))
    best = met.groupBy("sensor_id", "cell_row", "cell_col").agg(F.min(F.struct(F.round(chord, 12).alias("d"), "row", "col")).alias("b"))
    return best.select("sensor_id", "cell_row", "cell_col", F.col("b.row").alias("row"), F.col("b.col").alias("col"))


def _angles(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, among them the point px..z, and its elevation and azimuth from the pose at ``time``."""
    rows = _posed(rows, keep)
    at = R.apply(R.rotation(R.columns("q0", "q1", "q2", "q3")), R.columns("px", "py", "pz"))
    rows = computed(rows, *keep, "time", *[(c + F.col(f"t{i}")).alias(f"k{i}") for i, c in enumerate(at)])
    return computed(rows, *keep, "time", F.atan2("k2", R.norm(R.columns("k0", "k1"))).alias("elevation"), F.atan2("k1", "k0").alias("azimuth"))


def to_angles(points: DataFrame, sensors: DataFrame, columns: DataFrame, factor: int = 4, rounds: int = 10, first: float = 0.5) -> DataFrame:
    """(sensor_id, point_id, elevation, azimuth, row, col, time, settled, valid) of world points (sensor_id, point_id, px..z).

    A time gives a pose, the pose angles, the angles a grid point, and ``columns`` (see ``column_map``) its element,
    whose column has a time again.  A point whose time comes back as it went in is settled and leaves the rounds; rounds
    end when none is left, or after ``rounds``.  Angles outside the view look up its nearest grid point and are not valid;
    points that did not settle keep their last time.
    """
    held = _sized(sensors).select("sensor_id", *VIEW, *POSES)
    keep = ["sensor_id", "point_id", *VIEW]
    waiting = points.select("sensor_id", "point_id", "px", "py", "pz", F.lit(first).alias("time"))
    done = None
    last = lambda c: F.col(c) * factor - 1
    for k in range(rounds):
        rows = _angles(waiting.join(held, "sensor_id"), [*keep, "px", "py", "pz"])
        rows = computed(rows, *rows.columns, _turned(F.col("azimuth")).alias("turned"), ((F.col("from_elevation") - F.col("elevation")) / F.col("span_elevation")).alias("down"))
        # Beyond the end of the view, the nearer of its two ends.
        ends = F.when(F.col("turned") <= F.col("span_azimuth"), F.col("turned") / F.col("span_azimuth")).when(F.col("turned") - F.col("span_azimuth") <= CIRCLE - F.col("turned"), 1.0).otherwise(0.0)
        inside = (F.col("turned") <= F.col("span_azimuth") + 1e-9) | (F.col("turned") >= CIRCLE - 1e-9)
        valid = inside & (F.col("down") >= -1e-9) & (F.col("down") <= 1 + 1e-9)
        down = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("down")))
        cells = [F.round(down * last("n_rows")).cast("int").alias("cell_row"), F.round(ends * last("n_columns")).cast("int").alias("cell_col")]
        rows = rows.select("sensor_id", "point_id", "px", "py", "pz", "n_columns", "elevation", "azimuth", "time", valid.alias("valid"), *cells)
        rows = rows.join(columns, ["sensor_id", "cell_row", "cell_col"])
        again = F.when(F.col("n_columns") > 1, F.col("col") / (F.col("n_columns") - 1)).otherwise(0.5)
        rows = written(rows.withColumn("again", again).withColumn("settled", F.col("again") == F.col("time")), "lidar")
        ready = rows if k == rounds - 1 else rows.where("settled")
        ready = ready.select("sensor_id", "point_id", "elevation", "azimuth", "row", "col", "time", "settled", (F.col("valid") & F.col("settled")).alias("valid"))
        done = ready if done is None else done.unionByName(ready)
        waiting = rows.where("not settled").select("sensor_id", "point_id", "px", "py", "pz", F.col("again").alias("time"))
        if waiting.isEmpty():
            break
    return done
