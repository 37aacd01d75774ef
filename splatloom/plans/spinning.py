"""Spinning lidars on moving mounts as queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import spinning as P
from splatloom.sources import views as V

from .common import r4

#: Fixed values of the sample sensors: rows, columns, grid factor; the view; the turn of the mount about its axis.
ROWS, COLUMNS, FACTOR = 6, 40, 3
SPAN, FROM_ELEVATION, SPAN_ELEVATION, TURN = 5.0, 1.5, 2.9, 0.3


def _sensors(spark: SparkSession, folder: str) -> DataFrame:
    """A sensor on each nation's mount, which turns and moves during a sweep."""
    i = F.col("n_nationkey").cast("double")
    start = 3.0 - 0.05 * i
    down = F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda k: F.lit(FROM_ELEVATION) - F.lit(SPAN_ELEVATION) * k / (ROWS - 1))
    around = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS - 1)), lambda k: start - F.lit(SPAN) * k / COLUMNS)
    offsets = F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda k: F.lit(-0.004) * k)
    pose = {"aw": 1.0, "ax": 0.0, "ay": 0.0, "az": 0.0, "at0": -2.5, "at1": -2.5, "bw": math.cos(TURN / 2), "bx": 0.0, "by": 0.0, "bz": math.sin(TURN / 2), "bt0": -2.4, "bt1": -2.45}
    columns = {"row_elevations": down, "column_azimuths": around, "row_offsets": offsets, "from_azimuth": start, "span_azimuth": F.lit(SPAN), "spin": F.lit(-1), "from_elevation": F.lit(FROM_ELEVATION), "span_elevation": F.lit(SPAN_ELEVATION)}
    columns |= {n: F.lit(v) for n, v in pose.items()} | {"at2": -1 - 0.02 * i, "bt2": -1.1 - 0.02 * i}
    return V.table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("sensor_id"), *[c.alias(n) for n, c in columns.items()])


def lidar_column_map(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest element of each grid point of each sensor."""
    return P.column_map(_sensors(spark, folder), FACTOR)


def lidar_angles_of_points(spark: SparkSession, folder: str) -> DataFrame:
    """Angles, element and time at which each point is seen by its sensor while that turns and moves."""
    sensors = _sensors(spark, folder)
    points = V.points(spark, folder).select(F.pmod("point_id", F.lit(25)).cast("int").alias("sensor_id"), "point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    seen = P.to_angles(points, sensors, P.column_map(sensors, FACTOR), FACTOR, rounds=6)
    return seen.select("sensor_id", "point_id", "row", "col", "settled", "valid", *[r4(c).alias(c) for c in ("elevation", "azimuth", "time")])


def lidar_points_there_and_back(spark: SparkSession, folder: str) -> DataFrame:
    """Of each sensor and row: elements whose point, at the distance of a returned one, is seen by the same element again."""
    sensors = _sensors(spark, folder)
    rays = P.element_rays(sensors).withColumn("point_id", F.col("row") * COLUMNS + F.col("col"))
    far = V.points(spark, folder).groupBy(F.pmod("point_id", F.lit(ROWS * COLUMNS)).cast("int").alias("point_id")).agg((2 + F.max("z")).alias("far"))
    points = rays.join(far, "point_id").select("sensor_id", "point_id", *[(F.col(f"o{n}") + F.col("far") * F.col(f"d{n}")).alias(f"p{n}") for n in "xyz"])
    seen = P.to_angles(points, sensors, P.column_map(sensors, FACTOR), FACTOR)
    return seen.groupBy("sensor_id", F.floor(F.col("point_id") / COLUMNS).cast("int").alias("row_of")).agg(F.count("*").alias("n"), F.sum((F.col("valid") & (F.col("row") * COLUMNS + F.col("col") == F.col("point_id"))).cast("long")).alias("same"))


QUERIES = {f.__name__: f for f in (lidar_column_map, lidar_angles_of_points, lidar_points_there_and_back)}

_TAU, _PI = f"{2 * math.pi!r}::double", f"{math.pi!r}::double"
_MOD = lambda e: f"(({e}) - {_TAU}*floor(({e})/{_TAU}))"
_START = "(3.0::double - 0.05::double*sensor_id)"
# Every grid point is held against every element.
_MAP = f"""sens as (select n_nationkey::int as sensor_id from nation),
elem as (select sensor_id, r::int as row, c::int as col, {FROM_ELEVATION}::double - {SPAN_ELEVATION}::double*r/{ROWS - 1} as el, {_START} - {SPAN}::double*c/{COLUMNS} - 0.004::double*r as az from sens, unnest(range({ROWS})) a(r), unnest(range({COLUMNS})) b(c)),
grid as (select sensor_id, i::int as cell_row, j::int as cell_col, {FROM_ELEVATION}::double - {SPAN_ELEVATION}::double*i/{ROWS * FACTOR - 1} as gel, {_START} - {SPAN}::double*j/{COLUMNS * FACTOR - 1} as gaz from sens, unnest(range({ROWS * FACTOR})) a(i), unnest(range({COLUMNS * FACTOR})) b(j)),
cmap as materialized (select sensor_id, cell_row, cell_col, b.row as row, b.col as col from (select g.sensor_id, cell_row, cell_col, min(struct_pack(d := round(2 - 2*(sin(el)*sin(gel) + cos(el)*cos(gel)*cos(az - gaz)), 12), row := row, col := col)) as b from grid g join elem e on e.sensor_id = g.sensor_id group by all))"""


def _round(k: int) -> str:
    """CTEs of round k: angles at the time of the round before, and the element found there."""
    moved = [f"{a}::double + tm*({b - a!r}::double)" for a, b in ((-2.5, -2.4), (-2.5, -2.45))] + ["-1 - 0.02::double*sensor_id - 0.1::double*tm"]
    turn = f"{TURN}::double*tm"
    down = f"least(1, greatest(0, ({FROM_ELEVATION}::double - el)/{SPAN_ELEVATION}::double))"
    ends = f"case when turned <= {SPAN}::double then turned/{SPAN}::double when turned - {SPAN}::double <= {_TAU} - turned then 1 else 0 end"
    return f"""k{k} as (select *, cos({turn})*px - sin({turn})*py + {moved[0]} as k0, sin({turn})*px + cos({turn})*py + {moved[1]} as k1, pz + {moved[2]} as k2 from p{k - 1}),
g{k} as (select *, atan2(k2, sqrt(k0*k0 + k1*k1)) as el, atan2(k1, k0) as az from k{k}), t{k} as (select *, {_MOD(f'({_START} - az)')} as turned from g{k}),
c{k} as (select *, round({down}*{ROWS * FACTOR - 1})::int as i, round(({ends})*{COLUMNS * FACTOR - 1})::int as j, (turned <= {SPAN}::double + 1e-9 or turned >= {_TAU} - 1e-9) and abs({FROM_ELEVATION}::double - el - {SPAN_ELEVATION / 2}::double) <= {SPAN_ELEVATION / 2}::double*(1 + 2e-9) as inside from t{k}),
f{k} as materialized (select c.sensor_id, point_id, px, py, pz, el, az, tm, m.row, m.col, inside, m.col/{COLUMNS - 1}::double as again from c{k} c join cmap m on m.sensor_id = c.sensor_id and m.cell_row = i and m.cell_col = j),
p{k} as (select sensor_id, point_id, px, py, pz, again as tm from f{k} where again <> tm)"""


_ROUNDS = 6
SQL = {
    "lidar_column_map": f"with {_MAP} select sensor_id, cell_row, cell_col, row, col from cmap",
    "lidar_angles_of_points": f"""with {_MAP}, p0 as (select ((l_orderkey*8 + l_linenumber) % 25)::int as sensor_id, l_orderkey*8 + l_linenumber as point_id, l_quantity::double/10 as px, l_discount::double*50 as py, l_extendedprice::double/20000 as pz, 0.5::double as tm from lineitem),
{', '.join(_round(k) for k in range(1, _ROUNDS + 1))}, f as ({' union all '.join(f'select * from f{k}' + (' where again = tm' if k < _ROUNDS else '') for k in range(1, _ROUNDS + 1))})
select sensor_id, point_id, row, col, again = tm as settled, inside and again = tm as valid, round(el, 4) + 0 as elevation, round(az, 4) + 0 as azimuth, round(tm, 4) + 0 as time from f""",
    "lidar_points_there_and_back": f"""with far as (select distinct ((l_orderkey*8 + l_linenumber) % {ROWS * COLUMNS})::int as point_id from lineitem)
select n_nationkey::int as sensor_id, (point_id // {COLUMNS})::int as row_of, count(*) as n, count(*) as same from nation cross join far group by all""",
}
