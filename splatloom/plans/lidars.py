"""Tiles of spinning lidars as queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import rotation as R
from splatloom.operators import lidar as L
from splatloom.sources import views as V

#: Fixed values of the sample sensors: fine steps and tiles by azimuth and elevation.
STEPS_A, STEPS_E, BINS_A, BINS_E = 64, 32, 16, 8


def _turn(angle):
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def _rays(spark: SparkSession, folder: str) -> DataFrame:
    """Returned points as shares of the field of view of the sensor that they fall to."""
    angle = F.atan2(F.col("y") - 2.5, F.col("x") - 2.5)
    return V.points(spark, folder).select(F.pmod("point_id", F.lit(25)).cast("int").alias("sensor_id"), (_turn(angle) / (2 * math.pi)).alias("u"), F.least(F.lit(1.0), F.col("z") / 6).alias("v"))


def lidar_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The tile row of each fine step of elevation, by histogram equalisation."""
    return L.tile_rows(_rays(spark, folder), STEPS_E, BINS_E)


def lidar_ray_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rays before each corner of the fine grid."""
    return L.ray_counts(_rays(spark, folder), STEPS_A, STEPS_E)


def lidar_isect(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles that primitives meet, in sensors with a full circle (even) and with 4 radians (odd)."""
    views = V.cameras(spark, folder).select(F.col("camera_id").alias("sensor_id"), *[f"r{i}{j}" for i in range(3) for j in range(3)])
    span = F.when(F.pmod("sensor_id", F.lit(2)) == 0, F.lit(2 * math.pi)).otherwise(4.0)
    tilings = L.sensors(_rays(spark, folder), views.select("sensor_id", span.alias("span_a"), F.lit(1.6).alias("span_e")), STEPS_A, STEPS_E, BINS_E)
    m = R.columns("mx", "my", "mz")
    seen = V.gaussians(spark, folder).select("gaussian_id", *m, F.greatest("sx", "sy", "sz").alias("size")).crossJoin(views)
    seen = seen.select("sensor_id", "gaussian_id", "size", *[R.dot(R.columns(*(f"r{i}{j}" for j in range(3))), m).alias(f"p{i}") for i in range(3)])
    p = R.columns("p0", "p1", "p2")
    extent = F.atan2(3 * F.col("size"), R.norm(p))
    seen = seen.select("sensor_id", "gaussian_id", _turn(F.atan2(p[0], p[2])).alias("azimuth"), (F.atan2(-p[1], R.norm((p[0], p[2]))) + 0.8).alias("elevation"), extent.alias("extent_a"), extent.alias("extent_e"))
    return L.lidar_tiles(seen, tilings, STEPS_A, STEPS_E, BINS_A, BINS_E)


QUERIES = {f.__name__: f for f in (lidar_rows, lidar_ray_counts, lidar_isect)}

_PI = f"{2 * math.pi!r}::double"
_CELLS = f"""returned as (select ((l_orderkey*8 + l_linenumber) % 25)::int as sensor_id, atan2(l_discount::double*50 - 2.5::double, l_quantity::double/10 - 2.5::double) as t, least(1, l_extendedprice::double/20000/6) as v from lineitem),
cells as (select sensor_id, least(floor(v*{STEPS_E}), {STEPS_E - 1})::int as r, least(floor((case when t < 0 then t + {_PI} else t end)/{_PI}*{STEPS_A}), {STEPS_A - 1})::int as c from returned),
per_row as (select sensor_id, r, count(*) as k from cells group by all), totals as (select sensor_id, count(*) as total from cells group by 1),
equal as (select t.sensor_id, s::int as step, least(floor(coalesce(sum(k), 0)*{BINS_E}/total), {BINS_E - 1})::int as tile_row from totals t cross join unnest(range({STEPS_E + 1})) u(s) left join per_row p on p.sensor_id = t.sensor_id and p.r < s group by t.sensor_id, s, total)"""
_CLAMP = lambda e, span: f"greatest(0::double, least({span}, {e}))"
SQL = {
    "lidar_rows": f"with {_CELLS} select * from equal",
    "lidar_ray_counts": f"""with {_CELLS}, g as (select sensor_id, i::int as row, j::int as col from totals, unnest(range({STEPS_E + 1})) u(i), unnest(range({STEPS_A + 1})) v(j)), k as (select sensor_id, r, c, count(*) as k from cells group by all)
select g.sensor_id, g.row, g.col, coalesce(sum(k), 0)::bigint as n from g left join k on k.sensor_id = g.sensor_id and k.r < g.row and k.c < g.col group by all""",
    # Rays of a range of cells are looked for one by one; columns are tested one by one.
    "lidar_isect": f"""with {V.GAUSSIANS}, {V.CAMERAS}, {_CELLS},
p as (select camera_id as sensor_id, gaussian_id, greatest(sx, sy, sz) as size, r00*mx + r02*mz as p0, my as p1, r20*mx + r22*mz as p2, case when camera_id % 2 = 0 then {_PI} else 4::double end as span from gaussians cross join cameras),
a as (select *, atan2(p0, p2) as t, atan2(-p1, sqrt(p0*p0 + p2*p2)) + 0.8::double as el, atan2(3*size, sqrt(p0*p0 + p1*p1 + p2*p2)) as x from p),
b as (select *, az - x as low, least(az + x, az - x + {_PI}) as high, az - x <= 0 and az + x >= span as whole from (select *, case when t < 0 then t + {_PI} else t end as az from a)),
c as (select *, not whole and high > {_PI} as over_, not whole and low < 0 as under_, {_CLAMP('el - x', '1.6::double')} as bottom, {_CLAMP('el + x', '1.6::double')} as top from b),
d as (select *, {_CLAMP('case when whole or low < 0 then 0 else low end', 'span')}/span as a0, {_CLAMP(f'case when whole then span when high > {_PI} then {_PI} else high end', 'span')}/span as a1, {_CLAMP(f'case when under_ then low + {_PI} else 0 end', 'span')}/span as b0,
  {_CLAMP(f'case when over_ then high - {_PI} when under_ then {_PI} else 0 end', 'span')}/span as b1, floor(bottom/1.6::double*{STEPS_E})::int as e0, ceil(top/1.6::double*{STEPS_E})::int as e1 from c),
f as (select *, {', '.join(f'{"ceil" if n[1] == "1" else "floor"}({n}*{k})::int as {q}{n}' for n in ('a0', 'a1', 'b0', 'b1') for q, k in (('f', STEPS_A), ('t', BINS_A)))} from d),
hit as (select f.*, {', '.join(f'(f{q}0 <= 0 and f{q}1 >= {STEPS_A}) or exists (select 1 from cells c where c.sensor_id = f.sensor_id and c.r >= e0 and c.r < e1 and c.c >= f{q}0 and c.c < f{q}1) as in_{q}' for q in 'ab')} from f where x > 0),
spans as (select h.sensor_id, gaussian_id, span, over_, case when in_a then ta0 else 0 end as a0, case when in_a then ta1 else 0 end as a1, case when in_b then tb0 else 0 end as b0, case when in_b then tb1 else 0 end as b1, in_a, in_b,
  lo.tile_row as r0, case when e1 >= 1 then least(up.tile_row + 1, {BINS_E}) else up.tile_row end as r1 from hit h join equal lo on lo.sensor_id = h.sensor_id and lo.step = e0 join equal up on up.sensor_id = h.sensor_id and up.step = greatest(e1 - 1, 0) where in_a or in_b)
select sensor_id, i::int as tile_row, j::int as tile_col, gaussian_id from spans, unnest(range({BINS_E})) u(i), unnest(range({BINS_A})) v(j)
where i >= r0 and i < r1 and ((j >= a0 and j < a1) or (j >= b0 and j < b1) or (span < {_PI} and in_a and in_b and b0 < a1 and a0 < b1) or (span >= {_PI} and over_ and in_b and not in_a))""",
}
