"""Alignment of scenes as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import rotation as R
from splatloom.operators import normalise as N
from splatloom.operators.quantiles import exact_quantiles
from splatloom.sources import views as V

from .common import r4


def scene_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Of the returned points of each sensor: the median point, and the variances along the principal axes."""
    points = V.points(spark, folder).select(F.pmod("point_id", F.lit(25)).cast("int").alias("scene_id"), "x", "y", "z")
    found = N.principal_axes(points)
    turned = N.transformed(exact_quantiles(points, ["scene_id"], ["x", "y", "z"]), found, "scene_id")
    zero = turned.select("scene_id", (F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) < 1e-9).alias("centred"))
    return found.join(zero, "scene_id").select("scene_id", "centred", *[r4(f"spread{i}").alias(f"spread{i}") for i in range(3)])


def scene_upright(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity that normalises each track's poses, taken as cameras."""
    keys = V.pose_keys(spark, folder)
    turn = R.rotation(R.columns("qw", "qx", "qy", "qz"))
    cameras = keys.select(F.col("track_id").alias("scene_id"), *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], F.col("tx").alias("t0"), F.col("ty").alias("t1"), F.col("tz").alias("t2"))
    return N.upright(cameras).select("scene_id", *[r4(c).alias(c) for c in (*N.MATRIX, "scale")])


def exact_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and ninth deciles of prices and discounts for each part of the year."""
    rows = V.table(spark, folder, "lineitem").select(F.quarter("l_shipdate").alias("quarter"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"))
    middle, high = exact_quantiles(rows, ["quarter"], ["price", "discount"]), exact_quantiles(rows, ["quarter"], ["price", "discount"], 0.9)
    return middle.join(high.withColumnsRenamed({"price": "high_price", "discount": "high_discount"}), "quarter").select("quarter", *[r4(c).alias(c) for c in ("price", "discount", "high_price", "high_discount")])


QUERIES = {f.__name__: f for f in (scene_axes, scene_upright, exact_medians)}

SQL = {
    # The roots of the characteristic polynomial of a symmetric 3x3 matrix, by its angle.
    "scene_axes": """with p as (select ((l_orderkey*8 + l_linenumber) % 25)::int as scene_id, l_quantity::double/10 as x, l_discount::double*50 as y, l_extendedprice::double/20000 as z from lineitem),
c as (select scene_id, var_samp(x) as xx, var_samp(y) as yy, var_samp(z) as zz, covar_samp(x, y) as xy, covar_samp(x, z) as xz, covar_samp(y, z) as yz from p group by 1),
q as (select *, (xx + yy + zz)/3 as m, sqrt((pow(xx - (xx + yy + zz)/3, 2) + pow(yy - (xx + yy + zz)/3, 2) + pow(zz - (xx + yy + zz)/3, 2) + 2*(xy*xy + xz*xz + yz*yz))/6) as s from c),
d as (select *, acos(greatest(-1, least(1, (((xx - m)*((yy - m)*(zz - m) - yz*yz) - xy*(xy*(zz - m) - yz*xz) + xz*(xy*yz - (yy - m)*xz))/(s*s*s))/2)))/3 as a from q),
e as (select scene_id, m + 2*s*cos(a) as e0, m + 2*s*cos(a + 2*pi()/3) as e2, m from d)
select scene_id, true as centred, round(e0, 4) + 0 as spread0, round(3*m - e0 - e2, 4) + 0 as spread1, round(e2, 4) + 0 as spread2 from e""",
    # These poses turn about z only, so the alignment does too, and the viewing axes are z.
    "scene_upright": """with k as (select user_id as scene_id, value/10 as tx, value/20 - 1 as ty, 0.5::double as tz, value/50::double as a from events where event_type = 'view'),
u as (select scene_id, avg(sin(a)) as u, avg(-cos(a)) as v from k group by 1), n as (select scene_id, -v/sqrt(u*u + v*v) as c, -u/sqrt(u*u + v*v) as s from u),
p as (select scene_id, c, s, c*tx - s*ty as px, s*tx + c*ty as py, tz as pz from k join n using (scene_id)),
m as (select scene_id, median(px) as mx, median(py) as my, 0::double as mz from p group by 1),
f as (select scene_id, any_value(c) as c, any_value(s) as s, any_value(mx) as mx, any_value(my) as my, 1/median(sqrt((px - mx)*(px - mx) + (py - my)*(py - my) + (pz - mz)*(pz - mz))) as scale from p join m using (scene_id) group by 1)
select scene_id, round(scale*c, 4) + 0 as a00, round(-scale*s, 4) + 0 as a01, 0::double as a02, round(-scale*mx, 4) + 0 as a03, round(scale*s, 4) + 0 as a10, round(scale*c, 4) + 0 as a11, 0::double as a12, round(-scale*my, 4) + 0 as a13,
  0::double as a20, 0::double as a21, round(scale, 4) + 0 as a22, 0::double as a23, round(scale, 4) + 0 as scale from f""",
    "exact_medians": """with p as (select quarter(l_shipdate)::int as quarter, l_extendedprice::double as p, l_discount::double as d from lineitem)
select quarter, round(quantile_cont(p, 0.5), 4) + 0 as price, round(quantile_cont(d, 0.5), 4) + 0 as discount, round(quantile_cont(p, 0.9), 4) + 0 as high_price, round(quantile_cont(d, 0.9), 4) + 0 as high_discount from p group by 1""",
}
