"""Pose tracks, spatial joins, scene mutation and lidar as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splatloom.operators import mutate, ranks, spatial, tracks
from splatloom.operators.quantiles import exact_quantiles
from splatloom.operators.project import project
from splatloom.sources import views as V

from .common import r4


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return V.pose_keys(spark, folder, "click").select(F.col("key_id").alias("query_id"), "track_id", "t_us")


def track_interpolate(spark: SparkSession, folder: str) -> DataFrame:
    rows = tracks.interpolate(V.pose_keys(spark, folder), _queries(spark, folder))
    return rows.select("query_id", "track_id", *[r4(c).alias(c) for c in tracks.POSE], "exact")


def nearest_track(spark: SparkSession, folder: str) -> DataFrame:
    """The key nearest to each query within an hour; -1 if there is none."""
    rows = tracks.nearest(V.pose_keys(spark, folder), _queries(spark, folder), 3_600_000_000)
    return rows.select("query_id", "track_id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("key_id", "gap_us")])


def points_in_boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spatial.first_box(V.points(spark, folder), V.boxes(spark, folder))
    return rows.select("point_id", "x", "y", "z", F.coalesce("box_id", F.lit(-1)).cast("long").alias("box_id"))


def knn_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Log of the root mean square distance to the 3 nearest other centres."""
    points = V.gaussians(spark, folder).select(F.col("gaussian_id").alias("point_id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    near = spatial.nearest_neighbours(points, 3)
    rows = near.groupBy(F.col("point_id").alias("gaussian_id")).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("d"))
    return rows.select("gaussian_id", r4(F.ln(F.greatest("d", F.lit(1e-6)))).alias("log_scale"))


def densify_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Views, largest radius and summed depth of each primitive that any camera sees."""
    seen = project(V.gaussians(spark, folder).select("gaussian_id", "mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity"), V.cameras(spark, folder))
    rows = seen.groupBy("gaussian_id").agg(F.count("*").alias("n"), F.max(F.greatest("radius_x", "radius_y")).alias("radius"), F.sum("depth").alias("depth"))
    return rows.select("gaussian_id", "n", "radius", r4("depth").alias("depth"))


def duplicate_split_prune(spark: SparkSession, folder: str) -> DataFrame:
    """Small primitives of even components are cloned, large ones split, faint ones removed."""
    rows = V.gaussians(spark, folder).drop(*[f"e{i}" for i in range(1, 17)])
    large = F.greatest("sx", "sy", "sz") > 0.12
    rows = mutate.duplicate(rows, ~large & (F.col("component_id") % 2 == 0))
    rows = mutate.split(rows, large).where("opacity >= 0.2")
    return rows.select("gaussian_id", "origin", "child", *[r4(c).alias(c) for c in ("mx", "my", "mz", "sx", "sy", "sz", "opacity")])


def reset_opacity(spark: SparkSession, folder: str) -> DataFrame:
    return mutate.reset_opacity(V.gaussians(spark, folder), 0.4).select("gaussian_id", r4("logit").alias("logit"))


def relocate(spark: SparkSession, folder: str) -> DataFrame:
    """Opacity and scale factor if a primitive is to stand for one to five copies."""
    rows = V.gaussians(spark, folder).select("gaussian_id", "opacity", (1 + F.pmod("gaussian_id", F.lit(5))).alias("n"))
    opacity, factor = mutate.relocated(F.col("opacity"), F.col("n"))
    return rows.select("gaussian_id", "n", r4(opacity).alias("new_opacity"), r4(factor).alias("factor"))


def adam_step(spark: SparkSession, folder: str) -> DataFrame:
    """A selective step on the centre's x for primitives of opacity over a half."""
    rows = V.gaussians(spark, folder)
    new = mutate.selective_adam(F.col("mx"), F.col("e15"), F.col("e16"), F.col("e14") * F.col("e14"), F.col("opacity") > 0.5)
    return rows.select("gaussian_id", *[r4(c).alias(n) for n, c in zip(("value", "first", "second"), new, strict=True)])


def step_schedules(spark: SparkSession, folder: str) -> DataFrame:
    """For each order taken as a step: its stage and frame of a two-stage run, and the weight of a clamped ramp held for 50 steps."""
    rows = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("step"))
    coarse = F.col("step") < 1000
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.expr("step div 50") * 50 - 500) / F.lit(4000.0)))
    return rows.select("step", F.when(coarse, F.lit("coarse")).otherwise("fine").alias("stage"), F.when(coarse, F.lit(0)).otherwise(F.pmod(F.col("step") - 1000, F.lit(48))).cast("int").alias("frame"), r4(ramp).alias("weight"))


def crop_by_opacity(spark: SparkSession, folder: str) -> DataFrame:
    """The largest square number of primitives, without the faintest ones."""
    rows = V.gaussians(spark, folder)
    n = rows.count()
    return ranks.smallest(rows, -F.col("opacity"), int(n**0.5) ** 2, "gaussian_id").select("gaussian_id", r4("opacity").alias("opacity"))


def opacity_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, quartiles and means of each component's opacity, and rows that are not finite."""
    rows = V.gaussians(spark, folder)
    out = rows.groupBy("component_id").agg(F.count("*").alias("n"), r4(F.avg("opacity")).alias("mean"), F.sum(F.isnan("mx").cast("long")).alias("not_finite"))
    for q in (0.25, 0.5, 0.75):
        found = exact_quantiles(rows, ["component_id"], ["opacity"], q)
        out = out.join(found.select("component_id", r4("opacity").alias(f"q{int(100 * q)}")), "component_id", "left")
    return out


def _angles(spark: SparkSession, folder: str) -> DataFrame:
    points = V.points(spark, folder)
    r = F.sqrt(F.col("x") * F.col("x") + (F.col("y") - 2) * (F.col("y") - 2) + F.col("z") * F.col("z"))
    rows = points.select("point_id", "x", (F.col("y") - 2).alias("y"), "z", r.alias("r"))
    return rows.select("point_id", F.asin(F.col("z") / F.col("r")).alias("elevation"), F.atan2("y", "x").alias("azimuth"))


def lidar_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Elevation, azimuth from the start of a field of view, clockwise, and whether it is inside."""
    full = F.lit(6.283185307179586)
    turn = lambda c: c - full * F.floor(c / full)
    rows = _angles(spark, folder).withColumn("relative", turn(F.lit(1.0) - F.col("azimuth")))
    return rows.select("point_id", r4("elevation").alias("elevation"), r4("azimuth").alias("azimuth"), r4("relative").alias("relative"), (F.col("relative") <= 2.0).alias("inside"))


def lidar_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Returns in tiles of 32 azimuths and 16 equally filled elevation rows, and the sums over all tiles below and left.

    Rows come from the cumulated histogram of 256 elevation bins, so no task sorts all returns.
    """
    rows = _angles(spark, folder)
    rows = rows.select(F.least(F.lit(255), F.floor((F.col("elevation") + 1.6) / 3.2 * 256)).cast("int").alias("bin"), F.least(F.lit(31), F.floor((F.col("azimuth") + 3.2) / 6.4 * 32)).cast("int").alias("col"))
    cells = rows.groupBy("bin", "col").agg(F.count("*").alias("n"))  # at most 256 x 32 rows
    share = cells.groupBy("bin").agg(F.sum("n").alias("n"))
    share = share.select("bin", F.least(F.lit(15), F.floor((F.sum("n").over(Window.orderBy("bin")) - F.col("n")) * 16 / F.sum("n").over(Window.partitionBy()))).cast("int").alias("row"))
    tile = cells.join(share, "bin").groupBy("row", "col").agg(F.sum("n").alias("n"))
    dense = spark.range(512).select(F.expr("cast(id div 32 as int)").alias("row"), (F.col("id") % 32).cast("int").alias("col")).join(tile, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    across = dense.withColumn("a", F.sum("n").over(Window.partitionBy("row").orderBy("col")))
    return across.select("row", "col", "n", F.sum("a").over(Window.partitionBy("col").orderBy("row")).alias("below"))


QUERIES = {
    f.__name__: f
    for f in (track_interpolate, nearest_track, points_in_boxes, knn_scale, densify_stats, duplicate_split_prune, reset_opacity, relocate, adam_step, step_schedules, crop_by_opacity, opacity_quantiles, lidar_angles, lidar_tiles)
}

_KEYS = """k as (select user_id as track_id, epoch_us(ts) as t_us, event_id as key_id, value/10 as tx, value/20 - 1 as ty, 0.5::double as tz, cos(value/50/2) as qw, sin(value/50/2) as qz from events where event_type = 'view'),
q as (select event_id as query_id, user_id as track_id, epoch_us(ts) as t_us from events where event_type = 'click'),
b as (select query_id, max((k.t_us, key_id)) as b from q join k on q.track_id = k.track_id and k.t_us < q.t_us group by 1),
a as (select query_id, min((k.t_us, key_id)) as a from q join k on q.track_id = k.track_id and k.t_us >= q.t_us group by 1),
j as (select q.*, b[1] as bt, b[2] as bk, a[1] as at_, a[2] as ak from q left join b using (query_id) left join a using (query_id))"""
_ANGLES = """p as (select (l_orderkey*8 + l_linenumber)::bigint as point_id, l_quantity/10 as x, l_discount*50 - 2 as y, l_extendedprice/20000 as z from lineitem),
g as (select point_id, asin(z/sqrt(x*x + y*y + z*z)) as elevation, atan2(y, x) as azimuth from p)"""
_COMB = " + ".join(f"(case when n >= {k + 1} then (case n {' '.join(f'when {m} then {__import__("math").comb(m, k + 1)}' for m in range(k + 1, 6))} end) * {'-' if k % 2 else ''}1 / sqrt({k + 1}::double) * pow(o, {k + 1}) else 0 end)" for k in range(5))

from .rendering import PLAIN  # noqa: E402

SQL = {
    "track_interpolate": f"""with {_KEYS}, m as (select j.query_id, j.track_id, j.t_us, x.tx as bx, x.ty as by_, x.qw as bw, x.qz as bz, y.tx as ax, y.ty as ay, y.qw as aw, y.qz as az, bk, ak, at_, (j.t_us - bt)/(at_ - bt)::double as s
  from j left join k x on x.key_id = bk left join k y on y.key_id = ak),
n as (select *, bw*aw + bz*az as d, case when ak is null then 'b' when bk is null or at_ = t_us then 'a' else 'i' end as how from m),
o as (select *, case when abs(d) > 0.9995::double then 1 - s else sin((1 - s)*acos(least(1, abs(d))))/sin(acos(least(1, abs(d)))) end as u, (case when d < 0 then -1 else 1 end)*(case when abs(d) > 0.9995::double then s else sin(s*acos(least(1, abs(d))))/sin(acos(least(1, abs(d)))) end) as v from n),
r as (select *, sqrt((u*bw + v*aw)*(u*bw + v*aw) + (u*bz + v*az)*(u*bz + v*az)) as l from o)
select query_id, track_id, {', '.join(f"round(case when ak is null and bk is null then {z} when how = 'b' then {b} when how = 'a' then {a} else {i} end, 4) + 0 as {n}" for n, b, a, i, z in (
  ('tx', 'bx', 'ax', 'bx + s*(ax - bx)', 0), ('ty', 'by_', 'ay', 'by_ + s*(ay - by_)', 0), ('tz', '0.5::double', '0.5::double', '0.5::double', 0), ('qw', 'bw', 'aw', '(u*bw + v*aw)/l', 1), ('qx', '0::double', '0::double', '0::double', 0), ('qy', '0::double', '0::double', '0::double', 0), ('qz', 'bz', 'az', '(u*bz + v*az)/l', 0)))},
  case when ak is null and bk is null then null else how <> 'i' end as exact from r""",
    "nearest_track": f"""with {_KEYS}, n as (select *, case when at_ is null or t_us - bt <= at_ - t_us then t_us - bt else at_ - t_us end as gap, case when at_ is null or t_us - bt <= at_ - t_us then bk else ak end as key from j)
select query_id, track_id, (case when gap <= 3600000000 then key else -1 end)::bigint as key_id, (case when gap <= 3600000000 then gap else -1 end)::bigint as gap_us from n""",
    "points_in_boxes": """with p as (select distinct (l_orderkey*8 + l_linenumber)::bigint as point_id, l_quantity/10 as x, l_discount*50 as y, l_extendedprice/20000 as z from lineitem),
  b as (select p_partkey::bigint as box_id, p_size/10::double as bx, (p_partkey % 6)::double as b_y, p_retailprice/500 as bz from part),
  m as (select point_id, x, y, z, min(box_id) as box_id from p join b on abs(x - bx) <= 0.15::double and abs(y - b_y) <= 0.15::double and abs(z - bz) <= 0.15::double group by all)
select p.point_id, p.x, p.y, p.z, coalesce(box_id, -1)::bigint as box_id from p left join m on p.point_id = m.point_id and p.x = m.x and p.y = m.y and p.z = m.z""",
    "knn_scale": f"""with {V.GAUSSIANS}, d as (select a.gaussian_id, b.gaussian_id as o, sqrt((a.mx-b.mx)*(a.mx-b.mx) + (a.my-b.my)*(a.my-b.my) + (a.mz-b.mz)*(a.mz-b.mz)) as d from gaussians a join gaussians b on a.gaussian_id <> b.gaussian_id)
select gaussian_id, round(ln(greatest(sqrt(avg(d*d)), 1e-6)), 4) + 0 as log_scale from (select *, row_number() over (partition by gaussian_id order by d, o) as r from d) where r <= 3 group by 1""",
    "densify_stats": f"with {PLAIN} select gaussian_id, count(*) as n, max(greatest(radius_x, radius_y)) as radius, round(sum(depth), 4) + 0 as depth from seen group by 1",
    "duplicate_split_prune": f"""with {V.GAUSSIANS}, d as (select *, greatest(sx, sy, sz) > 0.12::double as large from gaussians), c as (select *, 'kept' as origin from d union all select *, 'clone' from d where not large and component_id % 2 = 0),
s as (select *, 0 as child from c where not large union all select *, 1 from c where large union all select *, -1 from c where large)
select gaussian_id, origin, child, round(mx + child*0.5::double*((1 - 2*(qy*qy + qz*qz))*sx + 2*(qx*qy - qw*qz)*sy + 2*(qx*qz + qw*qy)*sz), 4) + 0 as mx, round(my + child*0.5::double*(2*(qx*qy + qw*qz)*sx + (1 - 2*(qx*qx + qz*qz))*sy + 2*(qy*qz - qw*qx)*sz), 4) + 0 as my,
  round(mz + child*0.5::double*(2*(qx*qz - qw*qy)*sx + 2*(qy*qz + qw*qx)*sy + (1 - 2*(qx*qx + qy*qy))*sz), 4) + 0 as mz, {', '.join(f'round(case when large then s{a}/1.6::double else s{a} end, 4) + 0 as s{a}' for a in 'xyz')}, round(opacity, 4) + 0 as opacity from s where opacity >= 0.2::double""",
    "reset_opacity": f"with {V.GAUSSIANS} select gaussian_id, round(least(ln(opacity/(1 - opacity)), ln(0.4::double/(1 - 0.4::double))), 4) + 0 as logit from gaussians",
    "relocate": f"with {V.GAUSSIANS}, r as (select *, least(greatest(1 - pow(1 - opacity, 1/n::double), 0.005::double), 1 - pow(2::double, -23)) as o from (select gaussian_id, opacity, 1 + gaussian_id % 5 as n from gaussians)) select gaussian_id, n, round(o, 4) + 0 as new_opacity, round(opacity/({_COMB}), 4) + 0 as factor from r",
    "adam_step": f"""with {V.GAUSSIANS}, m as (select *, opacity > 0.5::double as seen, 0.9::double*e16 + (1 - 0.9::double)*e15 as m, 0.999::double*(e14*e14) + (1 - 0.999::double)*e15*e15 as v from gaussians)
select gaussian_id, round(case when seen then mx - 0.01::double*m/(sqrt(v) + 1e-15) else mx end, 4) + 0 as value, round(case when seen then m else e16 end, 4) + 0 as first, round(case when seen then v else e14*e14 end, 4) + 0 as second from m""",
    "step_schedules": "select o_orderkey as step, case when o_orderkey < 1000 then 'coarse' else 'fine' end as stage, (case when o_orderkey < 1000 then 0 else (o_orderkey - 1000) % 48 end)::int as frame, round(least(1, greatest(0, (o_orderkey // 50 * 50 - 500)/4000::double)), 4) + 0 as weight from orders",
    "crop_by_opacity": f"with {V.GAUSSIANS} select gaussian_id, round(opacity, 4) + 0 as opacity from (select *, row_number() over (order by opacity desc, gaussian_id) as r, count(*) over () as total from gaussians) where r <= floor(sqrt(total))*floor(sqrt(total))",
    "opacity_quantiles": f"with {V.GAUSSIANS} select component_id, count(*) as n, {', '.join(f'round(quantile_cont(opacity, {q}), 4) + 0 as q{int(100 * q)}' for q in (0.25, 0.5, 0.75))}, round(avg(opacity), 4) + 0 as mean, sum(isnan(mx)::int)::bigint as not_finite from gaussians group by 1",
    "lidar_angles": f"with {_ANGLES}, t as (select *, (1 - azimuth) - 6.283185307179586::double*floor((1 - azimuth)/6.283185307179586::double) as relative from g) select point_id, round(elevation, 4) + 0 as elevation, round(azimuth, 4) + 0 as azimuth, round(relative, 4) + 0 as relative, relative <= 2 as inside from t",
    "lidar_tiles": f"""with {_ANGLES}, c as (select least(255, floor((elevation + 1.6::double)/3.2::double*256))::int as bin, least(31, floor((azimuth + 3.2::double)/6.4::double*32))::int as col from g),
h as (select bin, least(15, floor((sum(count(*)) over (order by bin) - count(*))*16/(sum(count(*)) over ())::double))::int as row from c group by bin), t as (select row, col, count(*) as n from c join h using (bin) group by all),
d as (select r::int as row, k::int as col, coalesce(n, 0)::bigint as n from unnest(range(16)) a(r) cross join unnest(range(32)) b(k) left join t on t.row = r and t.col = k)
select row, col, n, (select sum(n) from d e where e.row <= d.row and e.col <= d.col)::bigint as below from d""",
}
