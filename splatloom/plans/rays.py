"""Unscented projection, undistorted lenses, rays of moving cameras and compositing along rays, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import lenses
from splatloom.operators import composite as C
from splatloom.operators import rays, segments, unscented
from splatloom.sources import views as V

from . import geometry, rendering
from .common import r4

_SHOWN = ("mean2d_x", "mean2d_y", "depth", "conic_a", "conic_b", "conic_c", "compensation")


def _scene(spark: SparkSession, folder: str) -> DataFrame:
    return V.gaussians(spark, folder).drop(*[f"e{i}" for i in range(1, 17)])


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("camera_id", "gaussian_id", *[r4(c).alias(c) for c in _SHOWN], "radius_x", "radius_y")


def project_ut(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives through pinhole cameras by the unscented transform."""
    return _named(unscented.project_unscented(_scene(spark, folder), V.cameras(spark, folder)))


def project_ut_lens(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives through distorted lenses, only those whose seven points are all seen."""
    return _named(unscented.project_unscented(_scene(spark, folder), V.cameras(spark, folder), distortion=geometry.LENS, all_seen=True))


def undistort(spark: SparkSession, folder: str) -> DataFrame:
    """Slopes of the undistorted ray through every pixel centre, and where the lens puts that ray."""
    rows = geometry.grid(spark, folder)
    u, v = (F.col("x") + 0.5 - F.col("cx")) / F.col("fx"), (F.col("y") + 0.5 - F.col("cy")) / F.col("fy")
    rows = rows.select("camera_id", "x", "y", "fx", "fy", "cx", "cy", F.inline(F.array(lenses.opencv_undistorted(u, v, geometry.LENS))))
    radial, du, dv = lenses.opencv_distortion(F.col("u"), F.col("v"), geometry.LENS)
    back = F.col("fx") * (radial * F.col("u") + du) + F.col("cx"), F.col("fy") * (radial * F.col("v") + dv) + F.col("cy")
    return rows.select("camera_id", "x", "y", r4("u").alias("u"), r4("v").alias("v"), r4(back[0]).alias("back_x"), r4(back[1]).alias("back_y"))


def shutter_rays(spark: SparkSession, folder: str) -> DataFrame:
    """The world ray of every pixel of cameras that turn and move while they are read, in four directions."""
    ways = F.array(*[F.lit(n) for n in ("down", "right", "up", "left")])
    cameras = geometry.moving_cameras(spark, folder).withColumn("shutter", F.element_at(ways, F.pmod("camera_id", F.lit(4)) + 1))
    points = geometry.grid(spark, folder).select("camera_id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    found = rays.shutter_rays(points, cameras)
    return found.select("camera_id", "x", "y", *[r4(c).alias(c) for c in ("time", "ox", "oy", "oz", "dx", "dy", "dz")])


def composite_eval3d(spark: SparkSession, folder: str) -> DataFrame:
    """Colours, hit distances and normals of every pixel, with alphas along the pixels' rays."""
    cameras = V.cameras(spark, folder)
    seen = unscented.project_unscented(rays.with_precision(_scene(spark, folder)), cameras)
    channels = ["c0", "c1", "c2", "hit", "nx", "ny", "nz"]
    pairs = segments.near_pairs(seen, C.pixels(cameras), lambda rows, mask, limits: rays.ray_pairs(rows, cameras, mask=mask, limits=limits))
    image = C.composite(C.contributions(pairs), C.pixels(cameras), channels)
    return image.select("camera_id", "x", "y", "n", *[r4(c).alias(c) for c in ("alpha", *channels)])


QUERIES = {f.__name__: f for f in (project_ut, project_ut_lens, undistort, shutter_rays, composite_eval3d)}

_SPREAD, _WM, _WC, _WO = unscented.weights(0.1, 2.0, 0.0)
_D = lambda x: f"{float(x)!r}::double"
_K = {n: _D(v) for n, v in geometry.LENS.items()}
_RADIAL = lambda u, v: f"((1 + {_RR(u, v)}*({_K['k1']} + {_RR(u, v)}*({_K['k2']} + {_RR(u, v)}*{_K['k3']})))/(1 + {_RR(u, v)}*({_K['k4']} + {_RR(u, v)}*({_K['k5']} + {_RR(u, v)}*{_K['k6']}))))"
_RR = lambda u, v: f"({u}*{u} + {v}*{v})"
_DU = lambda u, v: f"(2*{u}*{v}*{_K['p1']} + {_K['p2']}*({_RR(u, v)} + 2*{u}*{u}) + {_RR(u, v)}*({_K['s1']} + {_RR(u, v)}*{_K['s2']}))"
_DV = lambda u, v: f"({_K['p1']}*({_RR(u, v)} + 2*{v}*{v}) + 2*{u}*{v}*{_K['p2']} + {_RR(u, v)}*({_K['s3']} + {_RR(u, v)}*{_K['s4']}))"
_TURN = """rot as (select *, 1 - 2*(qy*qy + qz*qz) as m00, 2*(qx*qy - qw*qz) as m01, 2*(qx*qz + qw*qy) as m02, 2*(qx*qy + qw*qz) as m10, 1 - 2*(qx*qx + qz*qz) as m11,
  2*(qy*qz - qw*qx) as m12, 2*(qx*qz - qw*qy) as m20, 2*(qy*qz + qw*qx) as m21, 1 - 2*(qx*qx + qy*qy) as m22 from gaussians)"""


def _unscented(lens: bool, slopes: str = "", placed: str = "") -> str:
    """CTEs up to ``seen``; the cameras turn about y only and stand at the origin.

    ``slopes`` and ``placed`` are another lens in terms of {k}, the number of the point.
    """
    arms = ", ".join(f"{_D(_SPREAD)}*(r00*m0{j} + r02*m2{j})*s{a} as b0{j}, {_D(_SPREAD)}*m1{j}*s{a} as b1{j}, {_D(_SPREAD)}*(r20*m0{j} + r22*m2{j})*s{a} as b2{j}" for j, a in enumerate("xyz"))
    signs = [("", 0), *((s, j) for s in "+-" for j in range(3))]
    points = ", ".join(f"p{i}{f' {s} b{i}{j}' if s else ''} as k{k}{i}" for k, (s, j) in enumerate(signs) for i in range(3))
    slopes = ", ".join(slopes.format(k=k) for k in range(7)) if slopes else ", ".join(f"k{k}0/k{k}2 as u{k}, k{k}1/k{k}2 as v{k}" for k in range(7))
    if placed:
        placed = ", ".join(placed.format(k=k) for k in range(7))
    elif lens:
        placed = ", ".join(f"fx*({_RADIAL(f'u{k}', f'v{k}')}*u{k} + {_DU(f'u{k}', f'v{k}')}) + cx as x{k}, fy*({_RADIAL(f'u{k}', f'v{k}')}*v{k} + {_DV(f'u{k}', f'v{k}')}) + cy as y{k}, k{k}2 > 0 and {_RADIAL(f'u{k}', f'v{k}')} > 0.8::double as o{k}" for k in range(7))
    else:
        placed = ", ".join(f"case when k{k}2 > 0 then fx*u{k} + cx else 0 end as x{k}, case when k{k}2 > 0 then fy*v{k} + cy else 0 end as y{k}, k{k}2 > 0 as o{k}" for k in range(7))
    ok = f" {'and' if lens else 'or'} ".join(f"coalesce(o{k} and x{k} >= -6.4::double and x{k} < 70.4::double and y{k} >= -4.8::double and y{k} < 52.8::double, false)" for k in range(7))
    mean = ", ".join(f"{_D(_WM)}*{n}0 + {_D(_WO)}*({' + '.join(f'{n}{k}' for k in range(1, 7))}) as mean2d_{n}" for n in "xy")
    cov = lambda n, o: f"{_D(_WC)}*({n}0 - mean2d_{n})*({o}0 - mean2d_{o}) + {_D(_WO)}*({' + '.join(f'({n}{k} - mean2d_{n})*({o}{k} - mean2d_{o})' for k in range(1, 7))})"
    return f"""{V.GAUSSIANS}, {V.CAMERAS}, {_TURN},
posed as (select camera_id, gaussian_id, opacity, c0, c1, c2, fx, fy, cx, cy, width, height, r00*mx + r02*mz as p0, my as p1, r20*mx + r22*mz as p2, {arms} from rot cross join cameras),
apart as (select *, {points} from posed where p2 >= 0.01::double and p2 <= 1e10), sloped as (select *, {slopes} from apart), placed as (select *, {placed} from sloped),
averaged as (select *, p2 as depth, {mean} from placed where {ok}),
spread as (select *, {cov('x', 'x')} as a0, {cov('x', 'y')} as b, {cov('y', 'y')} as d0 from averaged),
blurred as (select *, a0 + 0.3::double as a, d0 + 0.3::double as d, (a0 + 0.3::double)*(d0 + 0.3::double) - b*b as det from spread),
strong as (select *, sqrt(greatest((a0*d0 - b*b)/det, 0.000025::double)) as compensation, (a + d)/2 as h from blurred where det > 0 and a > 0 and d > 0),
ext as (select *, least(3.33::double, sqrt(2*ln(opacity*compensation*255))) as k, sqrt(h + sqrt(greatest(h*h - det, 0.01::double))) as l, (a + 0.000001::double)*(d + 0.000001::double) - b*b as inv from strong where opacity*compensation >= 1e0/255),
boxed as (select *, ceil(k*least(sqrt(a), l))::int as radius_x, ceil(k*least(sqrt(d), l))::int as radius_y, (d + 0.000001::double)/inv as conic_a, -b/inv as conic_b, (a + 0.000001::double)/inv as conic_c from ext),
seen as (select * from boxed where (radius_x > 0 or radius_y > 0) and mean2d_x + radius_x > 0 and mean2d_x - radius_x < width and mean2d_y + radius_y > 0 and mean2d_y - radius_y < height)"""


def _undistorted(rounds: int = 10) -> str:
    sql = "select *, du as u, dv as v from slopes"
    for _ in range(rounds):
        sql = f"select * exclude (u, v), (du - {_DU('u', 'v')})/{_RADIAL('u', 'v')} as u, (dv - {_DV('u', 'v')})/{_RADIAL('u', 'v')} as v from ({sql})"
    return sql


_PIXELS = "slopes as (select c.*, i::int as x, j::int as y, (i + 0.5::double - cx)/fx as du, (j + 0.5::double - cy)/fy as dv from cameras c, unnest(range(64)) s(i), unnest(range(48)) t(j))"
_SHOW = f"select camera_id, gaussian_id, {', '.join(f'round({c}, 4) + 0 as {c}' for c in _SHOWN)}, radius_x, radius_y from seen"
_M = lambda i, v: f"(m0{i}*{v[0]} + m1{i}*{v[1]} + m2{i}*{v[2]})/s{'xyz'[i]}"
_ALONG = f"""{_unscented(False)},
cells as (select s.camera_id, s.gaussian_id, s.opacity, s.c0, s.c1, s.c2, s.depth, (tx*16 + i)::int as x, (ty*16 + j)::int as y from seen s, unnest(range(greatest(floor((mean2d_x - radius_x)/16), 0)::int, least(ceil((mean2d_x + radius_x)/16), 4)::int)) a(tx),
  unnest(range(greatest(floor((mean2d_y - radius_y)/16), 0)::int, least(ceil((mean2d_y + radius_y)/16), 3)::int)) b(ty), unnest(range(16)) c(i), unnest(range(16)) d(j)),
rays as (select k.*, g.* exclude (gaussian_id, opacity, c0, c1, c2), r00*u + r20 as vx, v as vy, r02*u + r22 as vz from (select k.*, (x + 0.5::double - 32)/60 as u, (y + 0.5::double - 24)/60 as v, r00, r02, r20, r22 from cells k join cameras using (camera_id)) k join rot g on g.gaussian_id = k.gaussian_id),
local_ as (select *, {', '.join(f"{_M(i, ('vx', 'vy', 'vz'))} as g{i}, -{_M(i, ('mx', 'my', 'mz'))} as o{i}" for i in range(3))} from rays),
unit_ as (select * replace (g0/l as g0, g1/l as g1, g2/l as g2) from (select *, sqrt(g0*g0 + g1*g1 + g2*g2) as l from local_)),
near_ as (select *, -(g0*o0 + g1*o1 + g2*o2) as t, (g1*o2 - g2*o1)*(g1*o2 - g2*o1) + (g2*o0 - g0*o2)*(g2*o0 - g0*o2) + (g0*o1 - g1*o0)*(g0*o1 - g1*o0) as far from unit_),
alphas as (select *, least(0.99::double, opacity*exp(-far/2)) as alpha, t*sqrt(sx*sx*g0*g0 + sy*sy*g1*g1 + sz*sz*g2*g2) as hit, case when m02*vx + m12*vy + m22*vz > 0 then -1 else 1 end as side from near_ where t >= 0),
ordered as (select *, exp(sum(ln(1 - alpha)) over (partition by camera_id, x, y order by depth::float, gaussian_id rows unbounded preceding)) as after_ from alphas where alpha >= 1e0/255),
weighted as (select *, alpha*after_/(1 - alpha) as weight from ordered where after_ > 1e-4),
sums as (select camera_id, x, y, count(*) as n, sum(weight) as alpha, {', '.join(f'sum(weight*{e}) as {c}' for c, e in (('c0', 'c0'), ('c1', 'c1'), ('c2', 'c2'), ('hit', 'hit'), ('nx', 'side*m02'), ('ny', 'side*m12'), ('nz', 'side*m22')))} from weighted group by all){rendering.GRID}"""
SQL = {
    "project_ut": f"with {_unscented(False)} {_SHOW}",
    "project_ut_lens": f"with {_unscented(True)} {_SHOW}",
    "undistort": f"with {V.CAMERAS}, {_PIXELS} select camera_id, x, y, round(u, 4) + 0 as u, round(v, 4) + 0 as v, round(fx*({_RADIAL('u', 'v')}*u + {_DU('u', 'v')}) + cx, 4) + 0 as back_x, round(fy*({_RADIAL('u', 'v')}*v + {_DV('u', 'v')}) + cy, 4) + 0 as back_y from ({_undistorted()})",
    "shutter_rays": f"""with {V.CAMERAS}, {_PIXELS}, timed as (select *, case camera_id % 4 when 0 then y/47::double when 1 then x/63::double when 2 then (47 - y)/47::double else (63 - x)/63::double end as s, (camera_id - 12)*0.02::double as a, sqrt(du*du + dv*dv + 1) as l from slopes),
turned as (select *, 2*atan2((1 - s)*sin(a/2) + s*sin((a + 0.05::double)/2), (1 - s)*cos(a/2) + s*cos((a + 0.05::double)/2)) as g from timed)
select camera_id, x + 0.5::double as x, y + 0.5::double as y, round(s, 4) + 0 as time, round(-cos(g)*s*0.1::double, 4) + 0 as ox, 0::double as oy, round(-sin(g)*s*0.1::double, 4) + 0 as oz,
  round((cos(g)*du - sin(g))/l, 4) + 0 as dx, round(dv/l, 4) + 0 as dy, round((sin(g)*du + cos(g))/l, 4) + 0 as dz from turned""",
    "composite_eval3d": f"with {_ALONG} select g.camera_id, g.x, g.y, coalesce(n, 0) as n, {', '.join(f'round(coalesce({c}, 0), 4) + 0 as {c}' for c in ('alpha', 'c0', 'c1', 'c2', 'hit', 'nx', 'ny', 'nz'))} from grid g left join sums s on s.camera_id = g.camera_id and s.x = g.x and s.y = g.y",
}
