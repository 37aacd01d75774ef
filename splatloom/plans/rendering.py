"""Projection, tiles, compositing and contributors as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import composite as C
from splatloom.operators.project import project
from splatloom.operators.render import rasterize
from splatloom.operators.segments import composite as two_level
from splatloom.operators.segments import near_pairs
from splatloom.operators.surfels import composite_surfels, project_surfels
from splatloom.sources import views as V

from .common import r4

BACK = [0.2, 0.4, 0.6]


def _seen(spark: SparkSession, folder: str, **options) -> DataFrame:
    scene = V.gaussians(spark, folder).drop(*[f"e{i}" for i in range(1, 17)])
    return project(scene, V.cameras(spark, folder), **options)


def weighted_pairs(spark: SparkSession, folder: str, requests: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    grid = C.pixels(V.cameras(spark, folder)) if requests is None else requests
    return C.contributions(near_pairs(_seen(spark, folder), grid, mask=mask))


def _mask(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles on a camera's diagonal are masked."""
    cameras = V.cameras(spark, folder).select("camera_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tile_x"))
    return cameras.select("camera_id", "tile_x", F.col("tile_x").alias("tile_y"))


def _geometry(rows: DataFrame) -> DataFrame:
    return rows.select("camera_id", "gaussian_id", *[r4(c).alias(c) for c in ("mean2d_x", "mean2d_y", "depth", "conic_a", "conic_b", "conic_c", "compensation")], "radius_x", "radius_y")


def project_dense(spark: SparkSession, folder: str) -> DataFrame:
    return _geometry(_seen(spark, folder, keep_culled=True))


def project_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _geometry(_seen(spark, folder))


def project_antialiased(spark: SparkSession, folder: str) -> DataFrame:
    return _geometry(_seen(spark, folder, antialiased=True, radius_clip=2.0))


def project_ortho(spark: SparkSession, folder: str) -> DataFrame:
    return _geometry(_seen(spark, folder, model="ortho"))


def project_fisheye(spark: SparkSession, folder: str) -> DataFrame:
    return _geometry(_seen(spark, folder, model="fisheye"))


def isect_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return C.tiles(_seen(spark, folder)).select("camera_id", "tile_y", "tile_x", "gaussian_id")


def isect_ellipse(spark: SparkSession, folder: str) -> DataFrame:
    return C.tiles_by_ellipse(_seen(spark, folder)).select("camera_id", "tile_y", "tile_x", "gaussian_id")


def isect_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return C.tile_offsets(C.tiles(_seen(spark, folder)), V.cameras(spark, folder))


def isect_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of primitives, only where a pixel is asked for."""
    wanted = V.pixel_requests(spark, folder).select("camera_id", F.floor(F.col("y") / 16).cast("int").alias("tile_y"), F.floor(F.col("x") / 16).cast("int").alias("tile_x")).distinct()
    met = C.tiles(_seen(spark, folder)).join(wanted, ["camera_id", "tile_y", "tile_x"], "left_semi")
    return met.select("camera_id", "tile_y", "tile_x", "gaussian_id")


def sparse_tile_layout(spark: SparkSession, folder: str) -> DataFrame:
    return C.active_tiles(V.pixel_requests(spark, folder))


def composite_rgb(spark: SparkSession, folder: str) -> DataFrame:
    out = two_level(_seen(spark, folder), C.pixels(V.cameras(spark, folder)), ["c0", "c1", "c2"])
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2")])


def composite_background(spark: SparkSession, folder: str) -> DataFrame:
    out = two_level(_seen(spark, folder), C.pixels(V.cameras(spark, folder)), ["c0", "c1", "c2"], BACK)
    return out.select(*C.PIXEL, *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2")])


def composite_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Accumulated and expected depth."""
    out = two_level(_seen(spark, folder), C.pixels(V.cameras(spark, folder)), ["depth"])
    return out.select(*C.PIXEL, r4("depth").alias("depth"), r4(F.col("depth") / F.greatest("alpha", F.lit(1e-10))).alias("expected_depth"))


def render_rgbd(spark: SparkSession, folder: str) -> DataFrame:
    """The rendering entry with colours before a background, and expected depth."""
    out = rasterize(V.gaussians(spark, folder), V.cameras(spark, folder), "RGB+ED", background=BACK)
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2", "depth")])


def render_rgb_sh(spark: SparkSession, folder: str) -> DataFrame:
    """The rendering entry with harmonics of degree 1 and expected distance, where pixels are asked for."""
    coefficients = [[f"e{4 * k + i}" for i in range(1, 5)] for k in range(3)]
    out = rasterize(V.gaussians(spark, folder), V.cameras(spark, folder), "RGB-Ed", coefficients=coefficients, degree=1, requests=V.pixel_requests(spark, folder))
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2", "depth")])


def composite_masked(spark: SparkSession, folder: str) -> DataFrame:
    out = C.composite(weighted_pairs(spark, folder, mask=_mask(spark, folder)), C.pixels(V.cameras(spark, folder)), ["c0", "c1", "c2"], BACK)
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2")])


def composite_sparse(spark: SparkSession, folder: str) -> DataFrame:
    wanted = V.pixel_requests(spark, folder)
    out = C.composite(weighted_pairs(spark, folder, wanted), wanted, ["c0", "c1", "c2"])
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2")])


def contrib_count(spark: SparkSession, folder: str) -> DataFrame:
    out = C.contributor_counts(weighted_pairs(spark, folder), C.pixels(V.cameras(spark, folder)))
    return out.select(*C.PIXEL, "n", r4("alpha").alias("alpha"))


def contrib_count_sparse(spark: SparkSession, folder: str) -> DataFrame:
    wanted = V.pixel_requests(spark, folder)
    out = C.contributor_counts(weighted_pairs(spark, folder, wanted), wanted)
    return out.select(*C.PIXEL, "n", r4("alpha").alias("alpha"))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(*C.PIXEL, F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), r4(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)).alias("total"))


def contrib_list(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(C.contributor_lists(weighted_pairs(spark, folder)))


def contrib_list_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(C.contributor_lists(weighted_pairs(spark, folder, V.pixel_requests(spark, folder))))


def contrib_topk(spark: SparkSession, folder: str) -> DataFrame:
    return C.top_contributors(weighted_pairs(spark, folder), 3).select(*C.PIXEL, "rank", "gaussian_id", r4("weight").alias("weight"))


def contrib_topk_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return C.top_contributors(weighted_pairs(spark, folder, V.pixel_requests(spark, folder)), 3).select(*C.PIXEL, "rank", "gaussian_id", r4("weight").alias("weight"))


def contrib_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last contributor of each pixel and what light is left behind it."""
    rows = weighted_pairs(spark, folder).groupBy(*C.PIXEL).agg(F.max_by("gaussian_id", "place").alias("last_id"), F.min("after").alias("left"))
    return rows.select(*C.PIXEL, "last_id", r4("left").alias("left"))


def _surfels(spark: SparkSession, folder: str) -> DataFrame:
    scene = V.gaussians(spark, folder).select("gaussian_id", "mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity", F.col("c0").alias("red"))
    return project_surfels(scene, V.cameras(spark, folder))


def project_2dgs(spark: SparkSession, folder: str) -> DataFrame:
    return _surfels(spark, folder).select("camera_id", "gaussian_id", *[r4(c).alias(c) for c in ("mean2d_x", "mean2d_y", "depth", "n0", "n1", "n2")], "radius_x", "radius_y")


def composite_2dgs(spark: SparkSession, folder: str) -> DataFrame:
    """Colour, normal, distortion and median depth of flat primitives."""
    return composite_surfels(_surfels(spark, folder), ["red"]).select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "red", "n0", "n1", "n2", "distortion", "median_depth")])


def blend_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Derivatives of the summed first channel by each primitive's colour and opacity."""
    return C.gradients(weighted_pairs(spark, folder), "c0").select("gaussian_id", r4("color").alias("color"), r4("opacity").alias("opacity"))


_SLOPES = ("v_opacity", "v_mean_x", "v_mean_y", "v_abs_x", "v_abs_y", "v_conic_a", "v_conic_b", "v_conic_c")


def blend_backward_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Derivatives of all summed channels by opacity, 2-D mean and conic of each primitive in each camera."""
    found = C.shape_gradients(weighted_pairs(spark, folder), ["c0", "c1", "c2"])
    return found.select("camera_id", "gaussian_id", *[r4(c).alias(c) for c in _SLOPES])


def blend_backward_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """The same where only the requested pixels count."""
    found = C.shape_gradients(weighted_pairs(spark, folder, V.pixel_requests(spark, folder)), ["c0", "c1", "c2"])
    return found.select("camera_id", "gaussian_id", *[r4(c).alias(c) for c in _SLOPES])


def screen_gradients(spark: SparkSession, folder: str) -> DataFrame:
    """What densification goes by: lengths of the slopes of 2-D means, counts and radii."""
    seen = _seen(spark, folder)
    found = C.screen_gradients(C.shape_gradients(weighted_pairs(spark, folder), ["c0", "c1", "c2"]), seen, cameras=25)
    return found.select("gaussian_id", r4("grad2d").alias("grad2d"), "n", r4("radius").alias("radius"))


QUERIES = {
    f.__name__: f
    for f in (
        project_dense, project_packed, project_antialiased, project_ortho, project_fisheye, isect_tiles, isect_ellipse, isect_offsets, isect_sparse, sparse_tile_layout, composite_rgb, composite_background, composite_depth, render_rgbd, render_rgb_sh,
        composite_masked, composite_sparse, contrib_count, contrib_count_sparse, contrib_list, contrib_list_sparse, contrib_topk, contrib_topk_sparse, contrib_last, project_2dgs, composite_2dgs, blend_backward, blend_backward_shape, blend_backward_sparse, screen_gradients,
    )
}


def _projection(model: str = "pinhole", antialiased: bool = False, clip: float = 0, dense: bool = False) -> str:
    """CTEs up to ``seen``: the visible rows (dense: all rows, culled ones with radius 0)."""
    if model == "ortho":
        mean = "fx * px + cx as mean2d_x, fy * py + cy as mean2d_y, fx as j00, 0::double as j01, 0::double as j02, 0::double as j10, fy as j11, 0::double as j12"
        prepared = "select *, 0 as unused from placed"
    elif model == "fisheye":
        mean = """fx * px * th / rr + cx as mean2d_x, fy * py * th / rr + cy as mean2d_y, fx * (xx * ka + yy * kb) as j00, fx * (px * py) * (ka - kb) as j01, -fx * px / ll as j02,
          fy * (px * py) * (ka - kb) as j10, fy * (yy * ka + xx * kb) as j11, -fy * py / ll as j12"""
        prepared = """select *, th / rr / (xx + yy) as kb, pz / ll / (xx + yy) as ka from (select *, atan2(rr, pz + 1e-7::double) as th, xx + yy + pz * pz as ll
          from (select *, sqrt(px * px + py * py) + 1e-7::double as rr, px * px + 1e-7::double as xx, py * py as yy from placed))"""
    else:
        mean = "fx * px / pz + cx as mean2d_x, fy * py / pz + cy as mean2d_y, fx / pz as j00, 0::double as j01, -fx * tx / (pz * pz) as j02, 0::double as j10, fy / pz as j11, -fy * ty / (pz * pz) as j12"
        prepared = """select *, pz * least((width - cx) / fx + 0.3::double * (0.5::double * width / fx), greatest(-(cx / fx + 0.3::double * (0.5::double * width / fx)), px / pz)) as tx,
          pz * least((height - cy) / fy + 0.3::double * (0.5::double * height / fy), greatest(-(cy / fy + 0.3::double * (0.5::double * height / fy)), py / pz)) as ty from placed"""
    strength = "opacity * compensation" if antialiased else "opacity"
    return f"""{V.GAUSSIANS}, {V.CAMERAS},
rot as (select *, 1 - 2 * (qy * qy + qz * qz) as m00, 2 * (qx * qy - qw * qz) as m01, 2 * (qx * qz + qw * qy) as m02, 2 * (qx * qy + qw * qz) as m10, 1 - 2 * (qx * qx + qz * qz) as m11,
  2 * (qy * qz - qw * qx) as m12, 2 * (qx * qz - qw * qy) as m20, 2 * (qy * qz + qw * qx) as m21, 1 - 2 * (qx * qx + qy * qy) as m22, sx * sx as s0, sy * sy as s1, sz * sz as s2 from gaussians),
cov as (select *, m00*m00*s0 + m01*m01*s1 + m02*m02*s2 as v00, m00*m10*s0 + m01*m11*s1 + m02*m12*s2 as v01, m00*m20*s0 + m01*m21*s1 + m02*m22*s2 as v02,
  m10*m10*s0 + m11*m11*s1 + m12*m12*s2 as v11, m10*m20*s0 + m11*m21*s1 + m12*m22*s2 as v12, m20*m20*s0 + m21*m21*s1 + m22*m22*s2 as v22 from rot),
placed as (select camera_id, gaussian_id, component_id, opacity, c0, c1, c2, fx, fy, cx, cy, width, height, r00*mx + r02*mz as px, my as py, r20*mx + r22*mz as pz,
  r00*r00*v00 + 2*r00*r02*v02 + r02*r02*v22 as w00, r00*v01 + r02*v12 as w01, r00*r20*v00 + (r00*r22 + r02*r20)*v02 + r02*r22*v22 as w02,
  v11 as w11, r20*v01 + r22*v12 as w12, r20*r20*v00 + 2*r20*r22*v02 + r22*r22*v22 as w22 from cov cross join cameras),
lensed as (select camera_id, gaussian_id, component_id, opacity, c0, c1, c2, width, height, pz as depth, w00, w01, w02, w11, w12, w22, {mean} from ({prepared})),
flat as (select *, j00*j00*w00 + j01*j01*w11 + j02*j02*w22 + 2*(j00*j01*w01 + j00*j02*w02 + j01*j02*w12) as a0,
  j00*j10*w00 + j01*j11*w11 + j02*j12*w22 + (j00*j11 + j01*j10)*w01 + (j00*j12 + j02*j10)*w02 + (j01*j12 + j02*j11)*w12 as b,
  j10*j10*w00 + j11*j11*w11 + j12*j12*w22 + 2*(j10*j11*w01 + j10*j12*w02 + j11*j12*w12) as d0 from lensed),
blurred as (select *, a0 + 0.3::double as a, d0 + 0.3::double as d, (a0 + 0.3::double) * (d0 + 0.3::double) - b * b as det from flat),
strong as (select *, sqrt(greatest((a0 * d0 - b * b) / det, 0.000025::double)) as compensation from blurred),
ext as (select *, case when {strength} >= 1e0/255 and det > 0 and depth >= 0.01::double and depth <= 1e10 then least(3.33::double, sqrt(2 * ln({strength} * 255))) end as k from strong),
boxed as (select *, ceil(k * sqrt(a))::int as rx, ceil(k * sqrt(d))::int as ry from ext),
shown as (select *, coalesce(k is not null and (rx > {clip} or ry > {clip}) and mean2d_x + rx > 0 and mean2d_x - rx < width and mean2d_y + ry > 0 and mean2d_y - ry < height, false) as ok from boxed),
seen as (select camera_id, gaussian_id, component_id, opacity, c0, c1, c2, width, height, {', '.join(f'case when ok then {x} end as {n}' for x, n in (('mean2d_x', 'mean2d_x'), ('mean2d_y', 'mean2d_y'), ('depth', 'depth'), ('d / det', 'conic_a'), ('-b / det', 'conic_b'), ('a / det', 'conic_c'), ('compensation', 'compensation')))},
  case when ok then rx else 0 end as radius_x, case when ok then ry else 0 end as radius_y from shown {'' if dense else 'where ok'})"""


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0 as {n}" for n in names)


_GEOMETRY = f"select camera_id, gaussian_id, {_rounded('mean2d_x', 'mean2d_y', 'depth', 'conic_a', 'conic_b', 'conic_c', 'compensation')}, radius_x, radius_y from seen"
_TILES = """, met as (select s.*, tile_x, tile_y from seen s, unnest(range(greatest(floor((mean2d_y - radius_y) / 16), 0)::int, least(ceil((mean2d_y + radius_y) / 16), 3)::int)) u(tile_y),
  unnest(range(greatest(floor((mean2d_x - radius_x) / 16), 0)::int, least(ceil((mean2d_x + radius_x) / 16), 4)::int)) v(tile_x))"""
_WANTED = "wanted as (select distinct (o_custkey % 25)::int as camera_id, (o_orderkey % 48)::int as y, ((o_custkey * 7 + o_orderkey) % 64)::int as x from orders)"


def blend(keep: str = "true") -> str:
    """CTEs up to ``weighted``."""
    return f""", cells as (select s.*, xx::int as x, yy::int as y, mean2d_x - (xx + 0.5::double) as dx, mean2d_y - (yy + 0.5::double) as dy from seen s,
  unnest(range(greatest(floor(mean2d_y - radius_y), 0)::int, least(ceil(mean2d_y + radius_y), height)::int)) u(yy), unnest(range(greatest(floor(mean2d_x - radius_x), 0)::int, least(ceil(mean2d_x + radius_x), width)::int)) v(xx)),
powered as (select *, 0.5::double * (conic_a * dx * dx + conic_c * dy * dy) + conic_b * dx * dy as power from cells where {keep}),
alphas as (select *, least(0.99::double, opacity * exp(-power)) as alpha from powered),
ordered as (select *, exp(sum(ln(1 - alpha)) over (partition by camera_id, x, y order by depth::float, gaussian_id rows unbounded preceding)) as after_,
  row_number() over (partition by camera_id, x, y order by depth::float, gaussian_id) as place from alphas where power >= 0 and alpha >= 1e0/255),
weighted as (select *, alpha * after_ / (1 - alpha) as weight from ordered where after_ > 1e-4)"""


GRID = ", grid as (select camera_id, x::int as x, y::int as y from cameras, unnest(range(64)) u(x), unnest(range(48)) v(y))"


def image(grid: str, columns: str) -> str:
    return f"""select camera_id, x, y, {columns} from (select g.camera_id, g.x, g.y, coalesce(n, 0) as n, coalesce(alpha, 0) as alpha, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('c0', 'c1', 'c2', 'depth'))}
  from {grid} g left join (select camera_id, x, y, count(*) as n, sum(weight) as alpha, {', '.join(f'sum(weight * {c}) as {c}' for c in ('c0', 'c1', 'c2', 'depth'))} from weighted group by all) s
  on g.camera_id = s.camera_id and g.x = s.x and g.y = s.y)"""


_BACKED = ", ".join(f"round(c{k} + (1 - alpha) * {b}::double, 4) + 0 as c{k}" for k, b in enumerate(BACK))
PLAIN = _projection()
_LOBE = lambda k: f"greatest(0, 0.2820947917738781::double*e{4 * k + 1} + 0.48860251190292::double*(-my*e{4 * k + 2} + mz*e{4 * k + 3} - mx*e{4 * k + 4})/sqrt(mx*mx + my*my + mz*mz) + 0.5::double)"
#: The cameras stand at the origin, so directions and distances are those of the centres.
_HARMONIC = PLAIN.replace("gaussians as (", "plain as (", 1).replace(V.CAMERAS, f"gaussians as (select * replace ({', '.join(f'{_LOBE(k)} as c{k}' for k in range(3))}) from plain), {V.CAMERAS}", 1)
_DISTANT = blend("(camera_id, x, y) in (select (camera_id, x, y) from wanted)").replace("weighted as (select *,", "weighted as (select o.* replace (sqrt(mx*mx + my*my + mz*mz) as depth),").replace("from ordered where", "from ordered o join (select gaussian_id, mx, my, mz from plain) using (gaussian_id) where")
_ASKED = "(camera_id, x, y) in (select (camera_id, x, y) from wanted)"
_TOP = "select camera_id, x, y, (row_number() over (partition by camera_id, x, y order by place))::int as rank, gaussian_id, round(weight, 4) + 0 as weight from (select *, row_number() over (partition by camera_id, x, y order by weight desc, place) as h from weighted) where h <= 3"
_LIST = "select camera_id, x, y, string_agg(gaussian_id::varchar, ',' order by place) as ids, round(sum(weight), 4) + 0 as total from weighted group by all"

_SURFELS = f"""{V.GAUSSIANS}, {V.CAMERAS},
h as (select gaussian_id, opacity, c0 as red, mx, my, mz, (1 - 2*(qy*qy + qz*qz))*sx as h00, 2*(qx*qy - qw*qz)*sy as h01, 2*(qx*qz + qw*qy) as h02, 2*(qx*qy + qw*qz)*sx as h10, (1 - 2*(qx*qx + qz*qz))*sy as h11, 2*(qy*qz - qw*qx) as h12,
  2*(qx*qz - qw*qy)*sx as h20, 2*(qy*qz + qw*qx)*sy as h21, 1 - 2*(qx*qx + qy*qy) as h22 from gaussians),
w as (select *, {', '.join(f'r{i}0*h0{j} + r{i}1*h1{j} + r{i}2*h2{j} as w{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f'r{i}0*mx + r{i}1*my + r{i}2*mz as p{i}' for i in range(3))} from h cross join cameras),
k as (select *, {', '.join(f'fx*{x} + cx*{z} as ra{i}, fy*{y} + cy*{z} as rb{i}, {z} as rc{i}' for i, (x, y, z) in enumerate((('w00', 'w10', 'w20'), ('w01', 'w11', 'w21'), ('p0', 'p1', 'p2'))))},
  case when w02*p0 + w12*p1 + w22*p2 < 0 then 1 else -1 end as flip from w where p2 > 0.01::double and p2 < 1e10),
d as (select *, rc0*rc0 + rc1*rc1 - rc2*rc2 as d from k),
m as (select *, ra0*rc0/d + ra1*rc1/d - ra2*rc2/d as mean2d_x, rb0*rc0/d + rb1*rc1/d - rb2*rc2/d as mean2d_y, ra0*ra0/d + ra1*ra1/d - ra2*ra2/d as aa, rb0*rb0/d + rb1*rb1/d - rb2*rb2/d as bb from d where d <> 0),
x as (select *, ceil(3.33::double*sqrt(greatest(1e-4, mean2d_x*mean2d_x - aa)))::int as radius_x, ceil(3.33::double*sqrt(greatest(1e-4, mean2d_y*mean2d_y - bb)))::int as radius_y, p2 as depth, w02*flip as n0, w12*flip as n1, w22*flip as n2 from m),
seen as (select * from x where mean2d_x + radius_x > 0 and mean2d_x - radius_x < width and mean2d_y + radius_y > 0 and mean2d_y - radius_y < height)"""
_FLAT = """, cells as (select s.*, xx::int as x, yy::int as y, xx + 0.5::double as px, yy + 0.5::double as py from seen s, unnest(range(greatest(floor((mean2d_y - radius_y)/16), 0)::int*16, least(ceil((mean2d_y + radius_y)/16), 3)::int*16)) u(yy),
  unnest(range(greatest(floor((mean2d_x - radius_x)/16), 0)::int*16, least(ceil((mean2d_x + radius_x)/16), 4)::int*16)) v(xx)),
rays as (select *, px*rc0 - ra0 as u0, px*rc1 - ra1 as u1, px*rc2 - ra2 as u2, py*rc0 - rb0 as v0, py*rc1 - rb1 as v1, py*rc2 - rb2 as v2 from cells),
crossed as (select *, u1*v2 - u2*v1 as k0, u2*v0 - u0*v2 as k1, u0*v1 - u1*v0 as k2 from rays),
alphas as (select *, least(0.99::double, opacity*exp(-0.5::double*least((k0*k0 + k1*k1)/(k2*k2), 2*((mean2d_x - px)*(mean2d_x - px) + (mean2d_y - py)*(mean2d_y - py))))) as alpha from crossed where k2 <> 0),
ordered as (select *, exp(sum(ln(1 - alpha)) over (partition by camera_id, x, y order by depth::float, gaussian_id rows unbounded preceding)) as after_, row_number() over (partition by camera_id, x, y order by depth::float, gaussian_id) as place from alphas where alpha >= 1e0/255),
weighted as (select *, alpha*after_/(1 - alpha) as weight from ordered where after_ > 1e-4),
prefixed as (select *, coalesce(sum(weight) over p, 0) as pw, coalesce(sum(weight*depth) over p, 0) as pd from weighted window p as (partition by camera_id, x, y order by place rows between unbounded preceding and 1 preceding))"""

_BACK_SHAPE = """, b as (select *, c0 + c1 + c2 as shown, coalesce(sum(weight*(c0 + c1 + c2)) over (partition by camera_id, x, y order by place rows between 1 following and unbounded following), 0) as behind from weighted),
v as (select *, case when alpha < 0.99::double then alpha*(shown*after_ - behind)/(1 - alpha) else 0 end as v from b),
g as (select camera_id, gaussian_id, sum(v/opacity) as v_opacity, sum(-v*(conic_a*dx + conic_b*dy)) as v_mean_x, sum(-v*(conic_b*dx + conic_c*dy)) as v_mean_y, sum(abs(v*(conic_a*dx + conic_b*dy))) as v_abs_x, sum(abs(v*(conic_b*dx + conic_c*dy))) as v_abs_y,
  sum(-v*dx*dx/2) as v_conic_a, sum(-v*dx*dy) as v_conic_b, sum(-v*dy*dy/2) as v_conic_c from v group by all)"""
_BACK_ALL = f"select camera_id, gaussian_id, {_rounded(*_SLOPES)} from g"
SQL = {
    "blend_backward_shape": f"with {PLAIN}{blend()}{_BACK_SHAPE} {_BACK_ALL}",
    "blend_backward_sparse": f"with {_WANTED}, {PLAIN}{blend(_ASKED)}{_BACK_SHAPE} {_BACK_ALL}",
    "screen_gradients": f"""with {PLAIN}{blend()}{_BACK_SHAPE} select s.gaussian_id, round(sum(coalesce(sqrt(pow(v_mean_x*32*25, 2) + pow(v_mean_y*24*25, 2)), 0)), 4) + 0 as grad2d, count(*) as n, round(max(greatest(radius_x, radius_y)/64::double), 4) + 0 as radius
  from seen s left join g on g.camera_id = s.camera_id and g.gaussian_id = s.gaussian_id group by 1""",
    "project_dense": f"with {_projection(dense=True)} {_GEOMETRY}",
    "project_packed": f"with {PLAIN} {_GEOMETRY}",
    "project_antialiased": f"with {_projection(antialiased=True, clip=2)} {_GEOMETRY}",
    "project_ortho": f"with {_projection('ortho')} {_GEOMETRY}",
    "project_fisheye": f"with {_projection('fisheye')} {_GEOMETRY}",
    "isect_tiles": f"with {PLAIN}{_TILES} select camera_id, tile_y::int as tile_y, tile_x::int as tile_x, gaussian_id from met",
    "isect_ellipse": f"""with {PLAIN}{_TILES}, l as (select *, least(3.33::double*3.33::double, 2*ln(opacity*255)) as lev, conic_a*conic_c - conic_b*conic_b as det from met),
  r as (select *, greatest(tile_y*16 - mean2d_y, -sqrt(lev*conic_a/det)) as lo, least((tile_y + 1)*16 - mean2d_y, sqrt(lev*conic_a/det)) as hi, conic_b/conic_c*sqrt(lev*conic_c/det) as ex from l),
  y as (select *, least(greatest(-ex, lo), hi) as yr, least(greatest(ex, lo), hi) as yl from r where lo <= hi)
select camera_id, tile_y::int as tile_y, tile_x::int as tile_x, gaussian_id from y where (tile_x + 1)*16 > mean2d_x + (-conic_b*yl - sqrt(greatest(0, conic_b*conic_b*yl*yl - conic_a*(conic_c*yl*yl - lev))))/conic_a
  and tile_x*16 < mean2d_x + (-conic_b*yr + sqrt(greatest(0, conic_b*conic_b*yr*yr - conic_a*(conic_c*yr*yr - lev))))/conic_a""",
    "isect_offsets": f"""with {PLAIN}{_TILES}, n as (select c.camera_id, ty::int as tile_y, tx::int as tile_x, count(m.gaussian_id) as n
  from cameras c cross join unnest(range(3)) u(ty) cross join unnest(range(4)) v(tx) left join met m on m.camera_id = c.camera_id and m.tile_y = ty and m.tile_x = tx group by all)
select *, coalesce(sum(n) over (order by camera_id, tile_y, tile_x rows between unbounded preceding and 1 preceding), 0)::bigint as start from n""",
    "isect_sparse": f"with {_WANTED}, {PLAIN}{_TILES} select camera_id, tile_y::int as tile_y, tile_x::int as tile_x, gaussian_id from met where (camera_id, tile_y, tile_x) in (select (camera_id, y // 16, x // 16) from wanted)",
    "sparse_tile_layout": f"""with {_WANTED}, w as (select camera_id, y // 16 as tile_y, x // 16 as tile_x, ((y % 16) * 16 + x % 16) // 64 as w, ((y % 16) * 16 + x % 16) % 64 as b from wanted),
  g as (select camera_id, tile_y, tile_x, w, count(*) as n, sum(case when b = 63 then -9223372036854775808 else (1::bigint << b) end)::bigint as bits from w group by all)
select camera_id, tile_y::int as tile_y, tile_x::int as tile_x, sum(n)::bigint as n, string_agg(w::varchar || ':' || bits::varchar, ',' order by w) as words from g group by all""",
    "composite_rgb": f"with {PLAIN}{blend()}{GRID} {image('grid', 'n, ' + _rounded('alpha', 'c0', 'c1', 'c2'))}",
    "composite_background": f"with {PLAIN}{blend()}{GRID} {image('grid', _rounded('alpha') + ', ' + _BACKED)}",
    "composite_depth": f"with {PLAIN}{blend()}{GRID} {image('grid', 'round(depth, 4) + 0 as depth, round(depth / greatest(alpha, 1e-10), 4) + 0 as expected_depth')}",
    "render_rgbd": f"with {PLAIN}{blend()}{GRID} {image('grid', 'n, ' + _rounded('alpha') + ', ' + _BACKED + ', round(depth / greatest(alpha, 1e-10), 4) + 0 as depth')}",
    "render_rgb_sh": f"with {_WANTED}, {_HARMONIC}{_DISTANT} {image('wanted', 'n, ' + _rounded('alpha', 'c0', 'c1', 'c2') + ', round(depth / greatest(alpha, 1e-10), 4) + 0 as depth')}",
    "composite_masked": f"with {PLAIN}{blend('not (x // 16 = y // 16 and x // 16 < 3)')}{GRID} {image('grid', 'n, ' + _rounded('alpha') + ', ' + _BACKED)}",
    "composite_sparse": f"with {_WANTED}, {PLAIN}{blend(_ASKED)} {image('wanted', 'n, ' + _rounded('alpha', 'c0', 'c1', 'c2'))}",
    "contrib_count": f"with {PLAIN}{blend()}{GRID} {image('grid', 'n, ' + _rounded('alpha'))}",
    "contrib_count_sparse": f"with {_WANTED}, {PLAIN}{blend(_ASKED)} {image('wanted', 'n, ' + _rounded('alpha'))}",
    "contrib_list": f"with {PLAIN}{blend()} {_LIST}",
    "contrib_list_sparse": f"with {_WANTED}, {PLAIN}{blend(_ASKED)} {_LIST}",
    "contrib_topk": f"with {PLAIN}{blend()} {_TOP}",
    "contrib_topk_sparse": f"with {_WANTED}, {PLAIN}{blend(_ASKED)} {_TOP}",
    "contrib_last": f"with {PLAIN}{blend()} select camera_id, x, y, arg_max(gaussian_id, place) as last_id, round(min(after_), 4) + 0 as \"left\" from weighted group by all",
    "project_2dgs": f"with {_SURFELS} select camera_id, gaussian_id, {_rounded('mean2d_x', 'mean2d_y', 'depth', 'n0', 'n1', 'n2')}, radius_x, radius_y from seen",
    "composite_2dgs": f"""with {_SURFELS}{_FLAT} select camera_id, x, y, count(*) as n, round(sum(weight), 4) + 0 as alpha, {', '.join(f'round(sum(weight*{c}), 4) + 0 as {c}' for c in ('red', 'n0', 'n1', 'n2'))},
  round(sum(2*weight*(depth*pw - pd)), 4) + 0 as distortion, round(arg_max(depth, case when after_/(1 - alpha) > 0.5::double then place end), 4) + 0 as median_depth from prefixed group by all""",
    "blend_backward": f"""with {PLAIN}{blend()}, b as (select *, coalesce(sum(weight*c0) over (partition by camera_id, x, y order by place rows between 1 following and unbounded following), 0) as behind from weighted)
select gaussian_id, round(sum(weight), 4) + 0 as color, round(sum(case when alpha < 0.99::double then (c0*after_/(1 - alpha) - behind/(1 - alpha))*alpha/opacity else 0 end), 4) + 0 as opacity from b group by 1""",
}
