"""Rotations, poses, spherical harmonics, cameras and packing as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splatloom.functions import harmonics, lenses, packing
from splatloom.functions import rotation as R
from splatloom.operators.shutter import project_shutter
from splatloom.sources import views as V

from .common import r4

Q, S, M = ("qw", "qx", "qy", "qz"), ("sx", "sy", "sz"), ("mx", "my", "mz")


def _rounded(**columns) -> list:
    return [r4(c).alias(n) for n, c in columns.items()]


def _named(prefix: str, values) -> dict:
    return {f"{prefix}{k}": c for k, c in enumerate(values)}


def quat_covariance(spark: SparkSession, folder: str) -> DataFrame:
    """Covariance and precision of every primitive."""
    rows = V.gaussians(spark, folder)
    turn = R.rotation(R.columns(*Q))
    rows = rows.select("gaussian_id", *S, *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    m = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    s = R.columns(*S)
    return rows.select("gaussian_id", *_rounded(**_named("cov", R.covariance(m, s)), **_named("prec", R.covariance(m, tuple(1 / x for x in s)))))


def quat_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Product with a turn about an axis, conjugate, rotated vector, distance and interpolations."""
    q, v = R.columns(*Q), R.columns(*M)
    turn = R.axis_angle((F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.col("e15") * 3)
    rows = V.gaussians(spark, folder).select("gaussian_id", *Q, *M, "e16", *[c.alias(n) for n, c in zip(("aw", "ax", "ay", "az"), turn, strict=True)])
    a = R.columns("aw", "ax", "ay", "az")
    t = F.abs("e16")
    rotated = R.apply(R.rotation(q), v)
    straight = R.normalised(R.lerp(q, a, t))
    return rows.select("gaussian_id", *_rounded(**_named("prod", R.multiply(a, q)), **_named("conj", R.conjugate(q)), **_named("rot", rotated), dist=R.angular_distance(q, a), **_named("slerp", R.slerp(q, a, t)), **_named("lerp", straight)))


def se3_poses(spark: SparkSession, folder: str) -> DataFrame:
    """Points and directions through a pose and back, and the composition of the pose with itself."""
    rows = V.gaussians(spark, folder).select("gaussian_id", *Q, *M, *[F.col(f"e{i}").alias(f"t{i - 8}") for i in (8, 9, 10)])
    turn, v, t = R.rotation(R.columns(*Q)), R.columns(*M), R.columns("t0", "t1", "t2")
    point = tuple(a + b for a, b in zip(R.apply(turn, v), t, strict=True))
    back = R.apply(R.transposed(turn), tuple(a - b for a, b in zip(v, t, strict=True)))
    twice = tuple(a + b for a, b in zip(R.apply(turn, t), t, strict=True))
    return rows.select("gaussian_id", *_rounded(**_named("point", point), **_named("dir", R.apply(turn, v)), **_named("back", back), **_named("backdir", R.apply(R.transposed(turn), v)), **_named("twice", twice)))


def sh_color(spark: SparkSession, folder: str) -> DataFrame:
    """Colour sums of degree 0 to 3 in the direction from the origin, and the parts of degree 0 and above."""
    rows = V.gaussians(spark, folder)
    d = R.normalised(R.columns(*M))
    rows = rows.select("gaussian_id", *[c.alias(n) for n, c in zip("xyz", d, strict=True)], *[f"e{i}" for i in range(1, 17)])
    coefficients = [F.col(f"e{i}") for i in range(1, 17)]
    sums = {f"deg{k}": harmonics.evaluate(k, R.columns("x", "y", "z"), coefficients) for k in range(4)}
    return rows.select("gaussian_id", *_rounded(**sums, rest=sums["deg3"] - sums["deg0"], color=F.greatest(sums["deg3"] + 0.5, F.lit(0.0))))


def sh_basis(spark: SparkSession, folder: str) -> DataFrame:
    """All 25 basis values up to degree 4."""
    rows = V.gaussians(spark, folder).select("gaussian_id", *[c.alias(n) for n, c in zip("xyz", R.normalised(R.columns(*M)), strict=True)])
    return rows.select("gaussian_id", *_rounded(**_named("b", harmonics.basis(4, *R.columns("x", "y", "z")))))


#: The lens of the distortion queries (radial k1..k6, tangential p1 p2, thin prism s1..s4).
def sh_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Derivatives of a degree-2 colour by its coefficients and by its direction, none where the colour is clamped at 0."""
    coefficients, direction = [F.col(f"e{i}") for i in range(1, 10)], R.columns(*M)
    rows = V.gaussians(spark, folder)
    unit = R.normalised(direction)
    shown = (harmonics.evaluate(2, unit, coefficients) + 0.5 > 0).cast("double")
    by_coefficient, by_direction = harmonics.slopes(2, direction, coefficients)
    rows = rows.select("gaussian_id", shown.alias("shown"), *[c.alias(f"k{i}") for i, c in enumerate(by_coefficient)], *[c.alias(f"d{i}") for i, c in enumerate(by_direction)])
    return rows.select("gaussian_id", *[r4(F.col("shown") * F.col(c)).alias(c) for c in (*(f"k{i}" for i in range(9)), "d0", "d1", "d2")])


LENS = {"k1": 0.1, "k2": -0.05, "k3": 0.01, "k4": 0.02, "k5": 0.0, "k6": 0.0, "p1": 0.001, "p2": -0.002, "s1": 0.0005, "s2": 0.0, "s3": -0.0005, "s4": 0.0}


def opencv_distort(spark: SparkSession, folder: str) -> DataFrame:
    """Image points of primitives through a distorted pinhole lens, with a validity flag."""
    rows = V.gaussians(spark, folder).where("mz > 0").select("gaussian_id", (F.col("mx") / F.col("mz")).alias("u"), (F.col("my") / F.col("mz")).alias("v"))
    u, v = R.columns("u", "v")
    radial, dx, dy = lenses.opencv_distortion(u, v, LENS)
    rows = rows.withColumn("radial", radial)
    x, y = 60 * (F.col("radial") * u + dx) + 32, 60 * (F.col("radial") * v + dy) + 24
    rows = rows.select("gaussian_id", x.alias("x"), y.alias("y"), "radial")
    return rows.select("gaussian_id", *_rounded(x=F.col("x"), y=F.col("y")), ((F.col("radial") > 0.8) & (F.col("x") >= 0) & (F.col("x") < 64) & (F.col("y") >= 0) & (F.col("y") < 48)).alias("valid"))


def grid(spark: SparkSession, folder: str) -> DataFrame:
    from splatloom.operators.composite import pixels

    cameras = V.cameras(spark, folder)
    return pixels(cameras).join(cameras, "camera_id")


def pixel_rays(spark: SparkSession, folder: str) -> DataFrame:
    """World ray through every pixel centre of every camera, and its time share for the four rolling directions."""
    rows = grid(spark, folder)
    d = R.normalised(((F.col("x") + 0.5 - F.col("cx")) / F.col("fx"), (F.col("y") + 0.5 - F.col("cy")) / F.col("fy"), F.lit(1.0)))
    view = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    world = R.apply(R.transposed(view), d)
    down, right = F.col("y") / (F.col("height") - 1), F.col("x") / (F.col("width") - 1)
    return rows.select("camera_id", "x", "y", *_rounded(**_named("ray", world), down=down, up=1 - down, right=right, left=1 - right))


def moving_cameras(spark: SparkSession, folder: str) -> DataFrame:
    """Cameras with lens, size and the poses between which they turn by 0.05 and move by 0.1."""
    yaw = F.col("n_nationkey") * F.lit(0.02) - 0.24
    lens = V.cameras(spark, folder).select("camera_id", "fx", "fy", "cx", "cy", "width", "height")
    turn = lambda k, a: [F.cos(a / 2).alias(f"{k}w"), F.lit(0.0).alias(f"{k}x"), F.sin(a / 2).alias(f"{k}y"), F.lit(0.0).alias(f"{k}z")]
    poses = V.table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("camera_id"), *turn("a", yaw), *turn("b", yaw + 0.05), *[F.lit(x).alias(n) for n, x in zip(("at0", "at1", "at2", "bt0", "bt1", "bt2"), (0.0, 0.0, 0.0, 0.1, 0.0, 0.0), strict=True)])
    return lens.join(poses, "camera_id")


def rolling_shutter(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives' centres in cameras that turn by 0.05 and move by 0.1 while their rows are read."""
    points = V.gaussians(spark, folder).select(F.col("gaussian_id").alias("point_id"), F.col("mx").alias("px"), F.col("my").alias("py"), F.col("mz").alias("pz"))
    rows = project_shutter(points, moving_cameras(spark, folder))
    return rows.select("camera_id", F.col("point_id").alias("gaussian_id"), *[r4(c).alias(c) for c in ("x", "y", "time")], "valid")


def morton_order(spark: SparkSession, folder: str) -> DataFrame:
    """Morton code over the scene's box, place in that order and chunk of 256.

    The box is one row; the order is a running count over ranges of the code, so no task sorts all rows.
    """
    rows = V.gaussians(spark, folder)
    box = rows.agg(*[f(c).alias(f"{n}{c}") for c in M for n, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.crossJoin(box)
    cell = [F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * 1024).cast("long").bitwiseAND(F.lit(1023).cast("long")) for c in M]
    rows = rows.select("gaussian_id", packing.morton(*cell).alias("code")).withColumn("part", F.shiftright("code", 20))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))  # at most 1024 rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("code", "gaussian_id")) - 1
    return rows.join(parts, "part").select("gaussian_id", "code", place.alias("place")).withColumn("chunk", F.expr("place div 256"))


def pack_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised centres in 11-10-11 bits, colour and opacity in 8-8-8-8, rotation by its smallest three."""
    rows = V.gaussians(spark, folder)
    near = [F.col(c) / 8 + 0.5 for c in M]
    return rows.select("gaussian_id", packing.pack_111011(*near).alias("centre"), packing.pack_8888(F.col("c0"), F.col("c1"), F.col("c2"), F.col("opacity")).alias("color"), packing.smallest_three(R.columns(*Q)).alias("rotation"))


def chunk_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of centres and scales of each chunk of 256 in Morton order."""
    rows = morton_order(spark, folder).join(V.gaussians(spark, folder), "gaussian_id")
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), *[r4(f(c)).alias(f"{n}_{c}") for c in (*M, *S) for n, f in (("min", F.min), ("max", F.max))])


def quantize(spark: SparkSession, folder: str) -> DataFrame:
    """8-bit and split 16-bit levels of the centre's x over its range, and the value that the 16 bits give back."""
    rows = V.gaussians(spark, folder)
    box = rows.agg(F.min("mx").alias("lo"), F.max("mx").alias("hi"))
    share = (F.col("mx") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rows = rows.crossJoin(box).withColumns({"b8": F.floor(share * 255 + 0.5), "b16": F.floor(share * 65535 + 0.5)})
    return rows.select("gaussian_id", "b8", F.expr("b16 div 256").alias("high"), (F.col("b16") % 256).alias("low"), r4(F.col("b16") / 65535 * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("back"))


QUERIES = {f.__name__: f for f in (quat_covariance, quat_algebra, se3_poses, sh_color, sh_basis, sh_backward, opencv_distort, pixel_rays, rolling_shutter, morton_order, pack_bits, chunk_bounds, quantize)}

_ROT = """rot as (select *, 1 - 2*(qy*qy + qz*qz) as r00, 2*(qx*qy - qw*qz) as r01, 2*(qx*qz + qw*qy) as r02, 2*(qx*qy + qw*qz) as r10, 1 - 2*(qx*qx + qz*qz) as r11, 2*(qy*qz - qw*qx) as r12,
  2*(qx*qz - qw*qy) as r20, 2*(qy*qz + qw*qx) as r21, 1 - 2*(qx*qx + qy*qy) as r22 from gaussians)"""


def _r(**named: str) -> str:
    return ", ".join(f"round({v}, 4) + 0 as {k}" for k, v in named.items())


def _cov(prefix: str, scale: str) -> dict[str, str]:
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    return {f"{prefix}{n}": " + ".join(f"r{i}{k}*r{j}{k}*{scale.format('xyz'[k])}" for k in range(3)) for n, (i, j) in enumerate(cells)}


def _times(rows: str, v: list[str]) -> list[str]:
    return [" + ".join(f"{rows.format(i=i, k=k)}*{v[k]}" for k in range(3)) for i in range(3)]


_FORWARD, _BACKWARD = "r{i}{k}", "r{k}{i}"
_BASIS = """basis as (select *, 0.2820947917738781::double as b0, -0.48860251190292::double*y as b1, 0.48860251190292::double*z as b2, -0.48860251190292::double*x as b3,
  0.5462742152960395::double*s1 as b4, -1.092548430592079::double*z*y as b5, 0.9461746957575601::double*z*z - 0.3153915652525201::double as b6, -1.092548430592079::double*z*x as b7, 0.5462742152960395::double*q1 as b8,
  -0.5900435899266435::double*s2 as b9, 1.445305721320277::double*z*s1 as b10, (-2.285228997322329::double*z*z + 0.4570457994644658::double)*y as b11, z*(1.865881662950577::double*z*z - 1.119528997770346::double) as b12,
  (-2.285228997322329::double*z*z + 0.4570457994644658::double)*x as b13, 1.445305721320277::double*z*q1 as b14, -0.5900435899266435::double*q2 as b15,
  0.6258357354491763::double*(x*s2 + y*q2) as b16, -1.770130769779931::double*z*s2 as b17, (3.31161143515146::double*z*z - 0.47308734787878::double)*s1 as b18, z*(-4.683325804901025::double*z*z + 2.007139630671868::double)*y as b19,
  1.984313483298443::double*z*z*(1.865881662950577::double*z*z - 1.119528997770346::double) - 1.006230589874905::double*(0.9461746957575601::double*z*z - 0.3153915652525201::double) as b20,
  z*(-4.683325804901025::double*z*z + 2.007139630671868::double)*x as b21, (3.31161143515146::double*z*z - 0.47308734787878::double)*q1 as b22, -1.770130769779931::double*z*q2 as b23, 0.6258357354491763::double*(x*q2 - y*s2) as b24
  from (select *, x*q1 - y*s1 as q2, x*s1 + y*q1 as s2 from (select *, x*x - y*y as q1, 2*x*y as s1 from (select *, mx/l as x, my/l as y, mz/l as z from (select *, sqrt(mx*mx + my*my + mz*mz) as l from gaussians)))))"""
_DEG = {k: " + ".join(f"b{i}*e{i + 1}" for i in range((k + 1) ** 2)) for k in range(4)}
_MORTON = """cell as (select *, (floor((mx - min(mx) over ()) / (max(mx) over () - min(mx) over ()) * 1024)::bigint & 1023) as ix,
  (floor((my - min(my) over ()) / (max(my) over () - min(my) over ()) * 1024)::bigint & 1023) as iy, (floor((mz - min(mz) over ()) / (max(mz) over () - min(mz) over ()) * 1024)::bigint & 1023) as iz from gaussians),
coded as (select *, (""" + " + ".join(f"((({c} >> {b}) & 1) << {3 * b + k})" for k, c in enumerate(("ix", "iy", "iz")) for b in range(10)) + """)::bigint as code from cell),
morton as (select *, row_number() over (order by code, gaussian_id) - 1 as place from coded)"""
_U = lambda v, b: f"(greatest(0, least({(1 << b) - 1}, floor(({v}) * {(1 << b) - 1} + 0.5::double)))::bigint)"


def _three(k: int) -> str:
    sign = f"(case when q{k} < 0 then -1 else 1 end)"
    others = [j for j in range(4) if j != k]
    return " + ".join([f"({k}::bigint << 30)", *(f"({_U(f'q{j} * {sign} * 0.7071067811865476::double + 0.5::double', 10)} << {20 - 10 * n})" for n, j in enumerate(others))])


def _rolling(rounds: int = 10) -> str:
    steps = [f"""s0 as (select gaussian_id, camera_id, mx, my, mz, a, coalesce(case when z0 > 0 then 60*x0/z0 + 32 end, case when z1 > 0 then 60*x1/z1 + 32 end) as u, coalesce(case when z0 > 0 then 60*my/z0 + 24 end, case when z1 > 0 then 60*my/z1 + 24 end) as v, 0::double as s
  from (select *, cos(a)*mx + sin(a)*mz as x0, -sin(a)*mx + cos(a)*mz as z0, cos(a + 0.05::double)*mx + sin(a + 0.05::double)*mz + 0.1::double as x1, -sin(a + 0.05::double)*mx + cos(a + 0.05::double)*mz as z1
    from gaussians cross join (select n_nationkey::int as camera_id, n_nationkey*0.02::double - 0.24::double as a from nation)))"""]
    for k in range(rounds):
        steps.append(f"""s{k + 1} as (select gaussian_id, camera_id, mx, my, mz, a, case when z > 0 then 60*x/z + 32 else u end as u, case when z > 0 then 60*my/z + 24 else v end as v, s
  from (select *, cos(g)*mx + sin(g)*mz + s*0.1::double as x, -sin(g)*mx + cos(g)*mz as z
    from (select *, 2*atan2((1 - s)*sin(a/2) + s*sin((a + 0.05::double)/2), (1 - s)*cos(a/2) + s*cos((a + 0.05::double)/2)) as g from (select * exclude (s), greatest(0, least(1, floor(v)/47)) as s from s{k}))))""")
    return f"with {V.GAUSSIANS}, {', '.join(steps)} select camera_id, gaussian_id, round(u, 4) + 0 as x, round(v, 4) + 0 as y, round(s, 4) + 0 as time, u is not null as valid from s{rounds}"


SQL = {
    "quat_covariance": f"with {V.GAUSSIANS}, {_ROT} select gaussian_id, {_r(**_cov('cov', '(s{0}*s{0})'), **_cov('prec', '((1/s{0})*(1/s{0}))'))} from rot",
    "quat_algebra": f"""with {V.GAUSSIANS}, {_ROT}, a as (select *, cos(e15*3/2) as aw, 0.6::double*sin(e15*3/2) as ax, 0::double as ay, 0.8::double*sin(e15*3/2) as az, abs(e16) as t from rot),
d as (select *, qw*aw + qx*ax + qy*ay + qz*az as d from a),
s as (select *, acos(least(1, abs(d))) as th, case when d < 0 then -1 else 1 end as f, {', '.join(f'q{c} + t*(a{c} - q{c}) as l{c}' for c in 'wxyz')} from d),
u as (select *, case when abs(d) > 0.9995::double then 1 - t else sin((1 - t)*th)/sin(th) end as u, f*(case when abs(d) > 0.9995::double then t else sin(t*th)/sin(th) end) as v, sqrt(lw*lw + lx*lx + ly*ly + lz*lz) as ln from s),
w as (select *, {', '.join(f'u*q{c} + v*a{c} as k{c}' for c in 'wxyz')} from u), x as (select *, sqrt(kw*kw + kx*kx + ky*ky + kz*kz) as kn from w)
select gaussian_id, {_r(prod0='aw*qw - ax*qx - ay*qy - az*qz', prod1='aw*qx + ax*qw + ay*qz - az*qy', prod2='aw*qy - ax*qz + ay*qw + az*qx', prod3='aw*qz + ax*qy - ay*qx + az*qw', conj0='qw', conj1='-qx', conj2='-qy', conj3='-qz',
  **{f'rot{i}': x for i, x in enumerate(_times(_FORWARD, ['mx', 'my', 'mz']))}, dist='2*acos(least(1, abs(d)))', **{f'slerp{i}': f'k{c}/kn' for i, c in enumerate('wxyz')}, **{f'lerp{i}': f'l{c}/ln' for i, c in enumerate('wxyz')})} from x""",
    "se3_poses": f"with {V.GAUSSIANS}, {_ROT} select gaussian_id, " + _r(
        **{f"point{i}": f"{x} + e{8 + i}" for i, x in enumerate(_times(_FORWARD, ["mx", "my", "mz"]))}, **{f"dir{i}": x for i, x in enumerate(_times(_FORWARD, ["mx", "my", "mz"]))},
        **{f"back{i}": x for i, x in enumerate(_times(_BACKWARD, ["(mx - e8)", "(my - e9)", "(mz - e10)"]))}, **{f"backdir{i}": x for i, x in enumerate(_times(_BACKWARD, ["mx", "my", "mz"]))},
        **{f"twice{i}": f"{x} + e{8 + i}" for i, x in enumerate(_times(_FORWARD, ["e8", "e9", "e10"]))}) + " from rot",
    "sh_color": f"with {V.GAUSSIANS}, {_BASIS} select gaussian_id, {_r(**{f'deg{k}': v for k, v in _DEG.items()}, rest=_DEG[3] + ' - b0*e1', color=f'greatest({_DEG[3]} + 0.5::double, 0)')} from basis",
    "sh_basis": f"with {V.GAUSSIANS}, {_BASIS} select gaussian_id, {_r(**{f'b{k}': f'b{k}' for k in range(25)})} from basis",
    # The slope by a direction is (g - (g . u) u) / length for the slope g by the unit vector u.
    "sh_backward": f"""with {V.GAUSSIANS}, {_BASIS}, g as (select *, sqrt(mx*mx + my*my + mz*mz) as l, 0.48860251190292::double as p, 1.0925484305920792::double as q, 0.94617469575756::double as r, 0.5462742152960395::double as s, case when {_DEG[2]} + 0.5::double > 0 then 1 else 0 end as shown from basis),
h as (select *, -p*e4 + 2*s*y*e5 - q*z*e8 + 2*s*x*e9 as g0, -p*e2 + 2*s*x*e5 - q*z*e6 - 2*s*y*e9 as g1, p*e3 - q*y*e6 + 2*r*z*e7 - q*x*e8 as g2 from g), f as (select *, x*g0 + y*g1 + z*g2 as a from h)
select gaussian_id, {_r(**{f'k{i}': f'shown*b{i}' for i in range(9)}, **{f'd{i}': f'shown*(g{i} - a*{c})/l' for i, c in enumerate('xyz')})} from f""",
    "opencv_distort": f"""with {V.GAUSSIANS}, p as (select *, u*u + v*v as rr from (select gaussian_id, mx/mz as u, my/mz as v from gaussians where mz > 0)),
l as (select *, (1 + rr*(0.1::double + rr*(-0.05::double + rr*0.01::double))) / (1 + rr*0.02::double) as radial from p),
i as (select *, 60*(radial*u + 2*u*v*0.001::double - 0.002::double*(rr + 2*u*u) + rr*0.0005::double) + 32 as x, 60*(radial*v + 0.001::double*(rr + 2*v*v) - 2*u*v*0.002::double - rr*0.0005::double) + 24 as y from l)
select gaussian_id, {_r(x='x', y='y')}, radial > 0.8::double and x >= 0 and x < 64 and y >= 0 and y < 48 as valid from i""",
    "pixel_rays": f"""with {V.CAMERAS}, g as (select c.*, x::int as x, y::int as y, (x + 0.5::double - cx)/fx as u, (y + 0.5::double - cy)/fy as v from cameras c, unnest(range(64)) a(x), unnest(range(48)) b(y)), l as (select *, sqrt(u*u + v*v + 1) as l from g)
select camera_id, x, y, {_r(ray0='(r00*u + r20)/l', ray1='v/l', ray2='(r02*u + r22)/l', down='y/47::double', up='1 - y/47::double', right='x/63::double', left='1 - x/63::double').replace('as right', 'as "right"').replace('as left', 'as "left"')} from l""",
    "morton_order": f"with {V.GAUSSIANS}, {_MORTON} select gaussian_id, code, place, place // 256 as chunk from morton",
    "pack_bits": f"""with {V.GAUSSIANS}, n as (select *, qw as q0, qx as q1, qy as q2, qz as q3, greatest(abs(qw), abs(qx), abs(qy), abs(qz)) as big from gaussians)
select gaussian_id, ({_U('mx/8 + 0.5::double', 11)} << 21) + ({_U('my/8 + 0.5::double', 10)} << 11) + {_U('mz/8 + 0.5::double', 11)} as centre,
  ({_U('c0', 8)} << 24) + ({_U('c1', 8)} << 16) + ({_U('c2', 8)} << 8) + {_U('opacity', 8)} as color,
  case when abs(q0) = big then {_three(0)} when abs(q1) = big then {_three(1)} when abs(q2) = big then {_three(2)} else {_three(3)} end as rotation from n""",
    "chunk_bounds": f"with {V.GAUSSIANS}, {_MORTON} select place // 256 as chunk, count(*) as n, {_r(**{f'{f}_{c}': f'{f}({c})' for c in (*M, *S) for f in ('min', 'max')})} from morton group by 1",
    "quantize": f"""with {V.GAUSSIANS}, b as (select *, min(mx) over () as lo, max(mx) over () as hi from gaussians), q as (select *, floor((mx - lo)/(hi - lo)*255 + 0.5::double)::bigint as b8, floor((mx - lo)/(hi - lo)*65535 + 0.5::double)::bigint as b16 from b)
select gaussian_id, b8, b16 // 256 as high, b16 % 256 as low, round(b16/65535::double*(hi - lo) + lo, 4) + 0 as back from q""",
    "rolling_shutter": _rolling(),
}
