"""Rigid poses as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import poses as P
from splatloom.functions import rotation as R
from splatloom.sources import views as V

from .common import r4

_Q, _M, _T = ("qw", "qx", "qy", "qz"), ("mx", "my", "mz"), ("e8", "e9", "e10")
_D = lambda x: F.lit(float(x))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each primitive's pose, its point, and a second quaternion turned by e16 about z."""
    rows = V.gaussians(spark, folder)
    return rows.select("gaussian_id", *_Q, *_M, *_T, "e15", "e16", F.cos(F.col("e16") / 2).alias("aw"), F.sin(F.col("e16") / 2).alias("az"))


def _pose() -> P.Pose:
    return R.columns(*_T), R.columns(*_Q)


def _second() -> P.Pose:
    return R.columns(*_M), (F.col("aw"), _D(0), _D(0), F.col("az"))


def _named(prefix: str, values: tuple) -> list:
    return [r4(v).alias(f"{prefix}{k}") for k, v in enumerate(values)]


def pose_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """The 4x4 matrices of a pose and of its inverse, and the quaternion got back from the first."""
    rows = _rows(spark, folder)
    both = [r4(c).alias(f"{n}{i}{j}") for n, m in (("m", P.matrix(_pose())), ("i", P.inverse_matrix(_pose()))) for i, row in enumerate(m) for j, c in enumerate(row)]
    turn = R.rotation(R.columns(*_Q))
    back = rows.select("*", *[turn[i][j].alias(f"t{i}{j}") for i in range(3) for j in range(3)])
    q = P.from_rotation(tuple(R.columns(f"t{i}0", f"t{i}1", f"t{i}2") for i in range(3)))
    sign = F.when(q[0] < 0, _D(-1)).otherwise(_D(1))
    return back.select("gaussian_id", *both, *_named("b", tuple(sign * c for c in q)))


def pose_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Poses seen from a turned, moved and scaled frame, with quaternions in scalar-last order."""
    frame = (_D(0.5), _D(-1), _D(2)), (F.lit(0.8), F.lit(0.0), F.lit(0.6), F.lit(0.0))
    t, q = P.in_frame(_pose(), frame, F.lit(2.5))
    return _rows(spark, folder).select("gaussian_id", *_named("t", t), *_named("q", P.scalar_last(q)))


def pose_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The point through tracks of two poses and of one, and whether the time lies outside."""
    rows = _rows(spark, folder).withColumn("time", F.col("e15") * 4)
    (t, q), outside = P.between(_pose(), _D(0), _second(), _D(1), F.col("time"))
    rows = rows.select("*", outside.alias("outside"), *[c.alias(n) for n, c in zip(("ux", "uy", "uz", "vw", "vx", "vy", "vz"), (*t, *q), strict=True)])
    at = R.columns("ux", "uy", "uz"), R.columns("vw", "vx", "vy", "vz")
    one, off = P.single(_pose(), _D(0), F.col("time"))
    point = R.columns(*_M)
    return rows.select("gaussian_id", "outside", *_named("two", P.transform_point(at, point)), *_named("turn", P.transform_direction(at, point)), *_named("one", P.transform_point(one, point)), off.alias("off"))


def pose_manifold(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolation along the manifold, from the identity too, and 2-norms."""
    rows, t = _rows(spark, folder), F.abs("e15")
    a, b = R.columns(*_Q), _second()[1]
    return rows.select("gaussian_id", *_named("q", P.along_manifold(a, b, t)), *_named("i", P.along_manifold(P.identity(), a, t)), r4(P.stable_norm(F.col("mx"), F.col("my"))).alias("norm"))


def perspective(spark: SparkSession, folder: str) -> DataFrame:
    """Each camera's perspective matrix from its fields of view."""
    rows = V.cameras(spark, folder)
    fov = lambda size, f: 2 * F.atan(F.col(size) / (2 * F.col(f)))
    made = P.perspective(_D(0.01) + F.col("camera_id") * 0.01, _D(100), fov("width", "fx"), fov("height", "fy"))
    return rows.select("camera_id", *[r4(c).alias(n) for n, c in made.items()])


QUERIES = {f.__name__: f for f in (pose_matrices, pose_frames, pose_tracks, pose_manifold, perspective)}

_R = [["1 - 2*(qy*qy + qz*qz)", "2*(qx*qy - qw*qz)", "2*(qx*qz + qw*qy)"], ["2*(qx*qy + qw*qz)", "1 - 2*(qx*qx + qz*qz)", "2*(qy*qz - qw*qx)"], ["2*(qx*qz - qw*qy)", "2*(qy*qz + qw*qx)", "1 - 2*(qx*qx + qy*qy)"]]
_TS, _MS = ("e8", "e9", "e10"), ("mx", "my", "mz")
_dot = lambda row, v: " + ".join(f"({a})*{b}" for a, b in zip(row, v, strict=True))
_round = lambda e: f"round({e}, 4) + 0"
_MAT = [f"{_round(_R[i][j])} as m{i}{j}" for i in range(3) for j in range(3)] + [f"{_round(_TS[i])} as m{i}3" for i in range(3)]
_INV = [f"{_round(_R[j][i])} as i{i}{j}" for i in range(3) for j in range(3)] + [f"{_round('-(' + _dot([_R[j][i] for j in range(3)], _TS) + ')')} as i{i}3" for i in range(3)]
_FR = [["1 - 2*0.36::double", "0", "2*0.48::double"], ["0", "1", "0"], ["-2*0.48::double", "0", "1 - 2*0.36::double"]]
_FT = ("0.5::double", "-1", "2")
_MUL = lambda a, b: [f"{a[0]}*{b[0]} - {a[1]}*{b[1]} - {a[2]}*{b[2]} - {a[3]}*{b[3]}", f"{a[0]}*{b[1]} + {a[1]}*{b[0]} + {a[2]}*{b[3]} - {a[3]}*{b[2]}", f"{a[0]}*{b[2]} - {a[1]}*{b[3]} + {a[2]}*{b[0]} + {a[3]}*{b[1]}", f"{a[0]}*{b[3]} + {a[1]}*{b[2]} - {a[2]}*{b[1]} + {a[3]}*{b[0]}"]
_FQ = _MUL(("0.8::double", "0", "0.6::double", "0"), _Q)
_RV = [[c.replace("qw", "vw").replace("qx", "vx").replace("qy", "vy").replace("qz", "vz") for c in row] for row in _R]
_REL = _MUL(("qw", "(-qx)", "(-qy)", "(-qz)"), ("aw", "0", "0", "az"))
_ALONG = _MUL(_Q, ("cos(t*h)", "k*d1", "k*d2", "k*d3"))
SQL = {
    "pose_matrices": f"with {V.GAUSSIANS} select gaussian_id, {', '.join(_MAT + _INV)}, {', '.join(f'round(case when qw < 0 then -{c} else {c} end, 4) + 0 as b{k}' for k, c in enumerate(_Q))} from gaussians",
    "pose_frames": f"with {V.GAUSSIANS} select gaussian_id, {', '.join(f'round(2.5::double*({_dot(_FR[i], _TS)} + {_FT[i]}), 4) + 0 as t{i}' for i in range(3))}, {', '.join(f'round({_FQ[(k + 1) % 4]}, 4) + 0 as q{k}' for k in range(4))} from gaussians",
    "pose_tracks": f"""with {V.GAUSSIANS}, s as (select *, e15*4 as t, e15*4 as u, cos(e16/2) as aw, sin(e16/2) as az from gaussians), d as (select *, qw*aw + qz*az as dot from s),
w as (select *, case when abs(dot) > 0.9995::double then 1 - u else sin((1 - u)*acos(least(1, abs(dot))))/sin(acos(least(1, abs(dot)))) end as f,
  (case when dot < 0 then -1 else 1 end)*case when abs(dot) > 0.9995::double then u else sin(u*acos(least(1, abs(dot))))/sin(acos(least(1, abs(dot)))) end as g from d),
n as (select *, f*qw + g*aw as rw, f*qx as rx, f*qy as ry, f*qz + g*az as rz from w), v as (select *, rw/l as vw, rx/l as vx, ry/l as vy, rz/l as vz from (select *, sqrt(rw*rw + rx*rx + ry*ry + rz*rz) as l from n))
select gaussian_id, t < 0 or t > 1 as outside, t <> 0 as off, {', '.join(f'round({_dot(_RV[i], _MS)} + {_TS[i]} + u*({_MS[i]} - {_TS[i]}), 4) + 0 as two{i}, round({_dot(_RV[i], _MS)}, 4) + 0 as turn{i}, round({_dot(_R[i], _MS)} + {_TS[i]}, 4) + 0 as one{i}' for i in range(3))} from v""",
    "pose_manifold": f"""with {V.GAUSSIANS}, s as (select *, abs(e15) as t, cos(e16/2) as aw, sin(e16/2) as az from gaussians), d as (select *, {', '.join(f'{c} as d{k}' for k, c in enumerate(_REL))} from s),
h as (select *, sqrt(d1*d1 + d2*d2 + d3*d3) as l, atan2(sqrt(d1*d1 + d2*d2 + d3*d3), abs(d0)) as h, sqrt(qx*qx + qy*qy + qz*qz) as m, atan2(sqrt(qx*qx + qy*qy + qz*qz), abs(qw)) as g from d),
k as (select *, (case when d0 < 0 then -1 else 1 end)*case when l > 1e-8 then sin(t*h)/l else t end as k, (case when qw < 0 then -1 else 1 end)*case when m > 1e-8 then sin(t*g)/m else t end as j from h)
select gaussian_id, {', '.join(f'round({c}, 4) + 0 as q{i}' for i, c in enumerate(_ALONG))}, round(cos(t*g), 4) + 0 as i0, round(j*qx, 4) + 0 as i1, round(j*qy, 4) + 0 as i2, round(j*qz, 4) + 0 as i3, round(sqrt(mx*mx + my*my), 4) + 0 as norm from k""",
    "perspective": f"with {V.CAMERAS}, n as (select camera_id, 0.01::double + camera_id*0.01::double as n from cameras) select camera_id, round(60::double/32, 4) + 0 as p00, round(60::double/24, 4) + 0 as p11, round(100/(100 - n), 4) + 0 as p22, round(-100*n/(100 - n), 4) + 0 as p23, 1::double as p32 from n",
}
