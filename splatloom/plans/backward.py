"""Backward of the projection as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splatloom.operators import backward as B
from splatloom.operators import composite as C
from splatloom.sources import views as V

from . import rendering
from .common import r4


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    slopes = C.shape_gradients(rendering.weighted_pairs(spark, folder), ["c0", "c1", "c2"])
    return B.projection_slopes(slopes, V.gaussians(spark, folder), V.cameras(spark, folder))


def project_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Derivatives of all summed channels of all images by each primitive's centre, quaternion and scales."""
    return B.to_primitives(_rows(spark, folder)).select("gaussian_id", *[r4(f"v_{c}").alias(f"v_{c}") for c in (*B.CENTRE, *B.TURN, *B.SIZE)])


def camera_backward(spark: SparkSession, folder: str) -> DataFrame:
    """The same by each camera's pose."""
    return B.to_cameras(_rows(spark, folder)).select("camera_id", *[r4(f"v_{c}").alias(f"v_{c}") for c in B.POSE])


QUERIES = {f.__name__: f for f in (project_backward, camera_backward)}

# The oracle goes forward: a row for each parameter with the tangents of the point in the camera (dp) and of the body
# as the camera sees it (dw); the same formulas for all take these to the mean and the conic.
_UNIT = {"mx": 0, "my": 1, "mz": 2}
_TURNS = {  # derivatives of the matrix of a unit quaternion
    "qw": ("0", "-2*qz", "2*qy", "2*qz", "0", "-2*qx", "-2*qy", "2*qx", "0"),
    "qx": ("0", "2*qy", "2*qz", "2*qy", "-4*qx", "-2*qw", "2*qz", "2*qw", "-4*qx"),
    "qy": ("-4*qy", "2*qx", "2*qw", "2*qx", "0", "2*qz", "-2*qw", "2*qz", "-4*qy"),
    "qz": ("-4*qz", "-2*qw", "2*qx", "2*qw", "-4*qz", "2*qy", "2*qx", "2*qy", "0"),
}


def _tangent(name: str, dp: list[str], dw: list[str]) -> str:
    return f"select *, '{name}' as name, {', '.join(f'({e})::double as dp{i}' for i, e in enumerate(dp))}, {', '.join(f'({e})::double as dw{k // 3}{k % 3}' for k, e in enumerate(dw))} from back"


def _chain(tangents: list[str]) -> str:
    dj = {  # of the entries of the Jacobian that are not 0
        "00": "-fx/(pz*pz)*dp2",
        "02": "case when sx_ = px/pz then -fx/(pz*pz)*dp0 + 2*fx*px/(pz*pz*pz)*dp2 else fx*sx_/(pz*pz)*dp2 end",
        "11": "-fy/(pz*pz)*dp2",
        "12": "case when sy_ = py/pz then -fy/(pz*pz)*dp1 + 2*fy*py/(pz*pz*pz)*dp2 else fy*sy_/(pz*pz)*dp2 end",
    }
    flat = lambda w, i, k: f"j{i}{i}*{w}{i}{k} + j{i}2*{w}2{k}"
    moved = [f"({flat('dw', i, k)} + dj{i}{i}*w{i}{k} + dj{i}2*w2{k}) as df{i}{k}" for i in range(2) for k in range(3)]
    square = lambda i, j: " + ".join(f"df{i}{k}*f{j}{k} + f{i}{k}*df{j}{k}" for k in range(3))
    return f"""back_t as ({' union all '.join(tangents)}),
back_u as (select *, {', '.join(f'{e} as dj{n}' for n, e in dj.items())}, fx*(dp0/pz - px*dp2/(pz*pz)) as dx, fy*(dp1/pz - py*dp2/(pz*pz)) as dy from back_t),
back_v as (select *, {', '.join(moved)} from back_u),
back_w as (select *, {square(0, 0)} as da, {square(0, 1)} as db, {square(1, 1)} as dc from back_v),
back_x as (select *, a*dc + c*da - 2*b*db as ddet from back_w),
back_y as (select camera_id, gaussian_id, name, v_mean_x*dx + v_mean_y*dy + v_conic_a*(dc/det - c*ddet/(det*det)) + v_conic_b*(-db/det + b*ddet/(det*det)) + v_conic_c*(da/det - a*ddet/(det*det)) as s from back_x)"""


def _base() -> str:
    turn = [["1 - 2*(qy*qy + qz*qz)", "2*(qx*qy - qw*qz)", "2*(qx*qz + qw*qy)"], ["2*(qx*qy + qw*qz)", "1 - 2*(qx*qx + qz*qz)", "2*(qy*qz - qw*qx)"], ["2*(qx*qz - qw*qy)", "2*(qy*qz + qw*qx)", "1 - 2*(qx*qx + qy*qy)"]]
    body = ", ".join(f"({turn[i][k]})*s{n} as b{i}{k}, {turn[i][k]} as g{i}{k}" for i in range(3) for k, n in enumerate("xyz"))
    points = ", ".join(f"r{i}0*mx + r{i}1*my + r{i}2*mz as p{n}" for i, n in enumerate("xyz"))
    seen = ", ".join(f"r{i}0*b0{k} + r{i}1*b1{k} + r{i}2*b2{k} as w{i}{k}" for i in range(3) for k in range(3))
    clamp = lambda p, c, size, f: f"least(({size} - {c})/{f} + 0.15::double*{size}/{f}, greatest(-({c}/{f} + 0.15::double*{size}/{f}), {p}/pz))"
    flat = ", ".join(f"j{i}{i}*w{i}{k} + j{i}2*w2{k} as f{i}{k}" for i in range(2) for k in range(3))
    square = lambda i, j: " + ".join(f"f{i}{k}*f{j}{k}" for k in range(3))
    return f"""{rendering.PLAIN}{rendering.blend()}{rendering._BACK_SHAPE},
back0 as (select g.*, p.* exclude (gaussian_id), c.* exclude (camera_id), {body}, {points} from g join gaussians p on p.gaussian_id = g.gaussian_id join cameras c on c.camera_id = g.camera_id),
back1 as (select *, {seen}, {clamp('px', 'cx', 'width', 'fx')} as sx_, {clamp('py', 'cy', 'height', 'fy')} as sy_ from back0),
back2 as (select *, fx/pz as j00, -fx*sx_/pz as j02, fy/pz as j11, -fy*sy_/pz as j12 from back1),
back3 as (select *, {flat} from back2), back4 as (select *, {square(0, 0)} + 0.3::double as a, {square(0, 1)} as b, {square(1, 1)} + 0.3::double as c from back3), back as (select *, a*c - b*b as det from back4)"""


def _primitive_tangents() -> list[str]:
    none = ["0"] * 9
    out = [_tangent(n, [f"r{i}{k}" for i in range(3)], none) for n, k in _UNIT.items()]
    out += [_tangent(f"s{n}", ["0"] * 3, [f"r{i}0*g0{k} + r{i}1*g1{k} + r{i}2*g2{k}" if j == k else "0" for i in range(3) for j in range(3)]) for k, n in enumerate("xyz")]
    # Along a quaternion's own direction nothing moves: the part of the unit step across it.
    across = lambda e, q: " + ".join(f"({'1' if n == q else '0'} - {q}*{n})*({_TURNS[n][e]})" for n in _TURNS)
    for q in _TURNS:
        out.append(_tangent(q, ["0"] * 3, [" + ".join(f"r{i}{j}*({across(3 * j + k, q)})*s{n}" for j in range(3)) for i in range(3) for k, n in enumerate("xyz")]))
    return out


def _camera_tangents() -> list[str]:
    out = [_tangent(f"t{k}", ["1" if i == k else "0" for i in range(3)], ["0"] * 9) for k in range(3)]
    for i in range(3):
        for j, m in enumerate(("mx", "my", "mz")):
            out.append(_tangent(f"r{i}{j}", [m if x == i else "0" for x in range(3)], [f"b{j}{k}" if x == i else "0" for x in range(3) for k in range(3)]))
    return out


_SUMS = lambda names: ", ".join(f"round(sum(s) filter (name = '{n}'), 4) + 0 as v_{n}" for n in names)
SQL = {
    "project_backward": f"with {_base()}, {_chain(_primitive_tangents())} select gaussian_id, {_SUMS((*B.CENTRE, *B.TURN, *B.SIZE))} from back_y group by 1",
    "camera_backward": f"with {_base()}, {_chain(_camera_tangents())} select camera_id, {_SUMS(B.POSE)} from back_y group by 1",
}
