"""Rigid poses as Column arithmetic: a translation and a unit quaternion (w, x, y, z) that take a frame's points to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rotation as R
from .rotation import Matrix, Quaternion, Vector

Pose = tuple[Vector, Quaternion]


def identity() -> Quaternion:
    return F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)


def added(a: Vector, b: Vector, sign: int = 1) -> Vector:
    return tuple(x + y if sign > 0 else x - y for x, y in zip(a, b, strict=True))


def transform_point(pose: Pose, point: Vector) -> Vector:
    return added(R.apply(R.rotation(pose[1]), point), pose[0])


def transform_direction(pose: Pose, direction: Vector) -> Vector:
    return R.apply(R.rotation(pose[1]), direction)


def inverse_point(pose: Pose, point: Vector) -> Vector:
    return R.apply(R.transposed(R.rotation(pose[1])), added(point, pose[0], -1))


def inverse_direction(pose: Pose, direction: Vector) -> Vector:
    return R.apply(R.transposed(R.rotation(pose[1])), direction)


def compose(a: Pose, b: Pose) -> Pose:
    """The pose b, then a."""
    return transform_point(a, b[0]), R.multiply(a[1], b[1])


def matrix(pose: Pose) -> tuple[tuple[Column, ...], ...]:
    """The first three rows of the 4x4 matrix; the last is (0, 0, 0, 1)."""
    return tuple((*row, t) for row, t in zip(R.rotation(pose[1]), pose[0], strict=True))


def inverse_matrix(pose: Pose) -> tuple[tuple[Column, ...], ...]:
    """The first three rows of the inverse's 4x4 matrix."""
    turned = R.transposed(R.rotation(pose[1]))
    return tuple((*row, -t) for row, t in zip(turned, R.apply(turned, pose[0]), strict=True))


def from_rotation(m: Matrix) -> Quaternion:
    """The unit quaternion of a rotation matrix, by its largest component; its first component that isn't 0 may have either sign."""
    trace = m[0][0] + m[1][1] + m[2][2]
    square = [1 + trace, 1 + 2 * m[0][0] - trace, 1 + 2 * m[1][1] - trace, 1 + 2 * m[2][2] - trace]  # 4 times the components' squares
    root = [F.sqrt(F.greatest(s, F.lit(1e-12))) for s in square]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[1][0] + m[0][1], m[0][2] + m[2][0], m[2][1] + m[1][2]
    scaled = [(root[0], a / root[0], b / root[0], c / root[0]), (a / root[1], root[1], d / root[1], e / root[1]), (b / root[2], d / root[2], root[2], f / root[2]), (c / root[3], e / root[3], f / root[3], root[3])]
    most = F.greatest(*square)
    pick = lambda k: F.when(square[0] == most, scaled[0][k]).when(square[1] == most, scaled[1][k]).when(square[2] == most, scaled[2][k]).otherwise(scaled[3][k]) / 2
    return tuple(pick(k) for k in range(4))


def in_frame(pose: Pose, frame: Pose, scale: Column) -> Pose:
    """The pose seen from another frame, whose lengths are ``scale`` times as long."""
    moved = transform_point(frame, pose[0])
    return tuple(scale * x for x in moved), R.multiply(frame[1], pose[1])


def between(first: Pose, first_time: Column, last: Pose, last_time: Column, time: Column) -> tuple[Pose, Column]:
    """(the pose at ``time``, whether that is out of bounds) of a track of two poses; outside, the track goes on as it does inside."""
    low, high = F.least(first_time, last_time), F.greatest(first_time, last_time)
    gap = last_time - first_time
    share = F.when(gap == 0, F.lit(0.0)).otherwise((time - first_time) / gap)
    return (R.lerp(first[0], last[0], share), R.slerp(first[1], last[1], share)), (time < low) | (time > high)


def single(pose: Pose, pose_time: Column, time: Column) -> tuple[Pose, Column]:
    """``between`` for a track of one pose: out of bounds at any other time."""
    return pose, time != pose_time


def along_manifold(a: Quaternion, b: Quaternion, t: Column) -> Quaternion:
    """a exp(t log(a^-1 b)), along the shorter arc."""
    d = R.multiply(R.conjugate(a), b)
    sign = F.when(d[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = R.norm(d[1:])
    half = F.atan2(size, F.abs(d[0]))
    share = F.when(size > 1e-8, sign * F.sin(t * half) / size).otherwise(sign * t)
    return R.multiply(a, (F.cos(t * half), *(share * x for x in d[1:])))


def scalar_last(q: Quaternion) -> Quaternion:
    """(x, y, z, w) of (w, x, y, z)."""
    return q[1], q[2], q[3], q[0]


def scalar_first(q: Quaternion) -> Quaternion:
    """(w, x, y, z) of (x, y, z, w)."""
    return q[3], q[0], q[1], q[2]


def perspective(near: Column, far: Column, fov_x: Column, fov_y: Column) -> dict[str, Column]:
    """The entries of the perspective matrix that aren't 0, by row and column."""
    return {"p00": 1 / F.tan(fov_x / 2), "p11": 1 / F.tan(fov_y / 2), "p22": far / (far - near), "p23": -far * near / (far - near), "p32": F.lit(1.0)}


def stable_norm(x: Column, y: Column) -> Column:
    """The length of (x, y), without overflow on the way."""
    low, high = F.least(F.abs(x), F.abs(y)), F.greatest(F.abs(x), F.abs(y))
    return F.when(high > 0, high * F.sqrt(1 + (low / high) * (low / high))).otherwise(F.lit(0.0))
