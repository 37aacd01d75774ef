"""Quaternions (w, x, y, z), rotations and rigid poses as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]
#: Rows of a 3x3 matrix.
Matrix = tuple[Vector, Vector, Vector]


def columns(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(v: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: tuple[Column, ...], eps: float = 1e-12) -> tuple[Column, ...]:
    """v / |v|; a vector shorter than ``eps`` stays as it is."""
    size = norm(v)
    return tuple(F.when(size > eps, x / size).otherwise(x) for x in v)


def conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """The Hamilton product: the rotation b, then a."""
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def rotation(q: Quaternion) -> Matrix:
    """The matrix of a unit quaternion."""
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def apply(m: Matrix, v: Vector) -> Vector:
    return tuple(dot(row, v) for row in m)


def transposed(m: Matrix) -> Matrix:
    return tuple(tuple(m[i][j] for i in range(3)) for j in range(3))


def covariance(r: Matrix, s: Vector) -> tuple[Column, ...]:
    """The upper triangle (00, 01, 02, 11, 12, 22) of R S S' R'."""
    scaled = tuple(tuple(r[i][k] * s[k] for k in range(3)) for i in range(3))
    return tuple(dot(scaled[i], scaled[j]) for i in range(3) for j in range(i, 3))


def symmetric(u: tuple[Column, ...]) -> Matrix:
    """The full matrix of an upper triangle."""
    return (u[0], u[1], u[2]), (u[1], u[3], u[4]), (u[2], u[4], u[5])


def axis_angle(axis: Vector, angle: Column) -> Quaternion:
    s = F.sin(angle / 2)
    return F.cos(angle / 2), axis[0] * s, axis[1] * s, axis[2] * s


def angular_distance(a: Quaternion, b: Quaternion) -> Column:
    """The angle of the rotation between two unit quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def lerp(a: tuple[Column, ...], b: tuple[Column, ...], t: Column) -> tuple[Column, ...]:
    return tuple(x + t * (y - x) for x, y in zip(a, b, strict=True))


def slerp_shares(a: Quaternion, b: Quaternion, t: Column) -> tuple[Column, Column]:
    """The shares of a and b in their spherical interpolation along the shorter arc; linear where they are nearly equal."""
    d = dot(a, b)
    flip = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
    near = F.abs(d) > 0.9995
    return F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle)), flip * F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))


def slerp(a: Quaternion, b: Quaternion, t: Column) -> Quaternion:
    """Spherical interpolation.  For long inputs, select ``slerp_shares`` first: the shares are used many times."""
    u, v = slerp_shares(a, b, t)
    return normalised(tuple(u * x + v * y for x, y in zip(a, b, strict=True)))
