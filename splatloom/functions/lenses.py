"""Distorted lenses and sensor angles as Column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """By Horner's rule, lowest power first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def odd_polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """x (1 + c1 x^2 + c2 x^4 + ...)."""
    return x * polynomial(x * x, [1.0, *coefficients])


def inverse_by_newton(y: Column, coefficients: Sequence[float], steps: int, guess: Column) -> Column:
    """x with ``polynomial(x) = y`` after a fixed number of Newton steps from a guess."""
    slope = [k * c for k, c in enumerate(coefficients)][1:]
    step = lambda x, _: x - (polynomial(x, coefficients) - y) / polynomial(x, slope)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), guess, step)


def angle_to_axis(x: Column, y: Column, z: Column) -> Column:
    return F.atan2(F.sqrt(x * x + y * y), z)


def bivariate(u: Column, v: Column, coefficients: Sequence[float]) -> Column:
    """Polynomial in two variables, triangular layout: rows by power of v, each by power of u."""
    order = (int((1 + 8 * len(coefficients)) ** 0.5) - 3) // 2
    out, at = F.lit(0.0), 0
    for j in range(order + 1):
        row = coefficients[at : at + order + 1 - j]
        out, at = out + polynomial(u, row) * (v**j if j else F.lit(1.0)), at + len(row)
    return out


def direction(elevation: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    return F.cos(elevation) * F.cos(azimuth), F.cos(elevation) * F.sin(azimuth), F.sin(elevation)


def opencv_distortion(u: Column, v: Column, c: dict[str, float]) -> tuple[Column, Column, Column]:
    """(radial factor, shift of u, shift of v) at undistorted slopes; ``c`` has any of k1..k6, p1, p2, s1..s4."""
    k = lambda n: float(c.get(n, 0.0))
    rr = u * u + v * v
    radial = polynomial(rr, [1.0, k("k1"), k("k2"), k("k3")]) / polynomial(rr, [1.0, k("k4"), k("k5"), k("k6")])
    du = 2 * u * v * k("p1") + k("p2") * (rr + 2 * u * u) + rr * (k("s1") + rr * k("s2"))
    dv = k("p1") * (rr + 2 * v * v) + 2 * u * v * k("p2") + rr * (k("s3") + rr * k("s4"))
    return radial, du, dv


def opencv_undistorted(u: Column, v: Column, c: dict[str, float], rounds: int = 10) -> Column:
    """A struct (u, v) of undistorted slopes, by a fixed number of rounds of (distorted - shift) / radial factor."""

    def step(at: Column, _: Column) -> Column:
        radial, du, dv = opencv_distortion(at["u"], at["v"], c)
        return F.struct(((u - du) / radial).alias("u"), ((v - dv) / radial).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(u.alias("u"), v.alias("v")), step)


def shutter_share(x: Column, y: Column, width: Column, height: Column, direction: Column) -> Column:
    """The share of the exposure at which an image point is read, by direction: down, right, up, left; 0 for any other.

    An image of one row (column) is read at 0.5.
    """
    along = lambda passed, size: F.when(size > 1, passed / (size - 1)).otherwise(0.5)
    share = F.when(direction == "down", along(F.floor(y), height)).when(direction == "right", along(F.floor(x), width))
    return share.when(direction == "up", along(height - F.ceil(y), height)).when(direction == "left", along(width - F.ceil(x), width)).otherwise(0.0)
