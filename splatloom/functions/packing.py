"""Bit packing, quantisation and space-filling order as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_bits(v: Column) -> Column:
    """The 10 low bits of an integer, two zero bits between neighbours."""
    out = F.lit(0).cast("long")
    for bit in range(10):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit))
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    """The interleaved bits of three 10-bit integers, x lowest."""
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1)).bitwiseOR(F.shiftleft(spread_bits(z), 2))


def unorm(v: Column, bits: int) -> Column:
    """A value of [0, 1] as an integer of so many bits, rounded half up and clamped."""
    most = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(v * most + 0.5))).cast("long")


def pack_111011(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(unorm(x, 11), 21).bitwiseOR(F.shiftleft(unorm(y, 10), 11)).bitwiseOR(unorm(z, 11))


def pack_8888(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.shiftleft(unorm(x, 8), 24).bitwiseOR(F.shiftleft(unorm(y, 8), 16)).bitwiseOR(F.shiftleft(unorm(z, 8), 8)).bitwiseOR(unorm(w, 8))


def smallest_three(q: tuple[Column, Column, Column, Column]) -> Column:
    """Index of the largest component in 2 bits, then the other three, signed to make it positive, in 10 bits each."""
    size = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    unit = [c / size for c in q]
    largest = F.greatest(*[F.abs(c) for c in unit])
    index = F.lit(3)
    for k in (2, 1, 0):
        index = F.when(F.abs(unit[k]) == largest, F.lit(k)).otherwise(index)

    def packed(k: int) -> Column:
        sign = F.when(unit[k] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        out = F.lit(k).cast("long")
        for j in range(4):
            if j != k:
                out = F.shiftleft(out, 10).bitwiseOR(unorm(unit[j] * sign * 0.7071067811865476 + 0.5, 10))
        return out

    return F.when(index == 0, packed(0)).when(index == 1, packed(1)).when(index == 2, packed(2)).otherwise(packed(3))


def log_transform(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_log_transform(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))
