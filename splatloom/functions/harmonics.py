"""Real spherical harmonics up to degree 4 as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normalisation constants of the real harmonics, by degree.
C0 = 0.2820947917738781
C1 = 0.48860251190292
C2 = (1.092548430592079, 0.5462742152960395, 0.9461746957575601, 0.3153915652525201)
C3 = (2.285228997322329, 0.4570457994644658, 1.445305721320277, 0.5900435899266435, 1.865881662950577, 1.119528997770346)
C4 = (4.683325804901025, 2.007139630671868, 3.31161143515146, 0.47308734787878, 1.770130769779931, 0.6258357354491763, 1.984313483298443, 1.006230589874905)


def basis(degree: int, x: Column, y: Column, z: Column) -> list[Column]:
    """The (degree + 1)**2 values at a unit direction, by degree and order."""
    out = [F.lit(C0)]
    if degree >= 1:
        out += [-C1 * y, C1 * z, -C1 * x]
    if degree >= 2:
        even, odd = x * x - y * y, 2 * x * y
        out += [C2[1] * odd, -C2[0] * z * y, C2[2] * z * z - C2[3], -C2[0] * z * x, C2[1] * even]
    if degree >= 3:
        near = -C3[0] * z * z + C3[1]
        even3, odd3 = x * even - y * odd, x * odd + y * even
        out += [-C3[3] * odd3, C3[2] * z * odd, near * y, z * (C3[4] * z * z - C3[5]), near * x, C3[2] * z * even, -C3[3] * even3]
    if degree >= 4:
        low, mid = z * (-C4[0] * z * z + C4[1]), C4[2] * z * z - C4[3]
        even4, odd4 = x * even3 - y * odd3, x * odd3 + y * even3
        top = C4[6] * z * z * (C3[4] * z * z - C3[5]) - C4[7] * (C2[2] * z * z - C2[3])
        out += [C4[5] * odd4, -C4[4] * z * odd3, mid * odd, low * y, top, low * x, mid * even, -C4[4] * z * even3, C4[5] * even4]
    return out


def evaluate(degree: int, direction: tuple[Column, Column, Column], coefficients: list[Column]) -> Column:
    """The dot product of basis and coefficients."""
    out = F.lit(0.0)
    for b, c in zip(basis(degree, *direction), coefficients, strict=False):
        out = out + b * c
    return out


def slopes(degree: int, direction: tuple[Column, Column, Column], coefficients: list[Column]) -> tuple[list[Column], tuple[Column, Column, Column]]:
    """Derivatives of ``evaluate`` by each coefficient, and by the three parts of an unnormalised direction; up to degree 2."""
    if degree > 2:
        raise ValueError("slopes by the direction are known up to degree 2")
    size = F.sqrt(sum((d * d for d in direction[1:]), direction[0] * direction[0]))
    x, y, z = (d / size for d in direction)
    k = [*coefficients[: (degree + 1) ** 2], *[F.lit(0.0)] * (9 - (degree + 1) ** 2)]
    by_x = -C1 * k[3] + C2[1] * 2 * y * k[4] - C2[0] * z * k[7] + C2[1] * 2 * x * k[8]
    by_y = -C1 * k[1] + C2[1] * 2 * x * k[4] - C2[0] * z * k[5] - C2[1] * 2 * y * k[8]
    by_z = C1 * k[2] - C2[0] * y * k[5] + 2 * C2[2] * z * k[6] - C2[0] * x * k[7]
    along = x * by_x + y * by_y + z * by_z
    return basis(degree, x, y, z), tuple((g - along * d) / size for g, d in ((by_x, x), (by_y, y), (by_z, z)))
