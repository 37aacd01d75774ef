"""Alignment of scenes: upright and centred by their cameras, or turned to the principal axes of their points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatloom.functions import rotation as R
from splatloom.sources.tables import written

from .quantiles import exact_quantiles

MATRIX = [f"a{i}{j}" for i in range(3) for j in range(4)]


def transformed(points: DataFrame, transforms: DataFrame, key: str, at: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """``points`` (key, x, y, z, ...) moved by the 3x4 matrix a00..a23 of their scene."""
    rows = points.join(transforms.select(key, *MATRIX), key)
    moved = {n: R.dot(R.columns(f"a{i}0", f"a{i}1", f"a{i}2"), R.columns(*at)) + F.col(f"a{i}3") for i, n in enumerate(at)}
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in points.columns])


def upright(cameras: DataFrame, key: str = "scene_id", focus: bool = True, strict: bool = False) -> DataFrame:
    """``key``, a00..a23 and scale of the similarity that normalises each scene of camera-to-world poses r00..r22, t0..2.

    The mean of the cameras' up axes turns to -y; the median of the points where the viewing axes pass nearest to the origin
    (or, without ``focus``, of the cameras) moves there; the median (``strict``: largest) distance of a camera becomes 1.
    If the cameras' up axis is +y, x and y change their sign; a scene whose distance is 0 keeps its size.
    """
    up = [-F.avg(f"r{i}1") for i in range(3)]
    mean = cameras.groupBy(key).agg(*[u.alias(f"u{i}") for i, u in enumerate(up)])
    long = R.norm(R.columns("u0", "u1", "u2"))
    mean = mean.select(key, *[(F.col(f"u{i}") / long).alias(f"u{i}") for i in range(3)])
    # The turn of (u0, u1, u2) to (0, -1, 0): 1 + K + K K / (1 + c) with the cross product k and the cosine c.
    # Next to -1 the sum 1 + c has no digits left; there it is k k / (1 - c).
    c, k = -F.col("u1"), (F.col("u2"), F.lit(0.0), -F.col("u0"))
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    kk = F.col("u0") * F.col("u0") + F.col("u2") * F.col("u2")
    share = F.when(c < 0, (1 - c) / kk).otherwise(1 / (1 + c))
    square = [[R.dot(tuple(skew[i]), tuple(skew[m][j] for m in range(3))) for j in range(3)] for i in range(3)]
    flipped = [[-1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0]]
    turn = [[F.when((c > 0) | (kk > 0), F.lit(float(i == j)) + skew[i][j] + square[i][j] * share).otherwise(flipped[i][j]).alias(f"q{i}{j}") for j in range(3)] for i in range(3)]
    # Written once: means come out by other last digits when their rows meet in another order, and every pass over what is turned must see the same.
    turns = written(mean.select(key, *[x for row in turn for x in row]), "turns")
    rows = cameras.select(key, *[f"r{i}2" for i in range(3)], "t0", "t1", "t2").join(turns, key)
    q = [R.columns(f"q{i}0", f"q{i}1", f"q{i}2") for i in range(3)]
    rows = rows.select(key, *[R.dot(q[i], R.columns("t0", "t1", "t2")).alias(f"p{i}") for i in range(3)], *[R.dot(q[i], R.columns("r02", "r12", "r22")).alias(f"d{i}") for i in range(3)])
    p, d = R.columns("p0", "p1", "p2"), R.columns("d0", "d1", "d2")
    near = [(p[i] - R.dot(d, p) * d[i] if focus else p[i]).alias(f"m{i}") for i in range(3)]
    middle = written(exact_quantiles(rows.select(key, *near), [key], ["m0", "m1", "m2"]), "middles")
    far = rows.join(middle, key).select(key, R.norm(tuple(p[i] - F.col(f"m{i}") for i in range(3))).alias("far"))
    size = far.groupBy(key).agg(F.max("far").alias("far")) if strict else exact_quantiles(far, [key], ["far"])
    scale = F.when(F.col("far") > 0, 1 / F.col("far")).otherwise(1.0)
    matrix = [(scale * (F.col(f"q{i}{j}") if j < 3 else -F.col(f"m{i}"))).alias(f"a{i}{j}") for i in range(3) for j in range(4)]
    return turns.join(middle, key).join(size, key).select(key, *matrix, scale.alias("scale"))


def _axes(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("c00", "c01", "c02", "c11", "c12", "c22")}
            body = np.stack([np.stack([c["c00"], c["c01"], c["c02"]], 1), np.stack([c["c01"], c["c11"], c["c12"]], 1), np.stack([c["c02"], c["c12"], c["c22"]], 1)], 1)
            spread, axes = np.linalg.eigh(np.nan_to_num(body))
            spread, axes = spread[:, ::-1], axes[:, :, ::-1].copy()
            axes[np.linalg.det(axes) < 0, :, 0] *= -1
            middle = np.stack([batch.column(f"m{i}").to_numpy(zero_copy_only=False) for i in range(3)], 1)
            shift = -np.einsum("nji,nj->ni", axes, middle)
            matrix = [pa.array(axes[:, j, i] if j < 3 else shift[:, i]) for i in range(3) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *matrix, *(pa.array(spread[:, i]) for i in range(3))], [key, *MATRIX, "spread0", "spread1", "spread2"])

    return run


def principal_axes(points: DataFrame, key: str = "scene_id", at: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """``key``, a00..a23 and the variances spread0..2, largest first, along the axes that the matrix turns to x, y and z.

    The median of each coordinate moves to the origin; the matrix is a rotation.  Points become one row of sums for
    each scene, and only these small rows are decomposed.  The axes' signs are those of the decomposition.
    """
    middle = exact_quantiles(points, [key], list(at)).withColumnsRenamed({n: f"m{i}" for i, n in enumerate(at)})
    centred = points.select(key, *at).join(middle, key).select(key, "m0", "m1", "m2", *[(F.col(n) - F.col(f"m{i}")).alias(f"p{i}") for i, n in enumerate(at)])
    covariance = [F.covar_samp(f"p{i}", f"p{j}").alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)]
    rows = centred.groupBy(key, "m0", "m1", "m2").agg(*covariance)
    schema = f"`{key}` {points.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in (*MATRIX, "spread0", "spread1", "spread2"))
    return rows.mapInArrow(_axes(key), schema)
