"""Rolling-shutter projection: each image row has its own time, hence its own pose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

from .project import computed, spread_out

#: Rounds of the fixed point (pixel -> time of its row -> pose -> pixel).
ROUNDS = 10


def row_time(y: Column, height: Column) -> Column:
    """The share of the exposure at which a row is read, top to bottom."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(y) / (height - 1)))


def project_shutter(points: DataFrame, cameras: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(camera_id, point_id, x, y, time, valid) of points (point_id, px, py, pz) seen while the camera moves.

    ``cameras`` has lens, size, and poses world-to-camera at the start and the end of the exposure:
    quaternions aw..az and bw..bz, shifts at0..2 and bt0..2.  The first guess is the point seen from
    the start pose, or from the end pose where that sees nothing.  ``valid`` is false where neither
    has the point in front.
    """
    lens = ["fx", "fy", "cx", "cy", "width", "height"]
    a, b = R.columns("aw", "ax", "ay", "az"), R.columns("bw", "bx", "by", "bz")
    p, keep = R.columns("px", "py", "pz"), ["camera_id", "point_id", *lens, "aw", "ax", "ay", "az", "bw", "bx", "by", "bz", "at0", "at1", "at2", "bt0", "bt1", "bt2", "px", "py", "pz"]
    rows = spread_out(points.select("point_id", "px", "py", "pz")).crossJoin(cameras)

    def seen(rows: DataFrame, q: R.Quaternion, shift: R.Vector, extra: list[str]) -> DataFrame:
        at = R.apply(R.rotation(q), p)
        rows = rows.select(*keep, *extra, *[(c + s).alias(f"k{i}") for i, (c, s) in enumerate(zip(at, shift, strict=True))])
        u, v = F.col("fx") * F.col("k0") / F.col("k2") + F.col("cx"), F.col("fy") * F.col("k1") / F.col("k2") + F.col("cy")
        return rows.select(*keep, *extra, F.when(F.col("k2") > 0, u).alias("u"), F.when(F.col("k2") > 0, v).alias("v"))

    rows = seen(rows, a, R.columns("at0", "at1", "at2"), []).withColumnsRenamed({"u": "u0", "v": "v0"})
    rows = seen(rows, b, R.columns("bt0", "bt1", "bt2"), ["u0", "v0"])
    rows = computed(rows, *keep, F.coalesce("u0", "u").alias("u"), F.coalesce("v0", "v").alias("v")).withColumn("valid", F.col("u").isNotNull())
    for _ in range(rounds):
        rows = rows.withColumn("s", row_time(F.col("v"), F.col("height")))
        share = R.slerp_shares(a, b, F.col("s"))
        rows = rows.select(*keep, "valid", "s", "u", "v", share[0].alias("sa"), share[1].alias("sb"))
        turn = [(F.col("sa") * x + F.col("sb") * y).alias(f"q{i}") for i, (x, y) in enumerate(zip(a, b, strict=True))]
        shift = R.lerp(R.columns("at0", "at1", "at2"), R.columns("bt0", "bt1", "bt2"), F.col("s"))
        rows = rows.select(*keep, "valid", "s", "u", "v", *turn, *[c.alias(f"t{i}") for i, c in enumerate(shift)])
        q = R.columns("q0", "q1", "q2", "q3")
        rows = rows.withColumn("size", R.norm(q)).select(*keep, "valid", "s", "u", "v", "t0", "t1", "t2", *[(c / F.col("size")).alias(f"q{i}") for i, c in enumerate(q)])
        at = R.apply(R.rotation(q), p)
        rows = rows.select(*keep, "valid", "s", "u", "v", *[(c + F.col(f"t{i}")).alias(f"k{i}") for i, c in enumerate(at)])
        u, v = F.col("fx") * F.col("k0") / F.col("k2") + F.col("cx"), F.col("fy") * F.col("k1") / F.col("k2") + F.col("cy")
        rows = computed(rows, *keep, "valid", "s", F.when(F.col("k2") > 0, u).otherwise(F.col("u")).alias("u"), F.when(F.col("k2") > 0, v).otherwise(F.col("v")).alias("v"))
    return rows.select("camera_id", "point_id", F.col("u").alias("x"), F.col("v").alias("y"), F.col("s").alias("time"), "valid")
