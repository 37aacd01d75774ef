"""Scene tables derived from the stored tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _e(i: int):
    return F.element_at("embedding", i).cast("double")


def gaussians(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives: centre, scale, unit quaternion, opacity, colour and component."""
    size = F.sqrt((1 + F.col("e4")) * (1 + F.col("e4")) + F.col("e5") * F.col("e5") + F.col("e6") * F.col("e6") + F.col("e7") * F.col("e7"))
    out = table(spark, folder, "embeddings").select(F.col("vec_id").alias("gaussian_id"), F.col("label").alias("component_id"), *[_e(i).alias(f"e{i}") for i in range(1, 17)])
    return out.select(
        "gaussian_id",
        "component_id",
        (6 * F.col("e1")).alias("mx"),
        (6 * F.col("e2")).alias("my"),
        (4 + 4 * F.col("e3")).alias("mz"),
        ((1 + F.col("e4")) / size).alias("qw"),
        (F.col("e5") / size).alias("qx"),
        (F.col("e6") / size).alias("qy"),
        (F.col("e7") / size).alias("qz"),
        *[F.exp(-2.5 + 2 * F.col(f"e{8 + k}")).alias(f"s{a}") for k, a in enumerate("xyz")],
        (1 / (1 + F.exp(-8 * F.col("e11")))).alias("opacity"),
        *[(0.5 + F.col(f"e{12 + k}")).alias(f"c{k}") for k in range(3)],
        *[F.col(f"e{i}") for i in range(1, 17)],
    )


def cameras(spark: SparkSession, folder: str) -> DataFrame:
    """One camera for each nation, turned about the y axis; world-to-camera rows r.. and shift t."""
    yaw = (F.col("n_nationkey") - 12) * F.lit(0.02)
    zero, one = F.lit(0.0), F.lit(1.0)
    view = {"r00": F.cos(yaw), "r01": zero, "r02": F.sin(yaw), "r10": zero, "r11": one, "r12": zero, "r20": -F.sin(yaw), "r21": zero, "r22": F.cos(yaw), "t0": zero, "t1": zero, "t2": zero}
    lens = {"fx": F.lit(60.0), "fy": F.lit(60.0), "cx": F.lit(32.0), "cy": F.lit(24.0), "width": F.lit(64), "height": F.lit(48)}
    return table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("camera_id"), *[c.alias(n) for n, c in (view | lens).items()])


def pixel_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct pixels asked for, of the camera that the order's customer falls to."""
    return table(spark, folder, "orders").select(
        F.pmod(F.col("o_custkey"), F.lit(25)).cast("int").alias("camera_id"), F.pmod(F.col("o_orderkey"), F.lit(48)).cast("int").alias("y"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(64)).cast("int").alias("x")
    ).distinct()


def pose_keys(spark: SparkSession, folder: str, kind: str = "view") -> DataFrame:
    """Timed poses: one track for each user, from events of one kind."""
    events = table(spark, folder, "events").where(F.col("event_type") == kind)
    angle = F.col("value").cast("double") / 50
    return events.select(
        F.col("user_id").alias("track_id"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("t_us"),
        F.col("event_id").alias("key_id"),
        (F.col("value").cast("double") / 10).alias("tx"),
        (F.col("value").cast("double") / 20 - 1).alias("ty"),
        F.lit(0.5).alias("tz"),
        F.cos(angle / 2).alias("qw"),
        F.lit(0.0).alias("qx"),
        F.lit(0.0).alias("qy"),
        F.sin(angle / 2).alias("qz"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return points_of(table(spark, folder, "lineitem"))


def points_of(lines: DataFrame, *keep: str) -> DataFrame:
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("point_id"),
        (F.col("l_quantity").cast("double") / 10).alias("x"),
        (F.col("l_discount").cast("double") * 50).alias("y"),
        (F.col("l_extendedprice").cast("double") / 20000).alias("z"),
        *keep,
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("long").alias("box_id"),
        (F.col("p_size").cast("double") / 10).alias("bx"),
        F.pmod(F.col("p_partkey"), F.lit(6)).cast("double").alias("by"),
        (F.col("p_retailprice").cast("double") / 500).alias("bz"),
        F.lit(0.15).alias("half"),
    )


#: The same views in DuckDB, as the first part of a WITH clause.
GAUSSIANS = """
e as (select vec_id as gaussian_id, label as component_id, """ + ", ".join(f"embedding[{i}]::double as e{i}" for i in range(1, 17)) + """ from embeddings),
gaussians as (select *, 6 * e1 as mx, 6 * e2 as my, 4 + 4 * e3 as mz, (1 + e4) / n as qw, e5 / n as qx, e6 / n as qy, e7 / n as qz,
  exp(-2.5::double + 2 * e8) as sx, exp(-2.5::double + 2 * e9) as sy, exp(-2.5::double + 2 * e10) as sz, 1 / (1 + exp(-8 * e11)) as opacity,
  0.5::double + e12 as c0, 0.5::double + e13 as c1, 0.5::double + e14 as c2
  from (select *, sqrt((1 + e4) * (1 + e4) + e5 * e5 + e6 * e6 + e7 * e7) as n from e))"""
CAMERAS = """
cameras as (select n_nationkey::int as camera_id, cos(a) as r00, 0::double as r01, sin(a) as r02, 0::double as r10, 1::double as r11, 0::double as r12,
  -sin(a) as r20, 0::double as r21, cos(a) as r22, 60::double as fx, 60::double as fy, 32::double as cx, 24::double as cy, 64 as width, 48 as height
  from (select n_nationkey, (n_nationkey - 12) * 0.02::double as a from nation))"""
