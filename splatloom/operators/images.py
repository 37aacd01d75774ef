"""Operators on images as tables of pixels (camera_id, x, y, channels)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian_window(size: int = 11, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [r / sum(raw) for r in raw]


def _blurred(rows: DataFrame, names: list[str], along: str, across: str, weights: list[float]) -> DataFrame:
    """Weighted sums over the window that starts at each row; null where it would pass the image's edge."""
    order = Window.partitionBy("camera_id", across).orderBy(along)
    total = lambda c: sum((w * F.lead(c, k).over(order) for k, w in enumerate(weights[1:], 1)), weights[0] * F.col(c))
    return rows.select("camera_id", "x", "y", *[total(c).alias(c) for c in names])


def ssim_map(image: DataFrame, a: str, b: str, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """(camera_id, x, y, ssim) for every window that lies in the image, named by its first pixel.

    The window is separable: one pass of ordered windows along the rows, one along the columns.
    """
    weights = gaussian_window(size, sigma)
    p, t = F.col(a), F.col(b)
    rows = image.select("camera_id", "x", "y", p.alias("ma"), t.alias("mb"), (p * p).alias("aa"), (t * t).alias("bb"), (p * t).alias("ab"))
    names = ["ma", "mb", "aa", "bb", "ab"]
    rows = _blurred(rows, names, "x", "y", weights).where("ma is not null")
    rows = _blurred(rows, names, "y", "x", weights).where("ma is not null")
    ma, mb = F.col("ma"), F.col("mb")
    c1, c2 = 0.01**2, 0.03**2
    value = ((2 * ma * mb + c1) * (2 * (F.col("ab") - ma * mb) + c2)) / ((ma * ma + mb * mb + c1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2))
    return rows.select("camera_id", "x", "y", value.alias("ssim"))


def total_variation(image: DataFrame, channel: str) -> DataFrame:
    """(camera_id, tv): mean squared difference of neighbours along rows plus along columns."""
    right = F.lead(channel).over(Window.partitionBy("camera_id", "y").orderBy("x")) - F.col(channel)
    down = F.lead(channel).over(Window.partitionBy("camera_id", "x").orderBy("y")) - F.col(channel)
    rows = image.select("camera_id", right.alias("r"), down.alias("d"))
    return rows.groupBy("camera_id").agg((F.avg(F.col("r") * F.col("r")) + F.avg(F.col("d") * F.col("d"))).alias("tv"))


def depth_points(image: DataFrame, cameras: DataFrame, depth: str = "depth") -> DataFrame:
    """(camera_id, x, y, px, py, pz): camera-space points of pixel centres at their depth."""
    rows = image.join(cameras, "camera_id")
    d = F.col(depth)
    return rows.select("camera_id", "x", "y", ((F.col("x") + 0.5 - F.col("cx")) / F.col("fx") * d).alias("px"), ((F.col("y") + 0.5 - F.col("cy")) / F.col("fy") * d).alias("py"), d.alias("pz"))


def normals(points: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: the normalised cross product of central differences, 0 at the border."""
    across, along = Window.partitionBy("camera_id", "y").orderBy("x"), Window.partitionBy("camera_id", "x").orderBy("y")
    gap = lambda c, w: (F.lead(c).over(w) - F.lag(c).over(w))
    rows = points.select("*", *[gap(f"p{a}", across).alias(f"u{a}") for a in "xyz"], *[gap(f"p{a}", along).alias(f"v{a}") for a in "xyz"])
    u, v = {a: F.col(f"u{a}") for a in "xyz"}, {a: F.col(f"v{a}") for a in "xyz"}
    rows = rows.select(*points.columns, (u["y"] * v["z"] - u["z"] * v["y"]).alias("kx"), (u["z"] * v["x"] - u["x"] * v["z"]).alias("ky"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("kz"))
    size = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz"))
    unit: Column = F.when(size > 1e-12, 1 / size).otherwise(F.lit(0.0))
    rows = rows.withColumn("unit", unit)
    return rows.select(*points.columns, *[F.coalesce(F.col(f"k{a}") * F.col("unit"), F.lit(0.0)).alias(f"n{a}") for a in "xyz"])


def affine_correction(image: DataFrame, channel: str, reference: str) -> DataFrame:
    """``image`` with ``corrected``: the affine map of ``reference`` onto ``channel`` by least squares, undone and clipped to [0, 1].

    A constant reference has a variance of 1e-8, and a slope next to 0 counts as 1.
    """
    c, r = F.col(channel), F.col(reference)
    fit = image.groupBy("camera_id").agg(F.avg(c).alias("_c"), F.avg(r).alias("_r"), F.avg(c * r).alias("_cr"), F.avg(r * r).alias("_rr"))
    slope = (F.col("_cr") - F.col("_r") * F.col("_c")) / F.greatest(F.col("_rr") - F.col("_r") * F.col("_r"), F.lit(1e-8))
    fit = fit.select("camera_id", slope.alias("_a"), (F.col("_c") - slope * F.col("_r")).alias("_b"))
    rows = image.join(fit, "camera_id")
    a = F.when(F.abs("_a") < 1e-8, F.lit(1.0)).otherwise(F.col("_a"))
    return rows.withColumn("corrected", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.col("_b")) / a))).drop("_a", "_b")


def temporal_variation(frames: DataFrame, channel: str, frame: str = "frame", mask: str | None = None) -> DataFrame:
    """(frame, tv): mean squared difference of each frame from the one before it, times the frame's ``mask``; one row fewer than frames."""
    before = F.lag(channel).over(Window.partitionBy("x", "y").orderBy(frame))
    rows = frames.select(F.col(frame).alias("frame"), (F.col(channel) - before).alias("d"), *([F.col(mask).alias("mask")] if mask else [F.lit(1.0).alias("mask")]))
    return rows.where("d is not null").groupBy("frame").agg((F.avg(F.col("d") * F.col("d")) * F.first("mask")).alias("tv"))


def masked_ssim(image: DataFrame, a: str, b: str, mask: Column, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """``ssim_map`` of the two channels after both are set to 0 outside the mask."""
    rows = image.select("camera_id", "x", "y", *[(F.col(c) * mask.cast("double")).alias(c) for c in (a, b)])
    return ssim_map(rows, a, b, size, sigma)
