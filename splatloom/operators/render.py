"""One entry to rendering: projection, colours from harmonics, compositing, and depths, by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatloom.functions import harmonics
from splatloom.functions import rotation as R

from . import composite as C
from .project import computed, project
from .segments import near_pairs
from .unscented import project_unscented

#: What each mode shows.  D is depth, d the distance to the camera; E divides by the alpha.
MODES = ("RGB", "D", "ED", "d", "Ed", "RGB+D", "RGB+ED", "RGB-d", "RGB-Ed")


def camera_centres(cameras: DataFrame) -> DataFrame:
    """``cameras`` with their centres in the world (ox, oy, oz)."""
    turn = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    centre = R.apply(R.transposed(turn), R.columns("t0", "t1", "t2"))
    return cameras.select("*", *[(-c).alias(n) for n, c in zip(("ox", "oy", "oz"), centre, strict=True)])


def view_colours(projected: DataFrame, coefficients: list[list[str]], degree: int, channels: list[str]) -> DataFrame:
    """``projected`` with each channel's harmonics towards (ux, uy, uz), plus 0.5 and not below 0."""
    direction = R.columns("ux", "uy", "uz")
    made = {c: F.greatest(F.lit(0.0), harmonics.evaluate(degree, direction, [F.col(k) for k in own[: (degree + 1) ** 2]]) + 0.5) for c, own in zip(channels, coefficients, strict=True)}
    drop = {k for own in coefficients for k in own} - set(channels)
    return projected.select(*[c for c in projected.columns if c not in made and c not in drop], *[c.alias(n) for n, c in made.items()])


def rasterize(
    gaussians: DataFrame,
    cameras: DataFrame,
    mode: str = "RGB",
    channels: tuple[str, ...] = ("c0", "c1", "c2"),
    coefficients: list[list[str]] | None = None,
    degree: int = 0,
    background: list[float] | None = None,
    requests: DataFrame | None = None,
    mask: DataFrame | None = None,
    unscented: bool = False,
    **options,
) -> DataFrame:
    """(camera_id, x, y, n, alpha, channels..., depth) for every pixel, or for the requested ones.

    ``mode`` is one of ``MODES``.  With ``coefficients`` (a list of column names for each channel)
    colours are harmonics of ``degree`` in the direction of view; else the channels are columns of
    the primitives.  The background is for the colours alone.  ``options`` go to ``project`` or, with
    ``unscented``, to ``project_unscented``, which knows distorted, fisheye and F-Theta lenses.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    coloured, channels = mode.startswith("RGB"), list(channels)
    deep = mode.removeprefix("RGB").lstrip("+-")
    world = ["wx", "wy", "wz"]
    away = bool(coefficients and coloured) or deep.endswith("d")
    wanted = [k for own in coefficients for k in own] if coefficients and coloured else channels if coloured else []
    scene = gaussians.select("gaussian_id", "mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity", *dict.fromkeys(wanted), *([F.col(m).alias(w) for m, w in zip(("mx", "my", "mz"), world, strict=True)] if away else []))
    seen = (project_unscented if unscented else project)(scene, cameras, **options)
    if away:
        seen = seen.join(camera_centres(cameras).select("camera_id", "ox", "oy", "oz"), "camera_id")
        gap = tuple(F.col(w) - F.col(o) for w, o in zip(world, ("ox", "oy", "oz"), strict=True))
        kept = [c for c in seen.columns if c not in (*world, "ox", "oy", "oz")]
        seen = computed(seen, *kept, *[g.alias(w) for g, w in zip(gap, world, strict=True)])
        seen = computed(seen, *kept, *world, R.norm(R.columns(*world)).alias("distance"))
        seen = seen.select(*kept, "distance", *[(F.col(w) / F.col("distance")).alias(u) for w, u in zip(world, ("ux", "uy", "uz"), strict=True)])
    if coefficients and coloured:
        seen = view_colours(seen, coefficients, degree, channels)
    seen = seen.drop("ux", "uy", "uz")
    shown = channels if coloured else []
    measure = {"D": "depth", "ED": "depth", "d": "distance", "Ed": "distance"}.get(deep)
    grid = requests.select(*C.PIXEL).distinct() if requests is not None else C.pixels(cameras)
    weighted = C.contributions(near_pairs(seen, grid, mask=mask))
    if measure:
        weighted = weighted.withColumn("shown_depth", F.col(measure))
    back = [*(background or [0.0] * len(shown)), 0.0] if measure else background
    out = C.composite(weighted, grid, [*shown, *(["shown_depth"] if measure else [])], back if shown else None)
    if not measure:
        return out
    depth = F.col("shown_depth") / F.greatest("alpha", F.lit(1e-10)) if deep.startswith("E") else F.col("shown_depth")
    return out.withColumn("depth", depth).drop("shown_depth")
