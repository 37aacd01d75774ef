"""Two-level compositing: segments of depth first, then the segments of each pixel; resumable by range.

Compositing is an ordered monoid: a run of pairs is known by the transmittance through it and by its weighted
sums, and two runs combine to (T1 T2, S1 + T1 S2).  Primitives are numbered by depth once for each camera, by a
range sort, and SIZE of them share a segment.

``looks`` goes through the depths of each camera in stretches of segments, each GROWTH times as long as all before it.  It
sums the logarithms of each pixel's transmittance, so it is known what stands before each stretch of a pixel, and where a
pixel is saturated, later stretches make no pair for it.  Primitives are dealt out by tile and stretch, and pairs are made
and ordered where their primitives are: no pair is shuffled.  An image adds up what the stretches of each pixel give.

A state after a range of segments holds what a later range needs to go on.  With limits, stretches end where ranges end, and a
range adds its stretches up.  Without limits, tiles that are saturated everywhere are dropped before their pixels are made;
a group of (pixel, segment) has at most SIZE pairs, and only the segment in which a pixel saturates is looked at pair by pair again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatloom.sources.tables import written

from .composite import PIXEL, TILE, contributions, ordered, pairs, tiles
from .composite import composite as summed
from .project import TRANSMITTANCE_LEAST

#: Primitives of a camera in a segment; a power of two.
SIZE = 256
_LEAST = math.log(TRANSMITTANCE_LEAST)
#: Primitives of a camera in the first stretch of depth, and how the stretches grow.
FIRST, GROWTH = 1024, 4
#: Makes pairs from rows with a ``segment``, without those in the masked tiles (camera_id, tile_x, tile_y) or beyond the limits.
Spread = Callable[..., DataFrame]


def segmented(projected: DataFrame, size: int = SIZE) -> DataFrame:
    """``projected`` with ``segment``: grows with (depth, gaussian_id) in each camera; at most ``size`` rows share one.

    The rows are sorted by ranges, numbered in each task, and written: numbers stay what they are when a task is run again.
    """
    if size & (size - 1):
        raise ValueError(f"the size of a segment is a power of two, not {size}")
    order = ["camera_id", "_near", "gaussian_id"]
    rows = projected.withColumn("_near", F.col("depth").cast("float")).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = rows.withColumn("segment", F.shiftright(F.monotonically_increasing_id(), size.bit_length() - 1))
    return written(numbered.drop("_near"), "segments")


def by_box(rows: DataFrame, mask: DataFrame | None, limits: DataFrame | None = None) -> DataFrame:
    """The pairs of ``composite.pairs``."""
    return pairs(rows, mask=mask, limits=limits)


def _made(spread: Spread, rows: DataFrame, mask: DataFrame | None, near: DataFrame | None) -> DataFrame:
    return spread(rows, mask) if near is None else spread(rows, mask, near)


def stretched(rows: DataFrame, size: int = SIZE, first: int = FIRST) -> tuple[DataFrame, int]:
    """Segmented ``rows`` with ``stretch``, which grows with the segment from 0 on, and the largest one.

    Where rows have a ``range``, which grows with the depth, no stretch holds rows of two ranges.
    """
    key = [c for c in ("range", "segment") if c in rows.columns]
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy(*key)) - 1
    number = sum((place * size >= first * GROWTH**k).cast("int") for k in range(16))
    numbers = rows.select("camera_id", *key).distinct().select("camera_id", *key, number.alias("number"))
    starts = numbers.groupBy("camera_id", *key[:-1], "number").agg(F.min(F.struct(*key)).alias("start")).groupBy("camera_id").agg(F.sort_array(F.collect_list("start")).alias("_starts"))
    starts = written(starts, "stretches")
    most = starts.agg(F.max(F.size("_starts"))).first()[0]
    stretch = F.size(F.filter("_starts", lambda s: s <= F.struct(*key))) - 1
    return rows.join(starts, "camera_id").withColumn("stretch", stretch).drop("_starts"), (most or 1) - 1


def opened(grid: DataFrame, tile: int) -> DataFrame:
    """(camera_id, tile_x, tile_y, starts, befores): for each place of a tile 0 and 0 before any pair; ``starts`` are null outside the ``grid``."""
    place = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int")
    rows = grid.select("camera_id", *_tile(tile), place.alias("_k")).groupBy(*TILE).agg(F.collect_set("_k").alias("_asked"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda k: F.when(F.array_contains("_asked", k), F.lit(0.0)))
    return rows.select(*TILE, starts.alias("starts"), F.array_repeat(F.lit(0).cast("long"), tile * tile).alias("befores"))


def _behind(near: DataFrame, rows: DataFrame, tile: int) -> DataFrame:
    """The tiles of ``near`` behind the pairs ``rows`` of one stretch; places that are saturated become null, and tiles without others go."""
    place = ((F.col("y") - F.col("tile_y") * tile) * tile + F.col("x") - F.col("tile_x") * tile).cast("int")
    sums = rows.groupBy(*TILE, "stretch", place.alias("_k")).agg(F.sum(F.log1p(-F.col("alpha"))).alias("left"), F.count("*").alias("n"))
    met = sums.groupBy(*TILE, "stretch").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("left", "n")))).alias("_sums")).drop("stretch")
    added = lambda c, k: F.coalesce(F.try_element_at("_sums", k)[c], F.lit(0))
    both = near.join(met.hint("merge"), TILE, "left")
    both = both.select(*TILE, F.transform("starts", lambda s, k: s + added("left", k)).alias("starts"), F.transform("befores", lambda b, k: b + added("n", k)).alias("befores"))
    both = both.withColumn("starts", F.transform("starts", lambda s: F.when(s >= _LEAST - 1e-6, s)))
    return both.where(F.exists("starts", lambda s: s.isNotNull()))


def looks(rows: DataFrame, grid: DataFrame, size: int = SIZE, spread: Spread = by_box, mask: DataFrame | None = None, tile: int = 16, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """Segmented ``rows`` with ``stretch``, and the limits of the pixels of ``grid``: no pair outside them adds to its pixel.

    Limits (camera_id, tile_x, tile_y, stretch, starts, befores) have a row for each tile and each stretch that any of its
    pixels looks at: the logarithm of each pixel's transmittance before that stretch, null if it is below 1e-4, by a margin
    for the order of sums, and how many pairs stand before.
    """
    rows, most = stretched(rows, size, first)
    near = written(opened(grid, tile), "near")
    every = near.withColumn("stretch", F.lit(0))
    for k in range(most):
        found = spread(rows.where(F.col("stretch") == k), mask, near.withColumn("stretch", F.lit(k)))
        near = written(_behind(near, found, tile), "near")
        every = every.unionByName(near.withColumn("stretch", F.lit(k + 1)))
    return rows, every


def near_pairs(projected: DataFrame, grid: DataFrame, spread: Spread = by_box, mask: DataFrame | None = None, size: int = SIZE, first: int = FIRST) -> DataFrame:
    """The pairs on pixels of ``grid`` that ``composite.contributions`` may need: those behind a saturated pixel are not made."""
    size = min(size, first)
    rows, near = looks(segmented(projected, size), grid, size, spread, mask, first=first)
    return spread(rows, mask, near).drop("segment")


def blank(grid: DataFrame, channels: list[str]) -> DataFrame:
    """The state of each pixel of ``grid`` before any pair: n, alpha, channels, the logarithm ``left`` of its transmittance, done."""
    zero = [F.lit(0.0).alias(c) for c in ("alpha", *channels, "left")]
    return grid.select(*PIXEL, F.lit(0).cast("long").alias("n"), *zero, F.lit(False).alias("done"))


def _local(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Pairs with ``upto``, the logarithm of the transmittance from the begin of their segment through themselves."""
    dealt = [c for c in (*TILE[1:], "stretch") if c in rows.columns]
    kept = rows.select(*PIXEL, *dealt, "segment", F.col("depth").cast("float").alias("near"), "gaussian_id", "alpha", *channels)
    run = Window.partitionBy(*PIXEL, *dealt, "segment").orderBy("near", "gaussian_id").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("upto", F.sum(F.log1p(-F.col("alpha"))).over(run))


def _sums(rows: DataFrame, keys: list[str], channels: list[str], start: Column) -> DataFrame:
    weight = F.col("alpha") * F.exp(start + F.col("upto")) / (1 - F.col("alpha"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("upto").alias("upto"), F.sum(weight).alias("alpha"), *[F.sum(weight * F.col(c)).alias(c) for c in channels])


def _placed(parts: DataFrame, state: DataFrame) -> DataFrame:
    """Segments of pixels that are not done, with ``start``, the logarithm of the transmittance before them."""
    going = state.where("not done").select(*PIXEL, F.col("left").alias("_left"))
    before = Window.partitionBy(*PIXEL).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(going.hint("merge"), PIXEL).withColumn("start", F.col("_left") + F.coalesce(F.sum("upto").over(before), F.lit(0.0)))
    return rows.where(F.col("start") > _LEAST).drop("_left")


def _tile(tile: int) -> list[Column]:
    return [F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in "xy"]


def _closed(state: DataFrame, tile: int) -> DataFrame:
    """The tiles whose pixels are all done."""
    return state.groupBy("camera_id", *_tile(tile)).agg(F.min("done").alias("all")).where("all").drop("all")


def advance(state: DataFrame, rows: DataFrame, channels: list[str], spread: Spread = by_box, tile: int = 16, fresh: bool = False, near: DataFrame | None = None) -> DataFrame:
    """``state`` after the segments of ``rows``, which all stand behind those that it has seen.

    A pixel is done at the first pair that would take its transmittance to 1e-4 or less; neither that pair nor any
    behind it adds to it, in later ranges either.  ``fresh`` says that no pixel is done yet;
    ``near`` are the limits that ``looks`` found for the rows of all ranges, which tell the ranges apart by ``range``.
    As tables of pixels grow with the images, none is broadcast.
    """
    if near is None:
        added = _merged(state, rows, channels, spread, tile, fresh)
    elif fresh or "range" in rows.columns:
        added = _placed_before(spread(rows, None, near), channels)
    else:
        raise ValueError("rows of a later range need a range, so that no stretch of the limits holds rows of two")
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    joined = state.join(added.hint("merge"), PIXEL, "left")
    return joined.select(*PIXEL, more("n"), *[more(c) for c in ("alpha", *channels, "left")], (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done"))


def _placed_before(rows: DataFrame, channels: list[str]) -> DataFrame:
    """What pairs with limits add to each pixel: they know what stands before their stretch, so none is shuffled or made again."""
    counts = F.col("after") > TRANSMITTANCE_LEAST
    weight = F.when(counts, F.col("alpha") * F.col("after") / (1 - F.col("alpha"))).otherwise(0.0)
    found = ordered(rows).withColumns({"_counts": counts, "_weight": weight})
    sums = [F.sum("_weight").alias("_alpha"), *[F.sum(F.col("_weight") * F.col(c)).alias(f"_{c}") for c in channels]]
    left = F.sum(F.when(F.col("_counts"), F.log1p(-F.col("alpha"))).otherwise(0.0))
    return found.groupBy(*PIXEL).agg(F.count_if("_counts").alias("_n"), *sums, left.alias("_left"), F.max(~F.col("_counts")).alias("_done"))


def _merged(state: DataFrame, rows: DataFrame, channels: list[str], spread: Spread, tile: int, fresh: bool) -> DataFrame:
    """What the segments of ``rows`` add to each pixel: each segment by itself, then those before which the pixel is not done."""
    parts = _sums(_local(spread(rows, None if fresh else _closed(state, tile)), channels), [*PIXEL, "segment"], channels, F.lit(0.0))
    placed = written(_placed(parts, state), "placed")
    through = F.col("start") + F.col("upto")
    scale = F.exp("start")
    added = placed.where(through > _LEAST).select(*PIXEL, "n", "upto", *[(scale * F.col(c)).alias(c) for c in ("alpha", *channels)], F.lit(False).alias("done"))
    broken = placed.where(through <= _LEAST).select(*PIXEL, "segment", "start")
    if not broken.isEmpty():
        # Pixels that saturate need one of their segments pair by pair: only its rows, in tiles with such pixels.
        some = rows.join(broken.select("camera_id", "segment").distinct(), ["camera_id", "segment"], "left_semi")
        unbroken = state.select("camera_id", *_tile(tile)).distinct().join(broken.select("camera_id", *_tile(tile)).distinct(), ["camera_id", "tile_x", "tile_y"], "left_anti")
        cut = _local(spread(some, unbroken), channels).join(broken.hint("merge"), [*PIXEL, "segment"]).where(through > _LEAST)
        added = added.unionByName(_sums(cut, PIXEL, channels, F.col("start")).withColumn("done", F.lit(True)))
    ends = broken.select(*PIXEL, F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("upto", "alpha", *channels)], F.lit(True).alias("done"))
    return added.unionByName(ends).groupBy(*PIXEL).agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "alpha", *channels)], F.sum("upto").alias("_left"), F.max("done").alias("_done"))


def image(state: DataFrame, channels: list[str], background: list[float] | None = None) -> DataFrame:
    """(camera_id, x, y, n, alpha, channels...) of a state, over ``background``."""
    back = background or [0.0] * len(channels)
    return state.select(*PIXEL, "n", "alpha", *[(F.col(c) + (1 - F.col("alpha")) * b).alias(c) for c, b in zip(channels, back, strict=True)])


def composite(projected: DataFrame, grid: DataFrame, channels: list[str], background: list[float] | None = None, size: int = SIZE, spread: Spread = by_box, first: int = FIRST) -> DataFrame:
    """``composite.composite`` of all contributions: each stretch of a pixel by itself, then the stretches of each pixel."""
    return summed(contributions(near_pairs(projected, grid, spread, size=size, first=first)), grid, channels, background)


def composite_by_ranges(projected: DataFrame, grid: DataFrame, channels: list[str], ranges: int, size: int = SIZE, spread: Spread = by_box, tile: int = 16, deep: bool = False) -> DataFrame:
    """The state after all segments, range by range from near to far, each written; tiles that are done are left out of later ranges.

    A camera's range is an equal share of its segments.  ``deep`` asks ``looks`` first, with a spread that takes limits.
    """
    rows, near = segmented(projected, size), None
    share = rows.select("camera_id", "segment").distinct().select("*", F.ntile(ranges).over(Window.partitionBy("camera_id").orderBy("segment")).alias("range"))
    starts = share.groupBy("camera_id", "range").agg(F.min("segment").alias("start")).groupBy("camera_id").agg(F.collect_list("start").alias("_starts"))
    dealt = rows.join(starts, "camera_id").withColumn("range", F.size(F.filter("_starts", lambda s: s <= F.col("segment")))).drop("_starts")
    if deep:
        dealt, near = looks(dealt, grid, size, spread, tile=tile)
    state = blank(grid, channels)
    for k in range(1, ranges + 1):
        state = written(advance(state, dealt.where(F.col("range") == k), channels, spread, tile, fresh=k == 1, near=near), "state")
    return state


def tile_places(rows: DataFrame, tile: int = 16) -> DataFrame:
    """The tiles of segmented rows with ``place``, from 0 on: where a primitive stands in its tile's list from near to far.

    Places go within a segment first; a tile's second level has one row for each of its segments.
    """
    key = ["camera_id", "tile_x", "tile_y"]
    met = tiles(rows, tile)
    counts = met.groupBy(*key, "segment").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*key, "segment").orderBy(F.col("depth").cast("float"), "gaussian_id"))
    return met.withColumn("_own", own).join(counts.select(*key, "segment", base.alias("_base")), [*key, "segment"]).withColumn("place", F.col("_base") + F.col("_own") - 1).drop("_own", "_base")


def pairs_in_range(state: DataFrame, rows: DataFrame, channels: list[str] = (), spread: Spread = by_box, tile: int = 16, near: DataFrame | None = None) -> DataFrame:
    """(camera_id, x, y, gaussian_id, weight): the pairs of ``rows`` that add to pixels of ``state``, which has seen all before them."""
    local = _local(_made(spread, rows, _closed(state, tile), near), list(channels))
    placed = _placed(_sums(local, [*PIXEL, "segment"], [], F.lit(0.0)), state)
    found = local.join(placed.select(*PIXEL, "segment", "start").hint("merge"), [*PIXEL, "segment"])
    after = F.col("start") + F.col("upto")
    return found.where(after > _LEAST).select(*PIXEL, "gaussian_id", (F.col("alpha") * F.exp(after) / (1 - F.col("alpha"))).alias("weight"), *channels)
