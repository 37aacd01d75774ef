"""The first box that holds each point, whatever the boxes' sizes, their turns and how many overlap.

Only cells of a fine grid that have points count, and of their boxes only those up to the first that covers the whole cell,
since that one holds every point that is left.  Boxes come in blocks of rising ids.  Each starts in the cells of its own size
and goes on to smaller ones where no earlier box settles all points; so of many boxes upon each other few get to the fine cells.
Each fine cell has a list of the boxes left, and a point meets its own cell's list.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.functions import rotation as R
from splatloom.sources.tables import written

from .project import computed, spread_out

_AXES = "xyz"
_CELL = ["gx", "gy", "gz"]
#: Steps from the median box's own cells to the fine ones; each makes cells four times smaller.
FINER = 2
#: Boxes of the first block, and how much larger each next block is.
FIRST, GROWTH = 32_768, 64
#: Boxes in one list.
LISTED = 4096


def _prepared(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, centre, half sizes and turn of the boxes that can hold something, half their bounds ex..z and the level of their own
    cells, of size 4^level: the smallest that are as large as the bounds.  Boxes without qw..z are upright and get no turn."""
    rest = [*keys, "box_id", "bx", "by", "bz", "hx", "hy", "hz"]
    turned = "qw" in boxes.columns
    if turned:
        turn = R.rotation(R.normalised(R.columns("qw", "qx", "qy", "qz")))
        rest += [turn[i][j].alias(f"g{i}{j}") for i in range(3) for j in range(3)]
    rows = computed(boxes, *rest).where("hx >= 0 and hy >= 0 and hz >= 0")
    half = R.columns("hx", "hy", "hz")
    # A little more than the bounds, for what rounding takes away.
    reach = [R.dot(tuple(F.abs(f"g{i}{j}") for j in range(3)), half) if turned else half[i] for i in range(3)]
    rows = computed(rows, *rows.columns, *[(e * (1 + 1e-9) + 1e-12).alias(f"e{n}") for n, e in zip(_AXES, reach, strict=True)])
    return computed(rows, *rows.columns, F.ceil(F.log2(2 * F.greatest("ex", "ey", "ez")) / 2).cast("int").alias("level"))


def _local(at: tuple[Column, ...], box, turned: bool) -> tuple[Column, ...]:
    """``at`` in the axes of the box whose column c is ``box(c)``."""
    away = tuple(a - box(f"b{n}") for a, n in zip(at, _AXES, strict=True))
    return tuple(R.dot(tuple(box(f"g{i}{j}") for i in range(3)), away) for j in range(3)) if turned else away


def _spread(rows: DataFrame, size: float, within: bool) -> DataFrame:
    """A row for each cell of ``size`` that the bounds of a box meet; ``within``: of the cells that its row's cell, four times as large, has."""
    for n in _AXES:
        low, high = (F.floor((F.col(f"b{n}") + sign * F.col(f"e{n}")) / size) for sign in (-1, 1))
        if within:
            low, high = F.greatest(low, F.col(f"g{n}") * 4), F.least(high, F.col(f"g{n}") * 4 + 3)
        rows = rows.select(*[c for c in rows.columns if c != f"g{n}"], F.explode(F.sequence(low, high)).alias(f"g{n}"))
    return rows


def _left(rows: DataFrame, cells: DataFrame, keys: list[str], size: float, turned: bool) -> DataFrame:
    """``rows`` of cells with points that no earlier box settles and that the box meets, and whether it covers the cell."""
    names = rows.columns
    rows = rows.join(cells, [*keys, *_CELL]).where("settled is null or box_id <= settled").select(*names)
    middle = tuple((F.col(f"g{n}") + 0.5) * size for n in _AXES)
    local = _local(middle, F.col, turned)
    span = [size / 2 * (F.abs(f"g0{j}") + F.abs(f"g1{j}") + F.abs(f"g2{j}")) if turned else F.lit(size / 2) for j in range(3)]
    far = reduce(lambda a, b: a + b, [F.abs(m) + F.abs(f"b{n}") for m, n in zip(middle, _AXES, strict=True)])
    rows = computed(rows, *names, *[c.alias(f"_l{j}") for j, c in enumerate(local)], *[c.alias(f"_s{j}") for j, c in enumerate(span)], far.alias("_far"))
    slack = [1e-12 * F.col("_far") + 1e-9 * (F.col(f"h{n}") + size) for n in _AXES]
    meets = [F.abs(f"_l{j}") <= F.col(f"h{n}") + F.col(f"_s{j}") + slack[j] for j, n in enumerate(_AXES)]
    covers = [F.abs(f"_l{j}") + F.col(f"_s{j}") + slack[j] <= F.col(f"h{n}") for j, n in enumerate(_AXES)]
    return rows.where(meets[0] & meets[1] & meets[2]).select(*names, (covers[0] & covers[1] & covers[2]).alias("covers"))


def _levels(fine: DataFrame, keys: list[str], finest: int, top: int) -> dict[int, DataFrame]:
    """For each level the cells (keys, gx..z) with points, and ``settled``: the id beyond which no box matters to any point in them."""
    found = {finest: fine}
    for level in range(finest + 1, top + 1):
        under = found[level - 1].select(*keys, *[F.shiftright(c, 2).alias(c) for c in _CELL], "settled")
        found[level] = written(under.groupBy(*keys, *_CELL).agg(F.when(F.count("settled") == F.count("*"), F.max("settled")).alias("settled")), "cells")
    return found


def listed(points: DataFrame, boxes: DataFrame, keys: list[str]) -> tuple[DataFrame, float, bool] | None:
    """(lists, size, several): for each cell of ``size`` lists (keys, gx..z, part, boxes), by rising ids, of the boxes that can be the
    first to hold a point in it, and whether a cell has more than one; None where there is no box."""
    turned = "qw" in boxes.columns
    boxes = written(_prepared(spread_out(boxes), keys), "boxes")
    ends = F.max(F.greatest(*[F.abs(f"b{n}") + F.col(f"e{n}") for n in _AXES]))
    total, middle, known, far = boxes.agg(F.count("*"), F.percentile_approx("level", 0.5), F.collect_set("level"), ends).first()
    if not total:
        return None
    # Numbers of cells keep all their digits.
    finest = max(middle - FINER, math.ceil(math.log(max(far, 1e-300) / 2**50, 4)))
    known = {max(level, finest) for level in known}
    top = max(known)
    size = lambda level: 4.0**level
    shares, block = [], FIRST
    while block < total:
        shares.append(block / total)
        block *= GROWTH
    ends = boxes.agg(F.percentile_approx("box_id", shares, 100_000)).first()[0] if shares else []
    # Points beyond all boxes are in no cell.
    near = reduce(lambda a, b: a & b, [F.abs(n) <= far for n in _AXES])
    fine = points.where(near).select(*keys, *[F.floor(F.col(n) / size(finest)).alias(f"g{n}") for n in _AXES]).distinct()
    fine = written(fine.withColumn("settled", F.lit(None).cast(boxes.schema["box_id"].dataType)), "cells")
    found = []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        own = boxes if low is None else boxes.where(F.col("box_id") > low)
        own = own if high is None else own.where(F.col("box_id") <= high)
        cells, rows = _levels(fine, keys, finest, top), None
        for level in range(top, finest - 1, -1):
            rows = rows if rows is None else _spread(rows.drop("covers"), size(level), True)
            if level in known:
                start = _spread(own.where(F.greatest("level", F.lit(finest)) == level), size(level), False)
                rows = start if rows is None else rows.unionByName(start)
            rows = _left(rows, cells[level], keys, size(level), turned)
        found.append(written(rows.drop("level"), "met"))
        first = found[-1].where("covers").groupBy(*keys, *_CELL).agg(F.min("box_id").alias("_own"))
        fine = written(fine.join(first, [*keys, *_CELL], "left").select(*keys, *_CELL, F.least("settled", "_own").alias("settled")), "cells")
    rows = reduce(DataFrame.unionByName, found)
    box = F.struct("box_id", *[c for c in rows.columns if c not in (*keys, *_CELL, "box_id", "covers")])
    rows = rows.join(fine, [*keys, *_CELL]).where("settled is null or box_id <= settled").select(*keys, *_CELL, "box_id", box.alias("box"))
    rows = rows.withColumn("part", F.expr(f"row_number() over (partition by {', '.join([*keys, *_CELL])} order by box_id) div {LISTED}"))
    lists = written(rows.groupBy(*keys, *_CELL, "part").agg(F.sort_array(F.collect_list("box")).alias("boxes")), "lists")
    return lists, size(finest), bool(lists.agg(F.max("part")).first()[0])


def first_of(points: DataFrame, boxes: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """(keys, point_id, x, y, z, box): the box of smallest id, a number, that holds each point, as (box_id, lx, ly, lz) with the point in
    the box's own axes; null where none does.  ``distinct``: each (keys, point_id, x, y, z) counts once.
    """
    names, turned = [*keys, "point_id", *_AXES], "qw" in boxes.columns
    box = f"struct<box_id:{boxes.schema['box_id'].dataType.simpleString()},lx:double,ly:double,lz:double>"
    got = listed(points, boxes, keys)
    if got is None:
        rows = points.select(*names)
        return (rows.distinct() if distinct else rows).withColumn("box", F.lit(None).cast(box))
    lists, size, several = got
    rows = points.select(*names, *([F.monotonically_increasing_id().alias("_row")] if several and not distinct else []), *[F.floor(F.col(n) / size).alias(f"g{n}") for n in _AXES])
    once = rows.columns
    # Lists are a table of any size: nothing to broadcast.  Rows stay where their cell is, so what is grouped is not shuffled again.
    met = rows.join(lists.hint("merge"), [*keys, *_CELL], "left")

    def holds(b: Column) -> Column:
        held = [F.abs(c) <= b[f"h{n}"] for c, n in zip(_local(R.columns(*_AXES), lambda c: b[c], turned), _AXES, strict=True)]
        # The bounds first: they cost less than the turn, and most boxes end there.
        bounds = [F.abs(F.col(n) - b[f"b{n}"]) <= b[f"e{n}"] for n in _AXES] if turned else []
        return reduce(lambda a, b: a & b, [*bounds[::-1], *held])

    met = met.select(*once, F.get(F.filter("boxes", holds), F.lit(0)).alias("_held"))
    local = _local(R.columns(*_AXES), lambda c: F.col(f"_held.{c}"), turned)
    met = met.select(*once, F.when(F.col("_held").isNotNull(), F.struct(F.col("_held.box_id").alias("box_id"), *[c.alias(f"l{n}") for c, n in zip(local, _AXES, strict=True)])).cast(box).alias("box"))
    if several:
        met = met.groupBy(*once).agg(F.min("box").alias("box"))
    elif distinct:
        met = met.groupBy(*once).agg(F.first("box.box_id").alias("box_id"), *[F.first(f"box.l{n}").alias(f"l{n}") for n in _AXES])
        met = met.select(*once, F.when(F.col("box_id").isNotNull(), F.struct("box_id", "lx", "ly", "lz")).alias("box"))
    return met.select(*names, "box")


def first_posed_box(points: DataFrame, boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, point_id, x, y, z, box_id, lx, ly, lz): the box of smallest id that holds each point in its frame, and the point
    in that box's own axes; nulls where none does.  Faces are inside.

    A box has a centre bx..z, half sizes hx..z and a quaternion qw..z, of any length, from its own axes to the world's.
    Each row of ``points`` (frame, point_id, x, y, z) gives a row; ids need not differ.  Boxes with a null or negative size hold nothing.
    """
    return first_of(points, boxes, [frame]).select(frame, "point_id", *_AXES, "box.box_id", "box.lx", "box.ly", "box.lz")
