"""Feature fields over (x, y, z, t): products of bilinear samples of sparse planes, and their regularisers.

A plane is a table of cells (scale, plane, i, j, values): ``plane`` counts the pairs of axes of
``PAIRS``, ``i`` runs along the first axis of the pair and ``j`` along the second.  Cells that are
not in the table hold 1 in planes with time, else the ``rest`` value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "t")
PAIRS = list(combinations(range(len(AXES)), 2))
#: Cells along each side of a block; a block also has the first cells of the next ones.
BLOCK = 8
#: Values of all planes that every task holds as a whole; larger planes are looked up by blocks.
HELD = 2**20


def resolutions(base: Sequence[int], scales: Sequence[int] = (1, 2)) -> list[tuple[int, ...]]:
    """Cells along each axis for each scale: space gets finer, time does not."""
    return [(*[n * k for n in base[:3]], base[3]) for k in scales]


def _rest(plane: Column, rest: float) -> Column:
    timed = [p for p, pair in enumerate(PAIRS) if 3 in pair]
    return F.when(plane.isin(timed), 1.0).otherwise(float(rest))


def blocks(cells: DataFrame, features: int, rest: float) -> DataFrame:
    """(scale, plane, bi, bj, grid): blocks that have a cell, each an array of (BLOCK + 1)^2 value arrays."""
    home = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    # A cell on the first line of a block closes the block before, too.
    also = lambda c: F.when(F.col(c) % BLOCK == 0, F.array(home(c), home(c) - 1)).otherwise(F.array(home(c)))
    rows = cells.select("*", F.explode(also("i")).alias("bi")).select("*", F.explode(also("j")).alias("bj")).where("bi >= 0 and bj >= 0")
    place = (F.col("i") - F.col("bi") * BLOCK) * (BLOCK + 1) + F.col("j") - F.col("bj") * BLOCK
    keys = ["scale", "plane", "bi", "bj"]
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col("values").alias("v")))).alias("held"))
    empty = F.array_repeat(_rest(F.col("plane"), rest), features)
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit((BLOCK + 1) ** 2 - 1)), lambda k: F.coalesce(F.try_element_at("held", k), empty)).alias("grid"))


def _whole(cells: DataFrame, sizes: Sequence[Sequence[int]], features: int, rest: float) -> list[list[np.ndarray]]:
    """For each scale and plane the values of all its cells, a row for each."""
    made = [[np.full((size[a], size[b], features), 1.0 if b == 3 else rest) for a, b in PAIRS] for size in sizes]
    inside = F.lit(False)
    for s, size in enumerate(sizes):
        for p, (a, b) in enumerate(PAIRS):
            inside = inside | ((F.col("scale") == s) & (F.col("plane") == p) & F.col("i").between(0, size[a] - 1) & F.col("j").between(0, size[b] - 1))
    known = cells.where(inside).select(*[F.col(c).cast("long") for c in ("scale", "plane", "i", "j")], *[F.element_at("values", n + 1).cast("double").alias(f"v{n}") for n in range(features)]).toArrow()
    scale, plane, i, j, *values = (known.column(c).to_numpy() for c in known.column_names)
    values = np.stack(values, 1)
    for s, planes in enumerate(made):
        for p, grid in enumerate(planes):
            own = (scale == s) & (plane == p)
            grid[i[own], j[own]] = values[own]
    return [[grid.reshape(-1, features) for grid in planes] for planes in made]


def _sampled(planes: list[list[np.ndarray]], sizes: Sequence[Sequence[int]], features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [batch.column(a).to_numpy() for a in AXES]
            made = np.ones((batch.num_rows, len(sizes), features))
            for s, size in enumerate(sizes):
                at = [u * (n - 1) for u, n in zip(unit, size, strict=True)]
                low = [np.minimum(np.floor(c), n - 2).astype(np.int64) for c, n in zip(at, size, strict=True)]
                part = [(c - k)[:, None] for c, k in zip(at, low, strict=True)]
                for p, (a, b) in enumerate(PAIRS):
                    grid, first, u, v = planes[s][p], low[a] * size[b] + low[b], part[a], part[b]
                    value = grid.take(first, 0) * ((1 - u) * (1 - v))
                    value += grid.take(first + size[b], 0) * (u * (1 - v))
                    value += grid.take(first + 1, 0) * ((1 - u) * v)
                    value += grid.take(first + size[b] + 1, 0) * (u * v)
                    made[:, s] *= value
            width = len(sizes) * features
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * width + 1, width, dtype=np.int32)), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), lists], ["point_id", "features"])

    return run


def sample(points: DataFrame, cells: DataFrame, sizes: Sequence[Sequence[int]], features: int, bounds: float = 1.6, rest: float = 0.0) -> DataFrame:
    """(point_id, features): for each point of distinct point_id its feature array, scale after scale.

    Of each scale, the product over the six planes of their bilinear samples.  x, y and z count in
    [-bounds, bounds], against the direction of the cells; t counts in [-1, 1]; points outside take
    the value of the edge.  ``sizes`` has the cells along each axis for each scale, at least two.

    Planes of at most HELD values are sent to the tasks as a whole, and each point is a row from begin to end.
    Of larger ones a point looks up one block in each plane, so only samples are shuffled, one for each plane, and no cell; a
    block is bounded in size, and points in one block are many rows of a join that Spark may split.
    """
    unit = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(a) if a == "t" else -F.col(a) / bounds) + 1) / 2)).alias(a) for a in AXES]
    if features * sum(size[a] * size[b] for size in sizes for a, b in PAIRS) <= HELD:
        rows = points.select("point_id", *unit)
        return rows.mapInArrow(_sampled(_whole(cells, sizes, features, rest), sizes, features), f"point_id {rows.schema['point_id'].dataType.simpleString()}, features array<double>")
    looks = []
    for s, size in enumerate(sizes):
        for p, (a, b) in enumerate(PAIRS):
            at = [F.col(AXES[k]) * (size[k] - 1) for k in (a, b)]
            low = [F.least(F.floor(u), F.lit(size[k] - 2)).cast("int") for u, k in zip(at, (a, b), strict=True)]
            looks.append(F.struct(F.lit(s).alias("scale"), F.lit(p).alias("plane"), low[0].alias("i"), low[1].alias("j"), (at[0] - low[0]).alias("u"), (at[1] - low[1]).alias("v")))
    rows = points.select("point_id", *unit).select("point_id", F.inline(F.array(*looks)))
    rows = rows.select("point_id", "scale", "plane", *[F.floor(F.col(c) / BLOCK).cast("int").alias(f"b{c}") for c in "ij"], *[(F.col(c) % BLOCK).alias(c) for c in "ij"], "u", "v")
    met = rows.join(blocks(cells, features, rest), ["scale", "plane", "bi", "bj"], "left")
    first = F.col("i") * (BLOCK + 1) + F.col("j") + 1
    corner = [F.element_at("grid", (first + d).cast("int")) for d in (0, BLOCK + 1, 1, BLOCK + 2)]
    share = [(1 - F.col("u")) * (1 - F.col("v")), F.col("u") * (1 - F.col("v")), (1 - F.col("u")) * F.col("v"), F.col("u") * F.col("v")]
    add = lambda x, y: F.zip_with(x, y, lambda m, n: m + n)
    scaled = lambda c, w: F.transform(c, lambda m: m * w)
    parts = [scaled(c, w) for c, w in zip(corner, share, strict=True)]
    value = F.when(F.col("grid").isNull(), F.array_repeat(_rest(F.col("plane"), rest), features)).otherwise(add(add(parts[0], parts[1]), add(parts[2], parts[3])))
    planes = met.select("point_id", F.struct("scale", "plane", value.alias("v")).alias("look")).groupBy("point_id").agg(F.sort_array(F.collect_list("look")).alias("looks"))  # six for each scale
    product = lambda own: F.aggregate(own, F.array_repeat(F.lit(1.0), features), lambda made, look: F.zip_with(made, look["v"], lambda m, n: m * n))
    scales = F.sequence(F.lit(0), F.lit(len(sizes) - 1))
    return planes.select("point_id", F.flatten(F.transform(scales, lambda s: product(F.slice("looks", s * len(PAIRS) + 1, len(PAIRS))))).alias("features"))


def regularisers(cells: DataFrame, sizes: Sequence[Sequence[int]], features: int, rest: float = 0.0) -> DataFrame:
    """(scale, plane, timed, smooth, away): for each plane with cells, the mean square of second differences along j
    and, for planes with time, the mean distance of its values from 1.

    Only cells that are there are looked at: each adds its difference from the rest to the three second
    differences that it is part of.  Planes of less than three cells along j have smooth 0.
    """
    size = lambda k: F.element_at(F.array(*[F.array(*[F.lit(s[pair[k]]) for pair in PAIRS]) for s in sizes]), F.col("scale") + 1)
    along = lambda k: F.element_at(size(k), F.col("plane") + 1)
    keys = ["scale", "plane"]
    known = cells.select(*keys, "i", "j", along(0).alias("ni"), along(1).alias("nj"), _rest(F.col("plane"), rest).alias("rest"), "values")
    rows = known.select(*keys, "i", "nj", "ni", F.posexplode("values").alias("feature", "value"), "rest", "j")
    parts = rows.select(*keys, "i", "ni", "nj", "feature", (F.col("value") - F.col("rest")).alias("gap"), F.inline(F.array(*[F.struct((F.col("j") + d).alias("at"), F.lit(w).alias("w")) for d, w in ((-1, 1.0), (0, -2.0), (1, 1.0))])))
    seconds = parts.where("at >= 1 and at <= nj - 2").groupBy(*keys, "i", "at", "feature", "ni", "nj").agg(F.sum(F.col("gap") * F.col("w")).alias("d"))
    smooth = seconds.groupBy(*keys).agg((F.sum(F.col("d") * F.col("d")) / F.first(F.col("ni") * (F.col("nj") - 2) * features)).alias("smooth"))
    timed = F.lit(False)
    for p, pair in enumerate(PAIRS):
        timed = timed | (F.lit(3 in pair) & (F.col("plane") == p))
    away = rows.groupBy(*keys).agg(F.first(timed).alias("timed"), (F.sum(F.abs(1 - F.col("value"))) / F.first(F.col("ni") * F.col("nj") * features)).alias("away"))
    return away.join(smooth, keys, "left").select(*keys, "timed", F.coalesce("smooth", F.lit(0.0)).alias("smooth"), F.when(F.col("timed"), F.col("away")).alias("away"))


def regularisation(cells: DataFrame, sizes: Sequence[Sequence[int]], features: int, space: float = 1.0, time: float = 1.0, still: float = 1.0, rest: float = 0.0) -> DataFrame:
    """(loss): weighted sum over all planes of smoothness in space and in time and of the distance from 1."""
    each = F.when(F.col("timed"), F.col("smooth") * time + F.col("away") * still).otherwise(F.col("smooth") * space)
    return regularisers(cells, sizes, features, rest).agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("loss"))
