"""Two-level compositing as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import composite as C
from splatloom.operators import rays, segments, surfels, unscented
from splatloom.sources import views as V
from splatloom.sources.tables import written

from . import rays as ray_plans
from . import rendering
from .common import r4

COLOURS = ["c0", "c1", "c2"]
#: Where the near range of depths ends.
NEAR = 4.0


def _shown(image: DataFrame, *columns: str) -> DataFrame:
    return image.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", *columns)])


def composite_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(segments.composite(rendering._seen(spark, folder), C.pixels(V.cameras(spark, folder)), COLOURS, size=64), *COLOURS)


def composite_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The state after three ranges from near to far: also which pixels are saturated."""
    state = segments.composite_by_ranges(rendering._seen(spark, folder), C.pixels(V.cameras(spark, folder)), COLOURS, 3, size=16, deep=True)
    return state.select(*C.PIXEL, "n", "done", *[r4(c).alias(c) for c in ("alpha", *COLOURS)])


def _ranged(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segmented(rendering._seen(spark, folder), 32).withColumn("range", (F.col("depth") >= NEAR).cast("int"))


def composite_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """What the far range adds to each pixel's state after the near one."""
    grid = C.pixels(V.cameras(spark, folder))
    rows, deep = segments.looks(_ranged(spark, folder), grid, 32)
    near = written(segments.advance(segments.blank(grid, ["c0"]), rows.where(F.col("depth") < NEAR), ["c0"], fresh=True, near=deep), "state")
    far = segments.advance(near, rows.where(F.col("depth") >= NEAR), ["c0"], near=deep)
    both = near.join(far.select(*C.PIXEL, F.col("n").alias("all"), F.col("alpha").alias("whole"), F.col("c0").alias("full")).hint("merge"), C.PIXEL)
    return both.select(*C.PIXEL, "n", (F.col("all") - F.col("n")).alias("more"), r4(F.col("whole") - F.col("alpha")).alias("alpha"), r4(F.col("full") - F.col("c0")).alias("c0"))


def pairs_in_range(spark: SparkSession, folder: str) -> DataFrame:
    """Of each camera and primitive of the far range: in how many pixels it still counts, and its weight there."""
    grid = C.pixels(V.cameras(spark, folder))
    rows, deep = segments.looks(_ranged(spark, folder), grid, 32)
    near = written(segments.advance(segments.blank(grid, []), rows.where(F.col("depth") < NEAR), [], fresh=True, near=deep), "state")
    found = segments.pairs_in_range(near, rows.where(F.col("depth") >= NEAR), near=deep)
    return found.groupBy("camera_id", "gaussian_id").agg(F.count("*").alias("n"), r4(F.sum("weight")).alias("weight"))


def tile_places(spark: SparkSession, folder: str) -> DataFrame:
    return segments.tile_places(segments.segmented(rendering._seen(spark, folder), 16)).select("camera_id", "tile_y", "tile_x", "gaussian_id", "place")


def composite_2dgs_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Colour and normal of flat primitives, by segments; pixels that none meets are left out."""
    cameras = V.cameras(spark, folder)
    image = segments.composite(rendering._surfels(spark, folder), C.pixels(cameras), ["red", "n0", "n1", "n2"], size=32, spread=surfels.surfel_pairs)
    return _shown(image.where("n > 0"), "red", "n0", "n1", "n2")


def composite_eval3d_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Compositing along rays as partial results of segments that are merged."""
    cameras = V.cameras(spark, folder)
    seen = unscented.project_unscented(rays.with_precision(ray_plans._scene(spark, folder)), cameras)
    channels = [*COLOURS, "hit", "nx", "ny", "nz"]
    return _shown(segments.composite(seen, C.pixels(cameras), channels, size=64, spread=lambda rows, mask, limits: rays.ray_pairs(rows, cameras, mask=mask, limits=limits)), *channels)


QUERIES = {f.__name__: f for f in (composite_segments, composite_ranges, composite_resumed, pairs_in_range, tile_places, composite_2dgs_segments, composite_eval3d_segments)}

_FAR = f"{NEAR}::double"
SQL = {
    "composite_segments": rendering.SQL["composite_rgb"],
    "composite_ranges": f"""with {rendering.PLAIN}{rendering.blend()}{rendering.GRID}, ends as (select camera_id, x, y, min(after_) <= 1e-4 as done from ordered group by all), i as ({rendering.image('grid', 'n, alpha, c0, c1, c2')})
select i.camera_id, i.x, i.y, n, coalesce(done, false) as done, {', '.join(f'round({c}, 4) + 0 as {c}' for c in ('alpha', *COLOURS))} from i left join ends e on e.camera_id = i.camera_id and e.x = i.x and e.y = i.y""",
    "composite_resumed": f"""with {rendering.PLAIN}{rendering.blend()}{rendering.GRID}, s as (select camera_id, x, y, count(*) filter (depth < {_FAR}) as n, count(*) filter (depth >= {_FAR}) as more,
  sum(weight) filter (depth >= {_FAR}) as alpha, sum(weight*c0) filter (depth >= {_FAR}) as c0 from weighted group by all)
select g.camera_id, g.x, g.y, coalesce(n, 0) as n, coalesce(more, 0) as more, round(coalesce(alpha, 0), 4) + 0 as alpha, round(coalesce(c0, 0), 4) + 0 as c0 from grid g left join s on s.camera_id = g.camera_id and s.x = g.x and s.y = g.y""",
    "pairs_in_range": f"with {rendering.PLAIN}{rendering.blend()} select camera_id, gaussian_id, count(*) as n, round(sum(weight), 4) + 0 as weight from weighted where depth >= {_FAR} group by all",
    "tile_places": f"with {rendering.PLAIN}{rendering._TILES} select camera_id, tile_y::int as tile_y, tile_x::int as tile_x, gaussian_id, row_number() over (partition by camera_id, tile_y, tile_x order by depth::float, gaussian_id) - 1 as place from met",
    "composite_2dgs_segments": f"select camera_id, x, y, n, alpha, red, n0, n1, n2 from ({rendering.SQL['composite_2dgs']})",
    "composite_eval3d_segments": ray_plans.SQL["composite_eval3d"],
}
