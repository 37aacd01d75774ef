"""Compositing by segments equals compositing by one ordered window, whatever the segments and ranges."""

import math

import pytest
from pyspark.sql import functions as F

from splatloom.operators import composite as C
from splatloom.operators import rays, segments, surfels, unscented
from splatloom.operators.project import project
from splatloom.plans import rendering
from splatloom.sources import views as V
from splatloom.sources.tables import written

SF = "/root/testdata/sf0.001"
CHANNELS = ["c0", "c1", "depth"]


@pytest.fixture(scope="module")
def scene(spark):
    cameras = V.cameras(spark, SF).where("camera_id in (3, 12)")
    dense = V.gaussians(spark, SF).drop(*[f"e{i}" for i in range(1, 17)]).withColumns({s: F.col(s) * 4 for s in ("sx", "sy", "sz")} | {"opacity": F.least(F.lit(1.0), F.col("opacity") * 1.5)})
    seen = project(dense, cameras).cache()
    return seen, C.pixels(cameras)


def _image(df, channels):
    return {tuple(r[c] for c in C.PIXEL): (r["n"], [r[c] for c in ("alpha", *channels)]) for r in df.collect()}


def _same(got, want):
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[k][1], v, strict=True)), (k, got[k], want[k])


@pytest.fixture(scope="module")
def want(scene):
    seen, grid = scene
    rows = C.contributions(C.pairs(seen))
    whole = C.pairs(seen).count()
    assert rows.count() < 0.8 * whole  # many pixels saturate
    return _image(C.composite(rows, grid, CHANNELS), CHANNELS)


@pytest.mark.parametrize("size", [1, 8, 1024])
def test_any_segment_size(scene, want, size):
    seen, grid = scene
    _same(_image(segments.composite(seen, grid, CHANNELS, size=size), CHANNELS), want)


@pytest.mark.parametrize("ranges", [3, 7])
def test_ranges_resume(scene, want, ranges):
    seen, grid = scene
    state = segments.composite_by_ranges(seen, grid, CHANNELS, ranges, size=4)
    assert state.where("done").count() > 100
    _same(_image(segments.image(state, CHANNELS), CHANNELS), want)


def test_segments_are_small_and_ordered(scene):
    seen, _ = scene
    rows = segments.segmented(seen, 8)
    assert rows.count() == seen.count() and rows.groupBy("camera_id", "segment").count().agg(F.max("count")).first()[0] <= 8
    got = [(r["camera_id"], r["segment"]) for r in rows.orderBy("camera_id", F.col("depth").cast("float"), "gaussian_id").collect()]
    assert got == sorted(got)


def test_pairs_of_later_ranges(scene):
    seen, grid = scene
    rows = segments.segmented(seen, 4)
    cut = rows.select(F.expr("percentile_disc(0.3) within group (order by segment)")).first()[0]
    state = segments.advance(segments.blank(grid, []), rows.where(F.col("segment") <= cut), [], fresh=True)
    later = segments.pairs_in_range(state, rows.where(F.col("segment") > cut))
    first = segments.pairs_in_range(segments.blank(grid, []), rows.where(F.col("segment") <= cut))
    got = {tuple(r[c] for c in (*C.PIXEL, "gaussian_id")): r["weight"] for r in first.union(later).collect()}
    want = {tuple(r[c] for c in (*C.PIXEL, "gaussian_id")): r["weight"] for r in C.contributions(C.pairs(seen)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], w, rel_tol=1e-9, abs_tol=1e-12) for k, w in want.items())


def test_tile_places_equal_one_window(scene):
    seen, _ = scene
    got = segments.tile_places(segments.segmented(seen, 2)).select("camera_id", "tile_x", "tile_y", "gaussian_id", "place")
    met = C.tiles(seen).createOrReplaceTempView("met")
    want = seen.sparkSession.sql("select camera_id, tile_x, tile_y, gaussian_id, row_number() over (partition by camera_id, tile_x, tile_y order by float(depth), gaussian_id) - 1L as place from met")
    assert met is None and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_surfels_and_rays_by_segments(spark):
    cameras = V.cameras(spark, SF).where("camera_id = 12")
    flat = rendering._surfels(spark, SF).where("camera_id = 12")
    grid = C.pixels(cameras)
    _same(_image(segments.composite(flat, grid, ["red", "n2"], size=4, spread=surfels.surfel_pairs), ["red", "n2"]), _image(C.composite(C.contributions(surfels.surfel_pairs(flat)), grid, ["red", "n2"]), ["red", "n2"]))
    seen = unscented.project_unscented(rays.with_precision(V.gaussians(spark, SF).where("gaussian_id % 4 = 0")), cameras)
    spread = lambda rows, mask: rays.ray_pairs(rows, cameras, mask=mask)
    state = segments.composite_by_ranges(seen, grid, ["c0", "hit"][:1], 2, size=8, spread=spread)
    _same(_image(segments.image(state, ["c0"]), ["c0"]), _image(C.composite(C.contributions(rays.ray_pairs(seen, cameras)), grid, ["c0"]), ["c0"]))


def _deep(spark, n=400):
    """Two cameras and ``n`` primitives that saturate the middle of the image long before the last one."""
    ids = spark.range(n).select(F.col("id").alias("gaussian_id"), ((F.col("id") * 37 % 101) / 101 - 0.5).alias("mx"), ((F.col("id") * 53 % 103) / 103 - 0.5).alias("my"), (3 + F.col("id") * 71 % n / n).alias("mz"))
    one = F.lit(1.0)
    scene = ids.select("*", one.alias("qw"), *[F.lit(0.0).alias(q) for q in ("qx", "qy", "qz")], *[F.lit(0.15).alias(f"s{a}") for a in "xyz"], F.lit(0.95).alias("opacity"), (F.col("gaussian_id") % 7 / 7).alias("c0"))
    view = [F.lit(float(i == j)).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    cameras = spark.range(2).select(F.col("id").cast("int").alias("camera_id"), *view, (F.col("id") * 0.2).alias("t0"), F.lit(0.0).alias("t1"), F.lit(0.0).alias("t2"), F.lit(60.0).alias("fx"), F.lit(60.0).alias("fy"), F.lit(20.0).alias("cx"), F.lit(20.0).alias("cy"), F.lit(40).alias("width"), F.lit(40).alias("height"))
    return scene, cameras


def test_pairs_behind_saturated_pixels_are_not_made(spark):
    scene, cameras = _deep(spark)
    seen, grid = written(project(scene, cameras), "seen"), C.pixels(cameras)
    whole, near = C.pairs(seen), written(segments.near_pairs(seen, grid, first=16), "near")
    assert near.count() < whole.count() / 2
    key = [*C.PIXEL, "gaussian_id", "place"]
    want = {tuple(r[c] for c in key): r["weight"] for r in C.contributions(whole).select(*key, "weight").collect()}
    got = {tuple(r[c] for c in key): r["weight"] for r in C.contributions(near).select(*key, "weight").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
    asked = grid.where("(x + y) % 5 = 0 and x < 20")
    some = segments.near_pairs(seen, asked, first=16)
    assert {tuple(r[c] for c in key) for r in C.contributions(some).select(*key).collect()} == {k for k in want if (k[1] + k[2]) % 5 == 0 and k[1] < 20}
    _same(_image(segments.composite(seen, grid, ["c0"], size=16, first=16), ["c0"]), _image(C.composite(C.contributions(whole), grid, ["c0"]), ["c0"]))


def test_no_table_of_pixels_is_broadcast(spark):
    scene, cameras = _deep(spark, 60)
    image = segments.composite(project(scene, cameras), C.pixels(cameras), ["c0"], size=16)
    assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, int, true], input[1, int, false], input[2, int, false]" not in image._jdf.queryExecution().executedPlan().toString()
    image.write.format("noop").mode("overwrite").save()
    final = image._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("HashedRelationBroadcastMode(List(input[0, int, true], input[1, int, false], input[2, int, false]") == 0


def test_pairs_are_not_shuffled(spark):
    scene, cameras = _deep(spark)
    seen, grid = written(project(scene, cameras), "seen"), C.pixels(cameras)
    near = segments.near_pairs(seen, grid, first=16)
    plan = C.contributions(near)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Window" in above and above.count("Generate explode") == 2 and "Exchange" not in above
    # What is known before a stretch is what all nearer pairs of the pixel leave.
    key = [*C.PIXEL, "gaussian_id"]
    whole = {tuple(r[c] for c in key): (r["place"], r["after"]) for r in C.contributions(C.pairs(seen)).collect()}
    rows = C.contributions(near).where("stretch > 0 and place = before + 1").collect()
    assert rows and all(whole[tuple(r[c] for c in key)][0] == r["place"] and math.isclose(math.exp(r["start"]) * (1 - r["alpha"]), whole[tuple(r[c] for c in key)][1], rel_tol=1e-9) for r in rows)


def test_tables_of_tiles_are_broadcast_by_one_long(spark):
    scene, cameras = _deep(spark)
    near = segments.near_pairs(written(project(scene, cameras), "seen"), C.pixels(cameras), first=16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    modes = [line for line in plan.split("\n") if "BroadcastExchange" in line]
    assert modes and all(line.count("input[") == 1 for line in modes)


def test_ranges_with_limits_add_up_stretches(spark, monkeypatch):
    scene, cameras = _deep(spark)
    seen, grid = written(project(scene, cameras), "seen"), C.pixels(cameras)
    names = []
    monkeypatch.setattr(segments, "written", lambda df, name: names.append(name) or written(df, name))
    rows = segments.segmented(seen, 16).withColumn("range", (F.col("depth") >= 3.4).cast("int"))
    rows, near = segments.looks(rows, grid, 16, first=64)
    parts = rows.groupBy("camera_id", "stretch").agg(F.countDistinct("range").alias("n"), F.min("range").alias("range")).collect()
    assert {r["n"] for r in parts} == {1} and {r["range"] for r in parts} == {0, 1}
    first = segments.advance(segments.blank(grid, ["c0"]), rows.where("range = 0"), ["c0"], fresh=True, near=near)
    state = segments.advance(written(first, "state"), rows.where("range = 1"), ["c0"], near=near)
    want = C.contributions(C.pairs(seen))
    _same(_image(first, ["c0"]), _image(C.composite(want.where("depth < 3.4"), grid, ["c0"]), ["c0"]))
    _same(_image(state, ["c0"]), _image(C.composite(want, grid, ["c0"]), ["c0"]))
    ends = C.ordered(C.pairs(seen)).groupBy(*C.PIXEL).agg(F.min("after").alias("after")).where("after <= 1e-4")
    assert state.where("done").count() == ends.count() > 100 and state.where("done").join(ends, C.PIXEL).count() == ends.count()
    assert "placed" not in names  # no pair is looked at twice
    with pytest.raises(ValueError):
        segments.advance(first, rows.drop("range"), ["c0"], near=near)
    deep = segments.composite_by_ranges(seen, grid, ["c0"], 3, size=16, deep=True)
    _same(_image(segments.image(deep, ["c0"]), ["c0"]), _image(C.composite(want, grid, ["c0"]), ["c0"]))
    assert "placed" not in names
