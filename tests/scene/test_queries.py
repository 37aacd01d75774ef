"""Every registered scene query against its SQL, and properties that hold between queries."""

import importlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from splatloom.operators import composite, images, mutate, spatial, tracks
from splatloom.operators.project import project
from splatloom.plans import backward, boxes, codebooks, fields, fitting, geometry, lidars, measures, mutations, normalise, poses, rays, rendering, scene, segments, sensors, spinning, strategies, wide_lenses
from splatloom.sources import views as V

SF = "/root/testdata/sf0.001"
TOPICS = (rendering, segments, backward, strategies, spinning, fitting, normalise, boxes, codebooks, fields, rays, lidars, geometry, poses, mutations, scene, measures, sensors, wide_lenses)
QUERIES = {n: f for t in TOPICS for n, f in t.QUERIES.items()}
SQL = {n: s for t in TOPICS for n, s in t.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(rows, names):
    return sorted(repr([None if r[n] is None else float(r[n]) if isinstance(r[n], (int, float)) and not isinstance(r[n], bool) else r[n] for n in names]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert _rows([r.asDict() for r in got.collect()], sorted(names)) == _rows(want, sorted(names))


def test_sparse_equals_dense_at_the_requested_pixels(spark):
    dense = {tuple(r)[:3]: tuple(r)[3:] for r in rendering.composite_rgb(spark, SF).collect()}
    for r in rendering.composite_sparse(spark, SF).collect():
        assert dense[tuple(r)[:3]] == tuple(r)[3:]


def test_blend_equals_a_loop(spark):
    seen = project(V.gaussians(spark, SF), V.cameras(spark, SF).where("camera_id = 12")).toPandas().sort_values("gaussian_id")
    seen["near"] = seen.depth.astype(np.float32)
    seen = seen.sort_values(["near", "gaussian_id"])
    want = {}
    for y in range(0, 48, 5):
        for x in range(0, 64, 5):
            left, n, total = 1.0, 0, 0.0
            for g in seen.itertuples():
                dx, dy = g.mean2d_x - x - 0.5, g.mean2d_y - y - 0.5
                power = 0.5 * (g.conic_a * dx * dx + g.conic_c * dy * dy) + g.conic_b * dx * dy
                alpha = min(0.99, g.opacity * np.exp(-power))
                if power < 0 or alpha < 1 / 255:
                    continue
                if left * (1 - alpha) <= 1e-4:
                    break
                total, left, n = total + alpha * left * g.c0, left * (1 - alpha), n + 1
            want[x, y] = (n, round(total, 4))
    got = {(r["x"], r["y"]): (r["n"], r["c0"]) for r in rendering.composite_rgb(spark, SF).where("camera_id = 12 and x % 5 = 0 and y % 5 = 0").collect()}
    assert all(got[k][0] == n and abs(got[k][1] - c) < 2e-4 for k, (n, c) in want.items())


def test_boxes_of_the_image_edge_and_culling(spark):
    one = V.gaussians(spark, SF).limit(1)
    cams = V.cameras(spark, SF).where("camera_id = 12")
    move = lambda z, o: one.withColumns({"mx": F.lit(0.0), "my": F.lit(0.0), "mz": F.lit(z), "opacity": F.lit(o)})
    assert project(move(4.0, 0.5), cams).count() == 1
    assert project(move(-4.0, 0.5), cams).count() == 0 and project(move(4.0, 0.003), cams).count() == 0
    dense = project(move(-4.0, 0.5), cams, keep_culled=True).collect()
    assert len(dense) == 1 and dense[0]["radius_x"] == 0 and dense[0]["depth"] is None
    assert project(move(4.0, 0.5), cams, radius_clip=1000.0).count() == 0
    assert composite.tiles(project(move(4.0, 0.5), cams)).count() >= 1


def test_tracks_across_pieces(spark):
    keys = spark.createDataFrame([(1, t, k, float(t), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for k, t in enumerate([0, 10, 10, 500])], "track_id long, t_us long, key_id long, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    queries = spark.createDataFrame([(k, tr, t) for k, (tr, t) in enumerate([(1, -5), (1, 0), (1, 5), (1, 10), (1, 255), (1, 900), (2, 3)])], "query_id long, track_id long, t_us long")
    for piece in (7, 100, 10_000):
        got = {r["query_id"]: (r["tx"], r["exact"]) for r in tracks.interpolate(keys, queries, piece_us=piece).collect()}
        assert got == {0: (0.0, True), 1: (0.0, True), 2: (5.0, False), 3: (10.0, True), 4: (255.0, False), 5: (500.0, True), 6: (0.0, None)}
        near = {r["query_id"]: r["key_id"] for r in tracks.nearest(keys, queries, 6, piece_us=piece).collect()}
        assert near == {0: 0, 1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: None}


def test_neighbours_with_clusters_and_copies(spark):
    r = np.random.default_rng(0)
    p = np.concatenate([r.normal(0, 0.001, (40, 3)), r.normal(5, 3, (60, 3)), np.zeros((5, 3))])
    got = spatial.nearest_neighbours(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double"), 4).collect()
    assert len(got) == 4 * len(p)
    gaps = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    for i in range(len(p)):
        want = sorted((gaps[i, j], j) for j in range(len(p)) if j != i)[:4]
        assert np.allclose(sorted(x["distance"] for x in got if x["point_id"] == i), [w for w, _ in want])
    assert spatial.nearest_neighbours(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double"), 3).count() == 0


def test_relocation_of_one_copy_changes_nothing(spark):
    opacity, factor = mutate.relocated(F.lit(0.3), F.lit(1))
    a, b = spark.range(1).select(opacity, factor).first()
    assert abs(a - 0.3) < 1e-12 and abs(b - 1) < 1e-9


def test_ssim_of_equal_images_is_one(spark):
    image = composite.pixels(V.cameras(spark, SF).where("camera_id < 2")).withColumn("a", F.sin(F.col("x") * 0.7 + F.col("y")))
    least, windows = images.ssim_map(image, "a", "a").agg(F.min("ssim"), F.count("*")).first()
    assert abs(least - 1) < 1e-9 and windows == 2 * 54 * 38


def test_entry_without_the_optional_part(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("splatloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) >= set(QUERIES) and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
