"""Reconstructions and scene records from files written here byte by byte."""

import struct

import numpy as np
from pyspark.sql import functions as F

from splatloom.sources import reconstructions as S
from splatloom.sources import views as V
from splatloom.sources.splat_files import PlySource

SF = "/root/testdata/sf0.001"


def _write(folder):
    cameras = struct.pack("<Q", 3)
    cameras += struct.pack("<iiQQ4d", 1, 1, 640, 480, 500.0, 510.0, 320.0, 240.0)
    cameras += struct.pack("<iiQQ4d", 2, 2, 641, 481, 400.0, 320.0, 240.0, 0.1)
    cameras += struct.pack("<iiQQ8d", 3, 4, 64, 48, 60.0, 61.0, 32.0, 24.0, 0.1, -0.2, 0.001, 0.002)
    (folder / "cameras.bin").write_bytes(cameras)
    images = struct.pack("<Q", 10)
    for k in range(10):
        images += struct.pack("<i7di", k + 1, 1.0, 0.0, 0.0, 0.0, 0.5 * k, -1.0, 2.0, k % 3 + 1) + f"im{9 - k}.jpg".encode() + b"\0"
        images += struct.pack("<Q", k) + b"".join(struct.pack("<ddq", 1.5 * j, 2.5, j if j % 2 else -1) for j in range(k))
    (folder / "images.bin").write_bytes(images)
    points = struct.pack("<Q", 5_000)
    for k in range(5_000):
        points += struct.pack("<Q3d3BdQ", k, k * 0.5, -k * 1.0, 2.0, k % 256, 7, 255, 0.25, k % 3) + b"".join(struct.pack("<ii", j + 1 if j else 99, k) for j in range(k % 3))
    (folder / "points3D.bin").write_bytes(points)


def test_colmap_tables(spark, tmp_path):
    _write(tmp_path)
    cameras, images, points = (f(spark, f"file://{tmp_path}/{n}.bin") for f, n in ((S.colmap_cameras, "cameras"), (S.colmap_images, "images"), (S.colmap_points, "points3D")))
    lens = {r["camera_id"]: r for r in cameras.collect()}
    assert (lens[1]["fx"], lens[1]["fy"], lens[1]["distortion"]) == (500.0, 510.0, [])
    assert (lens[2]["fx"], lens[2]["fy"], lens[2]["cx"], lens[2]["distortion"]) == (400.0, 400.0, 320.0, [0.1])
    assert lens[3]["model"] == "OPENCV" and lens[3]["distortion"] == [0.1, -0.2, 0.001, 0.002]
    seen = {r["image_id"]: r for r in images.collect()}
    assert len(seen) == 10 and seen[4]["name"] == "im6.jpg" and seen[4]["t0"] == 1.5
    assert [p["point_id"] for p in seen[4]["points"]] == [-1, 1, -1] and seen[4]["points"][2]["x"] == 3.0
    assert points.count() == 5_000 and points.agg(F.sum("x"), F.sum(F.size("track"))).first()[:] == (0.5 * sum(range(5_000)), sum(k % 3 for k in range(5_000)))
    # Image 99 isn't registered, so only the second entries of tracks are left.
    found = S.observations(points, images)
    assert found.count() == sum(k % 3 == 2 for k in range(5_000)) and {r["name"] for r in found.select("name").distinct().collect()} == {"im8.jpg"}
    posed = {r["name"]: r for r in S.posed_images(images, cameras, factor=2).collect()}
    assert [n for n, r in sorted(posed.items()) if r["split"] == "val"] == ["im0.jpg", "im8.jpg"]
    assert posed["im8.jpg"]["width"] == 320 and posed["im8.jpg"]["height"] == 240 and posed["im8.jpg"]["fx"] == 200.0


def test_canonical_records_round_trip(spark, tmp_path):
    spark.dataSource.register(PlySource)
    scene = V.gaussians(spark, SF)
    own = [[f"e{4 * k + j + 1}" for j in range(4)] for k in range(3)]
    records = S.canonical(scene, own)
    assert records.columns[3:6] == ["f_dc_0", "f_dc_1", "f_dc_2"] and records.columns[6:15] == [f"f_rest_{k}" for k in range(9)]
    records.write.format("splat_ply").mode("overwrite").save(str(tmp_path / "scene"))
    back = S.from_canonical(spark.read.format("splat_ply").load(str(tmp_path / "scene")))
    names = ["mx", "opacity", "sx", "qw", "sh0_0", "sh1_2", "sh2_3"]
    want = scene.select("mx", "opacity", "sx", "qw", F.col("e1").alias("sh0_0"), F.col("e7").alias("sh1_2"), F.col("e12").alias("sh2_3"))
    for x, y in zip(sorted(back.select(*names).collect()), sorted(want.collect()), strict=True):
        assert np.allclose(x, y, atol=1e-5)
    odd = scene.select(*[F.lit(None).cast("double").alias(c) if c == "my" else F.col(c) for c in scene.columns])
    assert S.canonical(odd).count() == 0 and S.canonical(scene.withColumn("opacity", F.lit(1.0))).count() == 0


def test_npz_rows(spark, tmp_path):
    np.savez(tmp_path / "a.npz", points=np.arange(12.0).reshape(4, 3), label=np.arange(4))
    np.savez(tmp_path / "b.npz", points=np.zeros((0, 3)), label=np.arange(0))
    found = S.npz_rows(spark, f"file://{tmp_path}/*.npz", {"x": "points:0", "z": "points:2", "label": "label"}, "x double, z double, label long")
    assert sorted(map(tuple, found.collect())) == [(3.0 * k, 3.0 * k + 2, k) for k in range(4)]
