"""Points in turned boxes of mixed sizes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatloom.operators import boxes
from splatloom.operators.boxes import first_posed_box
from splatloom.operators.spatial import first_box

BOX = "frame int, box_id long, bx double, by double, bz double, hx double, hy double, hz double, qw double, qx double, qy double, qz double"


@pytest.mark.parametrize("seed", [1, 2])
def test_first_posed_box_equals_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    points = [(int(f), i, *map(float, p)) for i, (f, p) in enumerate(zip(r.integers(0, 3, 500), r.normal(0, 3, (500, 3)), strict=True))]
    boxes = [(int(r.integers(0, 3)), i, *map(float, r.normal(0, 3, 3)), *map(float, 10 ** r.uniform(-2, 1.2, 3)), *map(float, r.normal(size=4))) for i in r.permutation(120).tolist()]
    boxes += [(0, 500, 0.0, 0.0, 0.0, -1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (0, -1, 0.0, 0.0, 0.0, None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (7, 3, 0.0, 0.0, 0.0, 1e6, 1e6, 1e6, 1.0, 0.0, 0.0, 0.0)]
    points += [points[0], (1, 900, 1e7, 0.0, 0.0), (9, 901, 0.0, 0.0, 0.0)]
    got = first_posed_box(spark.createDataFrame(points, "frame int, point_id long, x double, y double, z double"), spark.createDataFrame(boxes, BOX)).collect()
    want = []
    for f, i, *p in points:
        best = None
        for g, k, *b in sorted(boxes, key=lambda b: b[1]):
            if g != f or b[3] is None or min(b[3:6]) < 0:
                continue
            w, x, y, z = np.array(b[6:]) / np.linalg.norm(b[6:])
            turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
            local = turn.T @ (np.array(p) - b[:3])
            if (np.abs(local) <= b[3:6]).all():
                best = (k, *local)
                break
        want.append((f, i, best[0] if best else None, *([round(v, 6) + 0.0 for v in best[1:]] if best else [None] * 3)))
    assert sorted(want, key=str) == sorted([(r["frame"], r["point_id"], r["box_id"], *[None if r[c] is None else round(r[c], 6) + 0.0 for c in ("lx", "ly", "lz")]) for r in got], key=str)
    assert sum(w[2] is not None for w in want) > 50


def test_empty_tables(spark):
    points = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "frame int, point_id long, x double, y double, z double")
    none = spark.createDataFrame([], BOX)
    assert first_posed_box(points, none).first()["box_id"] is None and first_posed_box(points.limit(0), none).count() == 0


@pytest.mark.parametrize(("first", "in_list"), [(32_768, 4096), (400, 3)])
def test_of_many_boxes_upon_each_other_few_are_met(spark, monkeypatch, first, in_list):
    monkeypatch.setattr(boxes, "FIRST", first)
    monkeypatch.setattr(boxes, "LISTED", in_list)
    r = np.random.default_rng(4)
    n = 3000
    centre, half, quat = r.uniform(0, 1, (n, 3)), r.uniform(0.1, 0.4, (n, 3)), r.normal(size=(n, 4))
    half[::50] *= 4
    ids = r.permutation(n) * 7
    points = r.uniform(-0.7, 1.7, (1500, 3))
    turn = [np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]) for w, x, y, z in quat / np.linalg.norm(quat, axis=1)[:, None]]
    held = np.stack([(np.abs((points - centre[k]) @ turn[k]) <= half[k]).all(1) for k in range(n)])
    want = {i: int(ids[h].min()) if h.any() else None for i, h in enumerate(held.T)}
    table = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)], "frame int, point_id long, x double, y double, z double")
    many = spark.createDataFrame([(1, int(ids[k]), *map(float, (*centre[k], *half[k], *quat[k]))) for k in range(n)], BOX)
    assert {x["point_id"]: x["box_id"] for x in first_posed_box(table, many).collect()} == want
    lists, size, several = boxes.listed(table, many, ["frame"])
    pairs = table.select("frame", *[F.floor(F.col(a) / size).alias(f"g{a}") for a in "xyz"]).join(lists, ["frame", "gx", "gy", "gz"]).agg(F.sum(F.size("boxes"))).first()[0]
    # All pairs in one cell of the boxes' own size would be millions.
    assert pairs < 30 * len(points) and several == (in_list == 3)


def test_of_boxes_in_one_place_only_the_first_is_met(spark, monkeypatch):
    found = []

    def spied(*args, listed=boxes.listed):
        found.append(listed(*args))
        return found[-1]

    monkeypatch.setattr(boxes, "listed", spied)
    table = spark.range(2000).select((F.col("id") % 1900).alias("point_id"), *[(F.col("id") % 1900 * k % 101 / 25.25).alias(a) for a, k in zip("xyz", (7, 11, 13), strict=True)])
    many = spark.range(20_000).select((99_999 - F.col("id")).alias("box_id"), *[(F.col("id") % 500 * k % 37 / 9.25).alias(f"b{a}") for a, k in zip("xyz", (3, 5, 8), strict=True)], F.lit(0.3).alias("half"))
    got = first_box(table, many).collect()
    places = {tuple(x)[1:4]: x["box_id"] for x in many.orderBy(F.desc("box_id")).collect()}
    at, ids = np.array(list(places)), np.array(list(places.values()))
    assert len(got) == 1900
    for x in got:
        inside = ids[(np.abs(at - [x["x"], x["y"], x["z"]]) <= 0.3).all(1)]
        assert x["box_id"] == (int(inside.min()) if len(inside) else None)
    lists, size, _ = found[0]
    pairs = table.select(*[F.floor(F.col(a) / size).alias(f"g{a}") for a in "xyz"]).join(lists, ["gx", "gy", "gz"]).agg(F.sum(F.size("boxes"))).first()[0]
    assert 0 < pairs < 4 * 2000
