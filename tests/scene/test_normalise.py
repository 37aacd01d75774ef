"""Exact quantiles and scene alignment against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatloom.operators import normalise as N
from splatloom.operators import quantiles


@pytest.mark.parametrize("bound", [5, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, bound):
    monkeypatch.setattr(quantiles, "BOUND", bound)
    r = np.random.default_rng(1)
    groups = {"even": r.normal(size=1000), "odd": r.exponential(size=777) ** 9, "outlier": np.append(r.random(500), [1e300, -1e300]), "ties": np.repeat([1.0, 2.0, 3.0], [300, 5, 295]), "same": np.full(400, 7.0), "one": np.array([4.0])}
    rows = [(g, float(v), float(-v)) for g, x in groups.items() for v in x] + [("even", None, float("nan")), ("none", None, None)]
    table = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    for share in (0.5, 0.9):
        got = {x["g"]: x for x in quantiles.exact_quantiles(table, ["g"], ["v", "w"], share).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert np.isclose(got[g]["v"], np.quantile(x, share), rtol=1e-12) and np.isclose(got[g]["w"], np.quantile(-x, share), rtol=1e-12)


def test_principal_axes_equal_numpy(spark):
    r = np.random.default_rng(2)
    clouds = {k: r.normal(size=(300 + k, 3)) * [3, 1, 0.2] @ np.linalg.qr(r.normal(size=(3, 3)))[0] + r.normal(size=3) for k in range(3)}
    table = spark.createDataFrame([(k, *map(float, p)) for k, c in clouds.items() for p in c], "scene_id int, x double, y double, z double")
    got = {x["scene_id"]: x for x in N.principal_axes(table).collect()}
    moved = N.transformed(table, N.principal_axes(table), "scene_id").toPandas()
    for k, c in clouds.items():
        values, vectors = np.linalg.eigh(np.cov(c, rowvar=False))
        m = np.array([got[k][n] for n in N.MATRIX]).reshape(3, 4)
        assert np.allclose([got[k][f"spread{i}"] for i in range(3)], values[::-1]) and np.isclose(np.linalg.det(m[:, :3]), 1)
        assert np.allclose(np.abs(np.sum(m[:, :3] * vectors.T[::-1], axis=1)), 1) and np.allclose(m[:, 3], -m[:, :3] @ np.median(c, axis=0))
        own = moved[moved.scene_id == k][["x", "y", "z"]].to_numpy()
        assert np.allclose(np.cov(own, rowvar=False), np.diag(values[::-1]), atol=1e-9)


@pytest.mark.parametrize(("focus", "strict"), [(True, False), (False, True)])
def test_upright_scenes(spark, focus, strict):
    r = np.random.default_rng(3)
    rows, poses = [], {}
    for k in range(3):
        tilt = np.linalg.qr(r.normal(size=(3, 3)))[0] if k < 2 else np.diag([-1.0, -1.0, 1.0])
        poses[k] = [(tilt @ np.linalg.qr(np.eye(3) + 0.2 * (k < 2) * r.normal(size=(3, 3)))[0] * 1.0, r.normal(size=3) * 2 + [1, 2, 3]) for _ in range(21)]
        rows += [(k, *map(float, m.ravel()), *map(float, t)) for m, t in poses[k]]
    table = spark.createDataFrame(rows, "scene_id int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", t0 double, t1 double, t2 double")
    for x in N.upright(table, focus=focus, strict=strict).collect():
        m = np.array([x[n] for n in N.MATRIX]).reshape(3, 4)
        turn, own = m[:, :3] / x["scale"], poses[x["scene_id"]]
        up = np.mean([-p[:, 1] for p, _ in own], axis=0)
        assert np.allclose(turn @ turn.T, np.eye(3)) and np.isclose(np.linalg.det(turn), 1) and np.allclose(turn @ up / np.linalg.norm(up), [0, -1, 0])
        at, ahead = np.array([turn @ t for _, t in own]), np.array([turn @ p[:, 2] for p, _ in own])
        near = at - (ahead * at).sum(1)[:, None] * ahead if focus else at
        assert np.allclose(m[:, 3], -np.median(near, axis=0) * x["scale"])
        far = np.linalg.norm(at - np.median(near, axis=0), axis=1)
        assert np.isclose(x["scale"], 1 / (far.max() if strict else np.median(far)))
    assert N.upright(table.where(F.lit(False))).count() == 0


def test_a_camera_turned_by_almost_half_a_turn_keeps_its_digits(spark):
    import math

    from splatloom.operators import normalise as N

    for gap in (7.3e-6, 3e-7):
        a = math.pi - gap
        c, s = math.cos(a), math.sin(a)
        row = {"scene_id": 1, "r00": c, "r01": -s, "r02": 0.0, "r10": s, "r11": c, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0, "t0": 15.708, "t1": 6.854, "t2": 0.5}
        got = N.upright(spark.createDataFrame([row])).first()
        # The pose turns about z only, so the turn to -y is the inverse of its own.
        for name, want in {"a00": 2 * c, "a01": 2 * s, "a10": -2 * s, "a11": 2 * c, "a03": -2 * (c * 15.708 + s * 6.854), "a13": -2 * (-s * 15.708 + c * 6.854)}.items():
            assert abs(got[name] - want) < 1e-8, (gap, name, got[name], want)


def test_every_pass_sees_the_same_turns(spark):
    r = np.random.default_rng(5)
    poses = [(k, float(a), float(x), float(y)) for k in range(300) for a, x, y in zip(r.uniform(-1, 1, 13), *r.normal(size=(2, 13)) * 4, strict=True)]
    angle = F.col("a")
    turn = [[F.cos(angle), -F.sin(angle), F.lit(0.0)], [F.sin(angle), F.cos(angle), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    cameras = spark.createDataFrame(poses, "scene_id int, a double, t0 double, t1 double").withColumn("t2", F.lit(0.5))
    cameras = cameras.select("scene_id", "t0", "t1", "t2", *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    # Each pass meets the rows in another order, so that sums of them differ in their last digits.
    got = N.upright(cameras.repartition(7, F.expr("reflect('java.util.UUID', 'randomUUID')"))).collect()
    assert len(got) == 300
    for x in got:
        own = np.array([p[1:] for p in poses if p[0] == x["scene_id"]])
        up = np.array([np.sin(own[:, 0]).mean(), -np.cos(own[:, 0]).mean()])
        s, c = -up / np.linalg.norm(up)
        at = own[:, 1:] @ np.array([[c, -s], [s, c]]).T
        middle = np.median(at, axis=0)
        assert np.isclose(x["scale"], 1 / np.median(np.sqrt(((at - middle) ** 2).sum(1) + 0.25))) and np.allclose([x["a03"], x["a13"]], -middle * x["scale"])
