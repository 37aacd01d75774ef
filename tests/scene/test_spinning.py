"""Spinning lidars: the column map against all elements, and points back to the elements they came from."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatloom.operators import spinning as P

SCHEMA = "sensor_id int, row_elevations array<double>, column_azimuths array<double>, row_offsets array<double>, from_azimuth double, span_azimuth double, spin int, from_elevation double, span_elevation double, " + ", ".join(f"{c} double" for c in P.POSES)


def _sensor(k, spin, span, rows, columns, moving=True):
    r = np.random.default_rng(k)
    elevations = np.linspace(0.3, -0.4, rows)
    offsets = r.uniform(0, 0.25 * span / columns, rows)
    start = 2.5 if span < 6 else math.pi
    azimuths = start + spin * np.linspace(0, span * (1 - 1.5 / columns), columns)
    a, b = np.array([1.0, 0.02, -0.01, 0.03]), np.array([1.0, 0.05, 0.01, -0.04]) if moving else np.array([1.0, 0.02, -0.01, 0.03])
    shift = np.array([0.5, -0.2, 0.1])
    if spin < 0:
        offsets = -offsets
    return (k, elevations.tolist(), azimuths.tolist(), offsets.tolist(), start, span, spin, 0.3, 0.7, *(a / np.linalg.norm(a)).tolist(), *shift.tolist(), *(b / np.linalg.norm(b)).tolist(), *(shift + ([0.1, 0.2, -0.05] if moving else 0)).tolist())


@pytest.fixture(scope="module")
def sensors(spark):
    return spark.createDataFrame([_sensor(0, -1, 2 * math.pi, 6, 40), _sensor(1, 1, 4.0, 5, 30), _sensor(2, -1, 3.0, 1, 1)], SCHEMA)


def _unit(e, a):
    return np.stack([np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)], axis=-1)


@pytest.mark.parametrize("factor", [1, 3])
def test_column_map_equals_all_elements(spark, sensors, factor):
    got = {(r["sensor_id"], r["cell_row"], r["cell_col"]): (r["row"], r["col"]) for r in P.column_map(sensors, factor).collect()}
    elements = P.elements(sensors).orderBy("sensor_id", "row", "col").collect()
    for s in sensors.collect():
        own = [e for e in elements if e["sensor_id"] == s["sensor_id"]]
        rays = _unit(np.array([e["elevation"] for e in own]), np.array([e["azimuth"] for e in own]))
        n, m = factor * len(s["row_elevations"]), factor * len(s["column_azimuths"])
        for i in range(n):
            for j in range(m):
                el = s["from_elevation"] - s["span_elevation"] * (i / (n - 1) if n > 1 else 0)
                az = s["from_azimuth"] + s["spin"] * s["span_azimuth"] * (j / (m - 1) if m > 1 else 0)
                d = ((rays - _unit(np.array(el), np.array(az))) ** 2).sum(axis=1)
                k = got.pop((s["sensor_id"], i, j))
                assert d[[x for x, e in enumerate(own) if (e["row"], e["col"]) == k][0]] <= d.min() + 1e-11
    assert not got


def test_points_go_back_to_their_elements(spark, sensors):
    moving = sensors.where("sensor_id < 2")
    rays = P.element_rays(moving)
    far = (5 + F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(20))).cast("double")
    points = rays.select("sensor_id", (F.col("row") * 1000 + F.col("col")).alias("point_id"), *[(F.col(f"o{n}") + far * F.col(f"d{n}")).alias(f"p{n}") for n in "xyz"])
    want = {(r["sensor_id"], r["row"] * 1000 + r["col"]): r for r in rays.collect()}
    got = {(r["sensor_id"], r["point_id"]): r for r in P.to_angles(points, moving, P.column_map(moving)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g["settled"] and g["valid"] and (g["row"], g["col"]) == (w["row"], w["col"]) and g["time"] == w["time"]
        assert abs(g["elevation"] - w["elevation"]) < 1e-6 and abs(math.remainder(g["azimuth"] - w["azimuth"], 2 * math.pi)) < 1e-6


def test_points_outside_the_view(spark, sensors):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0), (1, 2, 30.0, 30.0, 0.0), (2, 3, 1.0, 1.0, 0.0), (9, 4, 1.0, 1.0, 1.0)], "sensor_id int, point_id int, px double, py double, pz double")
    got = {r["point_id"]: r for r in P.to_angles(points, sensors, P.column_map(sensors)).collect()}
    assert set(got) == {1, 2, 3} and not got[1]["valid"] and got[3]["time"] == 0.5
    assert P.to_angles(points.limit(0), sensors, P.column_map(sensors)).count() == 0
