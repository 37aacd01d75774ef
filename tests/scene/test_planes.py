"""Feature planes against plain numpy."""

import numpy as np

from splatloom.operators import planes as P
from splatloom.plans.fields import field_points


def test_samples_and_regularisers_equal_numpy(spark):
    r = np.random.default_rng(3)
    sizes, features, rest = P.resolutions((11, 9, 17, 3)), 3, 0.2
    full, rows = {}, []
    for s, size in enumerate(sizes):
        for p, (a, b) in enumerate(P.PAIRS):
            grid = np.full((size[a], size[b], features), 1.0 if b == 3 else rest)
            for i in range(size[a]):
                for j in range(size[b]):
                    if r.random() < 0.4:
                        grid[i, j] = r.normal(size=features)
                        rows.append((s, p, i, j, [float(v) for v in grid[i, j]]))
            full[s, p] = grid
    cells = spark.createDataFrame(rows, "scale int, plane int, i int, j int, values array<double>")
    points = np.concatenate([r.uniform(-2, 2, (60, 4)), [[1.6, -1.6, 0, 1], [9, -9, 1.6, -5]]])
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(points)], "point_id long, x double, y double, z double, t double")
    got = {x["point_id"]: x["features"] for x in P.sample(table, cells, sizes, features, rest=rest).collect()}
    assert len(got) == len(points)
    for k, point in enumerate(points):
        unit = np.clip((np.array([*(-point[:3] / 1.6), point[3]]) + 1) / 2, 0, 1)
        want = []
        for s, size in enumerate(sizes):
            made = np.ones(features)
            for p, (a, b) in enumerate(P.PAIRS):
                u, v = unit[a] * (size[a] - 1), unit[b] * (size[b] - 1)
                i, j = int(u), int(v)
                i1, j1 = min(i + 1, size[a] - 1), min(j + 1, size[b] - 1)
                u, v, g = u - i, v - j, full[s, p]
                made = made * (g[i, j] * (1 - u) * (1 - v) + g[i1, j] * u * (1 - v) + g[i, j1] * (1 - u) * v + g[i1, j1] * u * v)
            want += list(made)
        assert np.allclose(got[k], want, atol=1e-12)
    loss = 0.0
    for x in P.regularisers(cells, sizes, features, rest).collect():
        g = full[x["scale"], x["plane"]]
        second = np.diff(g, 2, axis=1)
        smooth = (second**2).mean() if second.size else 0.0
        assert np.isclose(x["smooth"], smooth)
        assert x["timed"] == (3 in P.PAIRS[x["plane"]]) and (not x["timed"] or np.isclose(x["away"], np.abs(1 - g).mean()))
        loss += smooth * (3.0 if x["timed"] else 2.0) + (0.5 * np.abs(1 - g).mean() if x["timed"] else 0.0)
    assert np.isclose(P.regularisation(cells, sizes, features, 2.0, 3.0, 0.5, rest).first()["loss"], loss)
    assert P.regularisation(cells.where("false"), sizes, features).first()["loss"] == 0.0


def test_points_in_whole_planes_are_not_multiplied_and_equal_those_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    sizes = P.resolutions((11, 9, 17, 3))
    rows = {(s, p, int(r.integers(0, sizes[s][a])), int(r.integers(0, sizes[s][b]))) for s in range(2) for p, (a, b) in enumerate(P.PAIRS) for _ in range(30)}
    cells = spark.createDataFrame([(*k, [float(v) for v in r.normal(size=2)]) for k in sorted(rows)], "scale int, plane int, i int, j int, values array<double>")
    points = [[float(v) for v in p] for p in r.uniform(-2, 2, (200, 4))] + [[None, 0.5, float("nan"), None], [float("inf"), float("-inf"), -0.0, 1.0]]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point_id long, x double, y double, z double, t double")
    whole = P.sample(table, cells, sizes, 2, rest=0.2)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
    got = {x["point_id"]: x["features"] for x in whole.collect()}
    monkeypatch.setattr(P, "HELD", 0)
    want = {x["point_id"]: x["features"] for x in P.sample(table, cells, sizes, 2, rest=0.2).collect()}
    assert len(got) == len(points) and got.keys() == want.keys()
    for k in got:
        assert np.allclose(got[k], want[k], rtol=1e-13, atol=1e-13), points[k]


def test_the_first_line_of_several_files_counts(spark, tmp_path):
    for name, q in (("b", 20.0), ("a", 10.0), ("c", 30.0)):
        lines = spark.createDataFrame([(n, 1, q + n, 0.01, 20000.0) for n in range(4)] + [(n, 1, 49.0, 0.01, 20000.0) for n in range(4)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double")
        lines.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (next((tmp_path / name).glob("*.parquet"))).rename(tmp_path / f"{name}.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "bac":
        (tmp_path / f"{name}.parquet").rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    plan = field_points(spark, str(tmp_path))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {x["point_id"]: x["x"] for x in plan.collect()} == {n * 8 + 1: (10 + n) / 10 - 2.5 for n in range(4)}
