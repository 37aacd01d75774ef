"""Steps of densification against a plain loop; replay, rollback and inheritance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatloom.operators import strategies as S
from splatloom.sources import views as V
from splatloom.sources.versions import Versions

SF = "/root/testdata/sf0.001"
BY = S.Slopes(prune_opacity=0.1, grow_slope=0.4, grow_size=0.08, prune_size=0.3, grow_radius=0.8, prune_radius=0.9, radius_until=6, start=0, every=2, reset_every=4, stop=11, revised_opacity=True)
COLUMNS = ["gaussian_id", "mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity", "dynamic", "m1_mx", "m2_opacity"]


def _scene(spark):
    rows = V.gaussians(spark, SF).where("gaussian_id < 150")
    return rows.withColumns({"dynamic": F.col("gaussian_id") % 3 == 0, "m1_mx": F.lit(0.5), "m2_opacity": F.lit(0.25)}).select(*COLUMNS)


def _seen(rows):
    g = F.abs(F.sin(F.col("gaussian_id") * 1.7 + F.col("opacity")))
    return rows.where("gaussian_id % 5 <> 0").select("gaussian_id", g.alias("grad2d"), F.lit(1).alias("n"), F.abs(F.cos("gaussian_id")).alias("radius"))


def _noise(key, step, slot):
    return F.sin(key * 0.37 + step + slot * 1.3)


def _loop(rows, last):
    """The same in Python: a list of dicts, one step after the other."""
    rows = [dict(r, grad2d=0.0, seen=0.0, radius2d=0.0) for r in rows]
    for step in range(1, last + 1):
        if step >= BY.stop:
            break
        for r in rows:
            if r["gaussian_id"] % 5:
                r["grad2d"] += abs(math.sin(r["gaussian_id"] * 1.7 + r["opacity"]))
                r["seen"] += 1
                r["radius2d"] = max(r["radius2d"], abs(math.cos(r["gaussian_id"])))
        if step > BY.start and step % BY.every == 0 and step % BY.reset_every >= BY.pause:
            kept, new, top = [], [], max(r["gaussian_id"] for r in rows)
            for r in sorted(rows, key=lambda r: r["gaussian_id"]):
                high, small = r["grad2d"] / max(1.0, r["seen"]) > BY.grow_slope, max(r["sx"], r["sy"], r["sz"]) <= BY.grow_size
                zero = {"m1_mx": 0.0, "m2_opacity": 0.0}
                if high and small:
                    new.append(dict(r, **zero))
                if (high and not small) or (step < BY.radius_until and r["radius2d"] > BY.grow_radius):
                    w, x, y, z = np.array([r[c] for c in ("qw", "qx", "qy", "qz")]) / math.sqrt(sum(r[c] ** 2 for c in ("qw", "qx", "qy", "qz")))
                    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
                    for child in range(2):
                        at = turn @ [r[f"s{n}"] * math.sin(r["gaussian_id"] * 0.37 + step + (3 * child + k) * 1.3) for k, n in enumerate("xyz")]
                        new.append(dict(r, **zero, **{f"m{n}": r[f"m{n}"] + d for n, d in zip("xyz", at, strict=True)}, **{f"s{n}": r[f"s{n}"] / 1.6 for n in "xyz"}, opacity=1 - math.sqrt(1 - r["opacity"])))
                else:
                    kept.append(r)
            gone = lambda r: r["opacity"] < BY.prune_opacity or step > BY.reset_every and (max(r["sx"], r["sy"], r["sz"]) > BY.prune_size or step < BY.radius_until and r["radius2d"] > BY.prune_radius)  # noqa: E731, B023
            kept, new = [r for r in kept if not gone(r)], [r for r in new if not gone(r)]
            for k, r in enumerate(new):
                r["gaussian_id"] = top + 1 + k
            rows = kept + new
            for r in rows:
                r.update(grad2d=0.0, seen=0.0, radius2d=0.0)
        if step % BY.reset_every == 0:
            for r in rows:
                r.update(opacity=min(r["opacity"], 2 * BY.prune_opacity), m2_opacity=0.0)
    return rows


def test_ten_steps_equal_a_loop(spark, tmp_path):
    first = _scene(spark)
    scene = Versions(spark, f"file://{tmp_path}/scene")
    one = lambda rows, k: S.slope_step(rows, k, _seen(rows), BY, _noise)
    got = {r["gaussian_id"]: r.asDict() for r in S.run(scene, first, range(1, 11), one).collect()}
    want = {r["gaussian_id"]: r for r in _loop([r.asDict() for r in first.collect()], 10)}
    assert got.keys() == want.keys() and len(got) > 160 and max(got) > 200
    for i, r in want.items():
        assert all(math.isclose(got[i][c], v, rel_tol=1e-9, abs_tol=1e-12) for c, v in r.items()), (i, got[i], r)
    assert {r["dynamic"] for r in got.values()} == {True, False} and any(r["m1_mx"] == 0.5 for r in got.values())
    # A replay calls nothing; a rollback and a replay give the same again.
    S.run(scene, first, range(1, 11), lambda rows, k: pytest.fail("a committed step ran again"))
    assert scene.rollback(7) == [10, 9, 8] and scene.latest()[0] == 7
    with pytest.raises(KeyError):
        scene.at(8)
    with pytest.raises(ValueError):
        scene.commit(-1, lambda rows: rows)
    again = {r["gaussian_id"]: r.asDict() for r in S.run(scene, first, range(1, 11), one).collect()}
    assert again == got


def test_a_broken_write_is_written_again(spark, tmp_path):
    scene = Versions(spark, f"file://{tmp_path}/scene")
    first = _scene(spark)
    assert scene.commit(0, lambda _: first) and not scene.commit(0, lambda _: first)
    (tmp_path / "scene" / "step=1").mkdir()
    (tmp_path / "scene" / "step=1" / "part-left.parquet").write_bytes(b"half")
    assert scene.steps() == [0] and scene.commit(1, lambda rows: rows.limit(3)) and scene.at(1).count() == 3


def test_steps_by_draws(spark, tmp_path):
    by = S.Draws(most=170, noise=1.0, start=0, every=2, stop=9, least_opacity=0.2, noise_stop=7, noise_t=0.4, noise_k=10.0)
    first = _scene(spark)
    scene = Versions(spark, f"file://{tmp_path}/scene")
    S.run(scene, first, range(1, 9), lambda rows, k: S.draw_step(rows, k, 0.1, by))
    n = 150
    for k in range(1, 9):
        rows = scene.at(k)
        if k % 2 == 0:
            n = max(n, min(170, int(1.05 * n)))
            assert rows.where("opacity < 0.2").count() == 0
        assert rows.count() == n == rows.select("gaussian_id").distinct().count()
        moved = rows.join(scene.at(k - 1).select("gaussian_id", F.col("mx").alias("old")), "gaussian_id").where("mx <> old").count()
        assert moved > 100 if k < 7 else moved < 100
    assert S.draw_step(first, 1, 0.1, by).select(F.round(F.sum("mx"), 9)).first() == S.draw_step(first.repartition(7), 1, 0.1, by).select(F.round(F.sum("mx"), 9)).first()


def test_hashed_numbers_are_normal(spark):
    rows = spark.range(20000).select(S.normal(F.col("id"), 3, 0).alias("a"), S.normal(F.col("id"), 3, 1).alias("b"), S.uniform(F.col("id"), 3, 0).alias("u"))
    r = rows.agg(F.mean("a"), F.stddev("a"), F.corr("a", "b"), F.min("u"), F.max("u"), F.mean("u")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and abs(r[2]) < 0.03 and 0 <= r[3] < r[4] < 1 and abs(r[5] - 0.5) < 0.02
