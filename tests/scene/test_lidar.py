"""Tiles of boxes of angles against a version that tries every column and counts every ray."""

import math

import numpy as np
import pytest

from splatloom.operators import lidar as L

STEPS_A, STEPS_E, BINS_A, BINS_E = 20, 12, 10, 4
CIRCLE = 2 * math.pi


def _plain(az, el, xa, xe, span, span_e, rays):
    """Columns by intersection of intervals, turn by turn, column by column; rays one by one."""
    if xa <= 0 or xe <= 0:
        return set()
    steps = [min(STEPS_E - 1, int(v * STEPS_E)) for _, v in rays]
    row_of = [min(BINS_E - 1, sum(s < k for s in steps) * BINS_E // len(rays)) for k in range(STEPS_E + 1)]
    bottom, top = (min(span_e, max(0.0, e)) / span_e * STEPS_E for e in (el - xe, el + xe))
    e0, e1 = math.floor(bottom), math.ceil(top)
    if e1 < 1:
        return set()
    rows = range(row_of[e0], row_of[e1 - 1] + 1)
    low, high = az - xa, min(az + xa, az - xa + CIRCLE)
    parts = {0: (0.0, span)} if low <= 0 and az + xa >= span else {k: (max(0.0, low + k * CIRCLE), min(span, high + k * CIRCLE)) for k in (0, 1, -1)}
    seen = {}
    for turn, (a, b) in parts.items():
        if b <= a:
            continue
        take = lambda n, a=a, b=b: [c for c in range(n) if c + 1 > a / span * n and c < b / span * n]
        fine = take(STEPS_A)
        ray = any(min(STEPS_A - 1, int(u * STEPS_A)) in fine and e0 <= s < e1 for (u, _), s in zip(rays, steps, strict=True))
        if len(fine) == STEPS_A or ray:
            seen[turn] = take(BINS_A)
    columns = [c for p in seen.values() for c in p]
    if span < CIRCLE and len(set(columns)) < len(columns) or span >= CIRCLE and -1 in seen and 0 not in seen:
        columns = range(BINS_A)
    return {(r, c) for r in rows for c in columns}


@pytest.mark.parametrize("span", [CIRCLE, 4.0, 1.0])
def test_boxes_around_the_circle(spark, span):
    r = np.random.default_rng(int(span * 10))
    rays = [(float(u), float(v)) for u, v in zip(r.random(25) ** 2, r.random(25), strict=True)]
    # Across the seam on either side, wider than the view, wider than the circle, outside, of no size, and at random.
    boxes = [(0.05, 0.5, 0.3, 0.3), (6.2, 0.5, 0.4, 0.3), (6.2, 0.5, 3.0, 0.1), (3.0, 0.5, 3.1, 2.0), (1.0, 0.5, 4.0, 2.0), (0.0, 0.5, 7.0, 0.2), (5.0, -3.0, 0.2, 0.1), (2.0, 0.5, 0.0, 0.1), (2.0, 9.0, 7.0, 0.1), (0.5, 0.5, 0.51, 0.4)]
    boxes += [(float(r.random() * CIRCLE), float(r.normal(0.5, 0.4)), float(r.exponential(1.0)), float(r.exponential(0.2))) for _ in range(400)]
    primitives = spark.createDataFrame([(0, i, *b) for i, b in enumerate(boxes)], "sensor_id int, gaussian_id long, azimuth double, elevation double, extent_a double, extent_e double")
    views = spark.createDataFrame([(0, span, 1.0)], "sensor_id int, span_a double, span_e double")
    tilings = L.sensors(spark.createDataFrame([(0, u, v) for u, v in rays], "sensor_id int, u double, v double"), views, STEPS_A, STEPS_E, BINS_E)
    got = [tuple(x) for x in L.lidar_tiles(primitives, tilings, STEPS_A, STEPS_E, BINS_A, BINS_E).select("gaussian_id", "tile_row", "tile_col").collect()]
    want = {(i, *t) for i, b in enumerate(boxes) for t in _plain(*b, span, 1.0, rays)}
    assert len(got) == len(set(got)) and set(got) == want
