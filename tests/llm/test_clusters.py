"""Centroid clustering against a version in whole numbers of Python."""

import hashlib
import math

import numpy as np
import pytest

from splatloom.llm import clusters


def _plain(rows, k, rounds, seed, size):
    kept = [(i, [max(-clusters.LARGEST, min(clusters.LARGEST, math.floor(max(-1e300, min(1e300, 256 * float(x)))))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: ("~", r[1]) if r[0] is None else (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=rank)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            members = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    within = lambda c: min(2**63 - 1, sum(d for _, x, d in found if x == c))
    return [(i, c, d, within(c), min(2**63 - 1, sum(d for *_, d in found)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("block", "k"), [(4096, 7), (3, 7), (5, 500)])
def test_clusters_equal_a_plain_version(spark, monkeypatch, block, k):
    monkeypatch.setattr(clusters, "BLOCK", block)
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(120)]
    rows += [(0, rows[0][1]), (0, rows[3][1]), (None, [0.1, 0.2, 0.3, 0.4]), (7, [0.5] * 4), (8, [0.5] * 4)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [math.nan] * 4), (205, [math.inf, 0.0, 0.0, 0.0]), (206, [3e38, -3e38, 0.0, 1e5]), (207, [-0.0] * 4)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance int").repartition(3)
    assert _rows(clusters.cluster(table, k, 3, 2, 4)) == sorted(_plain(rows, k, 3, 2, 4), key=str)


def test_clusters_of_empty_tables_and_other_ids(spark):
    empty = spark.createDataFrame([], "vec_id string, embedding array<double>")
    got = clusters.cluster(empty)
    assert got.count() == 0 and got.schema["vec_id"].dataType.simpleString() == "string"
    rows = [("a", [1.0, 2.0]), ("b", [1.5, 2.0]), ("c", [9.0, 9.0])]
    got = clusters.cluster(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 2, 4, 2, 2)
    assert _rows(got) == sorted(_plain(rows, 2, 4, 2, 2), key=str)


def test_ties_go_to_the_smaller_cluster():
    cluster, distance = clusters.nearest(np.array([[0, 0], [10**6, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, (10**6 - 1) ** 2]
