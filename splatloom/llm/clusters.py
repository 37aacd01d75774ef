"""Centroid clustering of vectors by tables of squared differences.

Components become integers, so everything here is exact.  In each round a task takes its vectors in blocks.
For each dimension of a block it lists the integers that occur, tabulates the squared difference of each to
every centroid, and a vector's distances are the sums of the rows that it gathers from these tables.  A table
never has more rows than its block, whatever the range of the values.  Tasks sum their vectors by cluster, so
a round shuffles one row for each task and cluster, however large a cluster is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import small_batches, written

#: Steps of a unit of a component, and the largest magnitude of its integer: at 64 components a squared distance
#: then stays below 2**60.
STEPS, LARGEST = 256, 1 << 26
#: Vectors in a block.
BLOCK = 4_096


def integers(vector: Column, steps: int = STEPS) -> Column:
    """floor(steps * x) of each component; beyond LARGEST in magnitude, LARGEST."""
    largest = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.least(largest, F.greatest(-largest, F.lit(float(steps)) * x.cast("double")))).cast("int"))


def quantised(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``size`` components, none of them null, infinite or not a number."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where((F.size(vector) == size) & finite).select(F.col(id_col).alias("vec_id"), integers(vector).alias("v"))


def first_centroids(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids, behind the seed, have the smallest hashes, in that order.

    Vectors without an id come last; vectors with the same id come in order of their components.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def _occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and each value's place among them."""
    low = values.min()
    span = int(values.max() - low) + 1
    if span > 4 * len(values):
        return np.unique(values, return_inverse=True)
    there = np.zeros(span, bool)
    there[values - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[values - low]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of an integer matrix; of equal distances, the smaller cluster."""
    sums = np.zeros((len(vectors), len(centroids)), np.int64)
    for dim in range(vectors.shape[1]):
        values, place = _occurring(vectors[:, dim])
        table = (values[:, None] - centroids[None, :, dim]) ** 2
        sums += table.take(place, axis=0)
    cluster = sums.argmin(axis=1)
    return cluster, sums[np.arange(len(sums)), cluster]


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer matrix) of a batch's vectors, block by block."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.int64).reshape(-1, size)
    for at in range(0, len(matrix), BLOCK):
        yield at, matrix[at : at + BLOCK]


def _summed(centroids: np.ndarray):
    """Of each task: the number and the componentwise sums of its vectors in each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, block in _blocks(batch, centroids.shape[1]):
                cluster, _ = nearest(block, centroids)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(block[order], first, axis=0)
                counts += np.bincount(cluster, minlength=len(centroids))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(block, centroids) for _, block in _blocks(batch, centroids.shape[1])]
            cluster, distance = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's mean; an empty cluster's stays."""
    parts = table.select("v").mapInArrow(_summed(centroids), "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim")
    out = centroids.copy()
    # At most one row for each component of each centroid.
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept.

    Vectors of another length than ``size``, null ones and those with a null, infinite or undefined component are
    left out.  Components whose integer would pass LARGEST in magnitude count as LARGEST, since distances are longs.
    Repeated rows and repeated ids are vectors of their own; vectors without an id are assigned, but are initial
    centroids only where there are fewer than ``k`` others.  With fewer vectors than ``k``, each is a centroid; an
    empty table gives no rows.  Other columns are not looked at.  An inertia
    beyond the range of a long is the largest long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    table = written(quantised(vectors, size, id_col, vector_col), "vectors")
    id_type = table.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(table, centroids)
    assigned = written(table.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    within = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total, most = sum(within.values()), (1 << 63) - 1
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = F.array(*[F.lit(min(most, within.get(c, 0))).cast("long") for c in range(len(centroids))])
    hashes = F.array(*[F.lit(name) for name in names])
    return assigned.withColumns({"cluster_inertia": F.get(sums, F.col("cluster")), "inertia": F.lit(min(most, total)).cast("long"), "centroid_sha256": F.get(hashes, F.col("cluster"))})


def sql(k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64) -> str:
    """DuckDB SQL of ``cluster`` over ``embeddings``, for components below LARGEST in magnitude."""
    assign = """a{n} as materialized (select row_id, vec_id, v, min({{'d': d, 'c': c}}) best from (
  select row_id, vec_id, t.v, c.c, list_sum(list_transform(list_zip(t.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from kept t, c{n} c) group by 1, 2, 3)"""
    move = """c{m} as materialized (select c.c, coalesce(x.v, c.v) v from c{n} c left join (
  select c, list((s - ((s % n) + n) % n) // n order by i) v from (select best.c c, i, sum(v[i])::hugeint s, count(*) n from a{n}, range(1, {last}) r(i) group by 1, 2) group by c) x on c.c = x.c)"""
    steps = []
    for n in range(rounds):
        steps += [assign.format(n=n), move.format(n=n, m=n + 1, last=size + 1)]
    steps.append(assign.format(n=rounds))
    return f"""with kept as materialized (select row_number() over () row_id, vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::double)::bigint) v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by h, v) - 1 c, v from (select sha256('{seed}:' || vec_id::varchar) h, v from kept order by h nulls last, v limit {k})),
{", ".join(steps)}
select vec_id, best.c::int as cluster, best.d::bigint distance, sum(best.d) over (partition by best.c)::bigint cluster_inertia, sum(best.d) over ()::bigint inertia,
  sha256(array_to_string(f.v, ',')) centroid_sha256 from a{rounds} join c{rounds} f on f.c = best.c"""
