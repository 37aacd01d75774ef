"""Codebooks of vectors by k-means of Manhattan distance; labels, few-bit centroids, and back.

Vectors are laid on an integer grid first, so that distances, medians and costs are exact and the
same in every run.  Vectors stay where they are: a round moves counts of grid levels only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatloom.sources.tables import written

#: Labels take 16 bits; this bounds what goes to the driver and to every task (levels take 16 bits each, too).
MOST_CLUSTERS = 1 << 16
#: Bits of a grid level, and rows and centroids that are compared at once.
GRID_BITS, ROWS, CENTROIDS = 12, 256, 256


@dataclass(frozen=True)
class Grid:
    """Levels 0 .. 2^bits - 1 from ``low`` to ``high``."""

    low: float
    high: float
    bits: int

    @property
    def top(self) -> int:
        return (1 << self.bits) - 1

    def level(self, x: Column) -> Column:
        if self.high <= self.low:
            return F.lit(0)
        return F.rint((x - self.low) / (self.high - self.low) * self.top).cast("int")

    def value(self, level: Column) -> Column:
        return level / float(self.top) * (self.high - self.low) + self.low


@dataclass(frozen=True)
class Codebook:
    """``labels`` (key, label, distance in levels), ``codes`` (label, codes) and the grid of the codes."""

    labels: DataFrame
    codes: DataFrame
    grid: Grid
    costs: list[int]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the centroid nearest to each row; of equally near ones the first.

    The difference of two vectors' sums is never more than their distance.  Rows and centroids are
    compared in groups of similar sums, nearest sums first, until no further group can be as near.
    """
    order = np.argsort(centroids.sum(1), kind="stable")
    groups = [order[k : k + CENTROIDS] for k in range(0, len(order), CENTROIDS)]
    sums = centroids.sum(1)
    low, high = np.array([sums[g[0]] for g in groups]), np.array([sums[g[-1]] for g in groups])
    label, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    own = x.sum(1)
    turn = np.argsort(own, kind="stable")
    for k in range(0, len(x), ROWS):
        rows = turn[k : k + ROWS]
        gap = np.maximum(0, np.maximum(low - own[rows[-1]], own[rows[0]] - high))
        for g in np.argsort(gap, kind="stable"):
            if gap[g] > best[rows].max():
                break
            at = np.sort(groups[g])
            far = np.zeros((len(rows), len(at)), np.int64)
            for d in range(x.shape[1]):
                far += np.abs(x[rows, d][:, None] - centroids[at, d][None, :])
            pick = far.argmin(1)
            least = far[np.arange(len(rows)), pick]
            nearer = (least < best[rows]) | (least == best[rows]) & (at[pick] < label[rows])
            label[rows[nearer]], best[rows[nearer]] = at[pick][nearer], least[nearer]
    return label, best


def _assigned(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` (key, levels) with the label of the nearest centroid and the distance."""
    found = sorted(centroids.select("label", "levels").collect())  # at most MOST_CLUSTERS
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["label"] for r in found], np.int32), np.array([r["levels"] for r in found], np.int16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, levels = sent.value[0], sent.value[1].astype(np.int64)
        for batch in batches:
            x = batch.column("levels").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, levels.shape[1])
            label, far = nearest(x, levels)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[label], pa.int32()), pa.array(far, pa.int64())], [*batch.schema.names, "label", "distance"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.mapInArrow(run, schema)


def medians(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The centroids after a round: each component's lower median, from counts of levels; empty clusters stay.

    Counts are summed in the tasks first, and a group of the window has a row for each level at most.
    """
    counts = assigned.select("label", F.posexplode("levels").alias("d", "level")).groupBy("label", "d", "level").agg(F.count("*").alias("n"))
    within = Window.partitionBy("label", "d")
    counts = counts.select("*", F.sum("n").over(within.orderBy("level")).alias("upto"), F.sum("n").over(within).alias("all"))
    middle = counts.where("2 * upto >= all").groupBy("label", "d").agg(F.min("level").alias("level"))
    new = middle.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "level"))), lambda s: s["level"]).alias("new"))
    return centroids.join(new, "label", "left").select("label", F.coalesce("new", "levels").alias("levels"))


def codebook(vectors: DataFrame, clusters: int = MOST_CLUSTERS, rounds: int = 10, bits: int = 6, key: str = "gaussian_id", value: str = "v") -> Codebook:
    """A codebook of ``vectors``: arrays ``value`` of equal length, each with a key.

    The first centroids are the vectors of the smallest MD5 of their key; fewer vectors make fewer
    centroids.  ``rounds`` of nearest centroids and medians follow, each at no more cost than the one
    before, and the labels are those of the last centroids; these are then rounded to ``bits`` bits
    over their own range.  Vectors with a null or non-finite component are left out.
    """
    if not 1 <= clusters <= MOST_CLUSTERS:
        raise ValueError(f"from 1 to {MOST_CLUSTERS} clusters, not {clusters}")
    whole = vectors.where(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    low, high = whole.agg(F.min(F.array_min(value)), F.max(F.array_max(value))).first()
    grid = Grid(low or 0.0, high or 0.0, GRID_BITS)
    placed = written(whole.select(F.col(key).alias("key"), F.transform(value, grid.level).alias("levels")), "levels")
    first = placed.orderBy(F.md5(F.col("key").cast("string")), "key").limit(clusters)
    numbered = first.select((F.row_number().over(Window.orderBy(F.md5(F.col("key").cast("string")), "key")) - 1).alias("label"), "levels")
    centroids, costs = written(numbered, "centroids"), []
    if low is None:
        return Codebook(placed.select("key", F.lit(0).alias("label"), F.lit(0).cast("long").alias("distance")), centroids.withColumnRenamed("levels", "codes"), Grid(0.0, 0.0, bits), costs)
    for k in range(rounds + 1):
        assigned = written(_assigned(placed, centroids), "assigned")
        costs.append(assigned.agg(F.sum("distance")).first()[0])
        if k < rounds:
            centroids = written(medians(assigned, centroids), "centroids")
    values = centroids.select("label", F.transform("levels", grid.value).alias("c"))
    least, most = values.agg(F.min(F.array_min("c")), F.max(F.array_max("c"))).first()
    small = Grid(least, most, bits)
    return Codebook(assigned.select("key", "label", "distance"), values.select("label", F.transform("c", small.level).alias("codes")), small, costs)


def decoded(book: Codebook, key: str = "gaussian_id", value: str = "v") -> DataFrame:
    """(key, value) of every labelled vector: its centroid, within half a step of the codes' grid."""
    centroids = book.codes.select("label", F.transform("codes", book.grid.value).alias(value))
    return book.labels.join(centroids, "label").select(F.col("key").alias(key), value)
