"""Least squares in the engine: normal equations as one aggregate, solved by elimination, many small systems at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.sources.tables import written

from .project import computed

#: A pivot below this share of its diagonal entry counts as none: its unknown is 0.
PIVOT_LEAST = 1e-12


def normal_equations(rows: DataFrame, keys: list[str], features: list[Column], target: Column) -> DataFrame:
    """``keys``, a<i>_<j> (i <= j): sums of products of features, and b<i>: sums of each with the target."""
    n = range(len(features))
    named = rows.select(*keys, *[f.alias(f"_f{i}") for i, f in enumerate(features)], target.alias("_t"))
    sums = [F.sum(F.col(f"_f{i}") * F.col(f"_f{j}")).alias(f"a{i}_{j}") for i in n for j in n if i <= j]
    return named.groupBy(*keys).agg(*sums, *[F.sum(F.col(f"_f{i}") * F.col("_t")).alias(f"b{i}") for i in n])


def solved(equations: DataFrame, keys: list[str], n: int, ridge: float = 0.0) -> DataFrame:
    """``keys`` and w0..w<n-1>: the solution of each row's symmetric system, with ``ridge`` added to the diagonal.

    Systems are small rows, one for each group; an Arrow batch of them is eliminated at once.
    """
    names = [f"a{i}_{j}" for i in range(n) for j in range(i, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, side = np.zeros((batch.num_rows, n, n)), np.stack([batch.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(n)], axis=1)
            for name in names:
                i, j = map(int, name[1:].split("_"))
                matrix[:, i, j] = matrix[:, j, i] = batch.column(name).to_numpy(zero_copy_only=False)
            found = eliminated(matrix + ridge * np.eye(n), side)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(found[:, i]) for i in range(n))], [*keys, *(f"w{i}" for i in range(n))])

    schema = ", ".join([*(f"`{k}` {equations.schema[k].dataType.simpleString()}" for k in keys), *(f"w{i} double" for i in range(n))])
    return equations.select(*keys, *names, *[f"b{i}" for i in range(n)]).mapInArrow(run, schema)


def eliminated(matrix: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems (m, n, n) x = (m, n); an unknown whose pivot vanishes is 0."""
    matrix, x, n = matrix.astype(float), side.astype(float), side.shape[1]
    size = matrix[:, range(n), range(n)]
    for k in range(n):
        real = matrix[:, k, k] > PIVOT_LEAST * size[:, k]
        pivot = np.where(real, matrix[:, k, k], 1.0)
        share = np.where(real[:, None], matrix[:, k] / pivot[:, None], 0.0)
        for i in range(k + 1, n):
            matrix[:, i] -= share[:, i, None] * matrix[:, k]
            x[:, i] -= share[:, i] * x[:, k]
        matrix[:, k], x[:, k] = share, np.where(real, x[:, k] / pivot, 0.0)
    for k in range(n - 1, -1, -1):
        x[:, k] -= (matrix[:, k, k + 1 :] * x[:, k + 1 :]).sum(axis=1)
    return x


def _expanded(channels: list[Column]) -> list[Column]:
    """All products of two channels, the channels, and 1."""
    return [a * b for i, a in enumerate(channels) for b in channels[i:]] + channels + [F.lit(1.0)]


def quadratic_correction(image: DataFrame, channels: list[str], references: list[str], rounds: int = 5, margin: float = 0.5 / 255, key: str = "camera_id") -> DataFrame:
    """``image`` with ``corrected_<channel>``: the quadratic map of all channels that comes nearest to each reference.

    Each round fits the map to the pixels that are clipped neither in the image, nor in the last round's result, nor in the
    reference, applies it to the last result and clips to [0, 1].  A channel without such pixels becomes 0.  Only each
    image's coefficients are written between rounds; pixels are mapped again from the start.
    """
    n = len(channels) * (len(channels) + 3) // 2 + 1
    open_ = lambda c: (c >= margin) & (c <= 1 - margin)
    at = [f"corrected_{c}" for c in channels]
    rows = image.withColumns({a: F.col(c) for a, c in zip(at, channels, strict=True)})
    for _ in range(rounds):
        usable = [F.when(open_(F.col(c)) & open_(F.col(a)) & open_(F.col(r)), F.struct(F.lit(i).alias("i"), F.col(r).alias("t"))) for i, (c, a, r) in enumerate(zip(channels, at, references, strict=True))]
        targets = rows.select(key, *at, F.explode(F.array(*usable)).alias("_u")).where("_u is not null").select(key, *at, "_u.i", "_u.t")
        equations = normal_equations(targets, [key, "i"], _expanded([F.col(a) for a in at]), F.col("t"))
        fit = solved(equations, [key, "i"], n).select(key, "i", F.array(*[f"w{k}" for k in range(n)]).alias("w"))
        fit = written(fit.groupBy(key).agg(*[F.max(F.when(F.col("i") == i, F.col("w"))).alias(f"_w{i}") for i in range(len(channels))]), "colours")
        terms = _expanded([F.col(a) for a in at])
        mapped = []
        for i in range(len(channels)):
            total = sum((F.get(f"_w{i}", F.lit(k)) * t for k, t in enumerate(terms)), F.lit(0.0))
            mapped.append(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), F.lit(0.0)))
        rows = computed(rows.join(fit, key, "left"), *[F.col(c) for c in rows.columns if c not in at], *[m.alias(a) for m, a in zip(mapped, at, strict=True)])
    return rows


def inverse_polynomials(lenses: DataFrame, key: str, order: int = 5, samples: int = 1000, ridge: float = 1e-10) -> DataFrame:
    """``key``, k1..k<order>, ``error`` and ``fits`` of each lens (key, f0..f<order>, low, high).

    The polynomial without constant term that gives x back from f(x), fitted at ``samples`` even places of [low, high].
    ``error`` is its largest miss at about a hundred of these; it ``fits`` if that is at most a thousandth of the range.
    """
    def value(x: Column, names: list[Column]) -> Column:
        out = names[-1]
        for c in reversed(names[:-1]):
            out = out * x + c
        return out

    places = lenses.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_n"))
    places = places.select(key, "_n", "low", "high", *[f"f{k}" for k in range(order + 1)], (F.col("low") + (F.col("high") - F.col("low")) * F.col("_n") / (samples - 1)).alias("_x"))
    places = computed(places, key, "_n", "low", "high", "_x", value(F.col("_x"), [F.col(f"f{k}") for k in range(order + 1)]).alias("_y"))
    powers = [F.col("_y")]
    for _ in range(order - 1):
        powers.append(powers[-1] * F.col("_y"))
    fit = solved(normal_equations(places, [key], powers, F.col("_x")), [key], order, ridge)
    tested = places.where(F.pmod("_n", F.lit(max(1, samples // 100))) == 0).join(fit, key)
    miss = F.abs(value(F.col("_y"), [F.lit(0.0), *[F.col(f"w{k}") for k in range(order)]]) - F.col("_x"))
    names = [f"w{k}" for k in range(order)]
    found = tested.groupBy(key, *names).agg(F.max(miss).alias("error"), F.max(F.col("high") - F.col("low")).alias("_range"))
    return found.select(key, *[F.col(f"w{k}").alias(f"k{k + 1}") for k in range(order)], "error", (F.col("error") <= F.col("_range") / 1000).alias("fits"))
