"""Filters of the scene table; all are plain predicates or joins, so they reach the scan where they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, *names: str) -> DataFrame:
    """Rows in which none of the columns is null, NaN or infinite."""
    tests = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf")) for n in names]
    return rows.where(reduce(lambda a, b: a & b, tests))


def inside_box(rows: DataFrame, names: tuple[str, ...], low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Rows whose columns lie in [low, high], ends included."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(n).between(a, b) for n, a, b in zip(names, low, high, strict=True)]))


def of_components(rows: DataFrame, listed: DataFrame, key: str = "component_id", inside: bool = True) -> DataFrame:
    """Rows whose component is listed, or isn't."""
    return rows.join(listed.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def difference(ids: DataFrame, used: DataFrame) -> DataFrame:
    """The distinct ids that ``used`` doesn't have."""
    return ids.distinct().join(used.distinct(), ids.columns, "left_anti")


def subset(rows: DataFrame, key: str, share: float) -> DataFrame:
    """About ``share`` of the rows, drawn by a multiplicative hash of a whole-number key: the same ones in each run."""
    slots = 1 << 20
    return rows.where(F.pmod(F.pmod(F.col(key).cast("long"), F.lit(slots)) * 2654435761, F.lit(slots)) < int(share * slots))
