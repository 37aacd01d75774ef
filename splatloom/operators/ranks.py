"""Ranks over large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of the histogram between a group's least and greatest value.
SLOTS = 4096


def smallest(rows: DataFrame, value: Column, k: Column | int, tie: str, by: str | None = None) -> DataFrame:
    """The ``k`` rows of the smallest value (of each group ``by``), ties by ``tie``.

    A histogram of the values, with at most ``SLOTS`` rows for each group, finds the slot in which
    the k-th row lies.  Rows of lower slots go in without being ordered; only that slot is ranked.
    ``k`` may use the group's column ``_n``, its number of rows.
    """
    keys = [by] if by else []
    placed = rows.withColumn("_v", value)
    ends = placed.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    same = [rows[by].eqNullSafe(ends[by])] if by else [F.lit(True)]
    placed = placed.join(F.broadcast(ends) if not by else ends, same[0]).drop(*[ends[c] for c in keys])
    span = F.col("_high") - F.col("_low")
    slot = F.when(span > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / span * SLOTS), F.lit(SLOTS - 1))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumns({"_slot": slot, "_k": F.lit(k) if isinstance(k, int) else k})
    counts = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_c"), F.first("_k").alias("_k"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_slot")  # a row for each slot
    counts = counts.withColumn("_until", F.sum("_c").over(order))
    cut = counts.where("_until >= _k").groupBy(*keys).agg(F.min(F.struct("_slot", "_until", "_c")).alias("_cut"))
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_cut._slot").alias("_at"), (F.col("_cut._until") - F.col("_cut._c")).alias("_before"))
    met = placed.join(F.broadcast(cut) if not by else cut, placed[by].eqNullSafe(cut[f"_{by}"]) if by else F.lit(True), "left")
    sure = met.where("_at is null or _slot < _at").select(*rows.columns)
    edge = met.where("_slot = _at").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy("_v", tie)) + F.col("_before"))
    return sure.unionByName(edge.where("_r <= _k").select(*rows.columns))
