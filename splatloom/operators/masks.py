"""Masks of images: union over frames, and dilation whose work does not grow with its radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(masks: DataFrame, value: str = "mask", keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``keys`` and the largest value that any frame has there, within [0, 1]; nulls are 0."""
    most = F.max(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    return masks.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), most)).alias(value))


def _along(rows: DataFrame, at: str, line: list[str], size: int, value: str) -> DataFrame:
    """Running maximum over ``size`` pixels around each, along a line of pixels at 0, 1, 2, ...

    Blocks of ``size`` pixels have running maxima from both of their ends; a window of that size meets at most two
    blocks, so two look-ups at its ends give its maximum.
    """
    reach = size // 2
    block = Window.partitionBy(*line, "_block").orderBy(at)
    rows = rows.withColumn("_block", F.floor(F.col(at) / size))
    rows = rows.withColumns({"_upto": F.max(value).over(block.rowsBetween(Window.unboundedPreceding, 0)), "_from": F.max(value).over(block.rowsBetween(0, Window.unboundedFollowing))})
    whole = Window.partitionBy(*line).orderBy(at)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"_right": F.lead("_upto", reach).over(whole), "_left": F.lag("_from", reach).over(whole), "_end": F.last("_upto").over(every), "_last": F.last("_block").over(every)}
    rows = rows.withColumns(ends)
    # Before the line's begin the right look-up is enough; beyond its end, the last pixel's, unless the left one reaches it.
    first = F.floor((F.col(at) - reach) / size)
    right = F.coalesce(F.col("_right"), F.when(F.col("_left").isNull() | (first < F.col("_last")), F.col("_end")))
    return rows.withColumn(value, F.greatest("_left", right)).drop("_block", "_upto", "_from", *ends)


def dilated(masks: DataFrame, size: int = 3, value: str = "mask", image: str = "camera_id") -> DataFrame:
    """``masks``, with a row for each pixel of each image, and the largest value of the ``size`` x ``size`` pixels around each.

    ``size`` is odd; pixels outside the image count as none.  Rows first, then columns.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError(f"the size of a dilation is odd and positive, not {size}")
    if size == 1:
        return masks
    rows = _along(masks, "x", [image, "y"], size, value)
    return _along(rows, "y", [image, "x"], size, value)
