"""Exact quantiles of any number of rows: sketches bracket the rank, exact counts check the bracket, few rows are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatloom.sources.tables import written

#: Rows of a group that are ordered at last, and steps of the grid of a sketch.
BOUND, GRID = 100_000, 100


def exact_quantiles(rows: DataFrame, keys: list[str], values: list[str], share: float = 0.5, rounds: int = 8) -> DataFrame:
    """``keys`` and the ``share`` quantile of each of ``values``, with linear interpolation between neighbours.

    Nulls and NaN do not count; a group without any value has null.  Each round asks a mergeable sketch of the rows that are
    left for a grid of quantiles, takes the steps around the rank, and counts exactly what lies below and within;
    where the sketch was off, the side stays as it was.  Outliers and skewed values only change where the steps lie.
    Rounds end when no group has more than BOUND rows left or none got smaller; ties count as one value then.
    ``rows`` are read several times and must have the same values each time; values that follow from means or sums are written first.
    """
    what = [*keys, "_which"]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("_which"), F.col(v).cast("double").alias("_v")) for v in values]))
    long = rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.*").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    exact = F.lit(share) * (F.col("_m") - 1)
    state = long.groupBy(*what).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = written(state.select(*what, "_lo", "_hi", "_m", F.lit(0).cast("long").alias("_below"), F.floor(exact).alias("_a"), F.ceil(exact).alias("_b"), (exact - F.floor(exact)).alias("_part")), "ranks")
    join = lambda s: long.join(s, [F.equal_null(long[k], s[k]) for k in what]).select(*[s[k] for k in what], "_v", *[c for c in s.columns if c not in what])
    left = None
    for _ in range(rounds):
        most, total = state.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_m"))), F.sum("_m")).first()
        if not most or most <= BOUND or left is not None and total >= left:
            break
        left = total
        inside = join(state).where("_v >= _lo and _v <= _hi")
        grid = inside.groupBy(*what).agg(F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], 10 * GRID).alias("_q"))
        asked = state.join(grid.withColumnsRenamed({k: f"_g{k}" for k in what}), [F.equal_null(F.col(k), F.col(f"_g{k}")) for k in what])
        step = lambda rank: F.floor((F.col(rank) - F.col("_below")) / F.col("_m") * GRID).cast("int")
        near = F.get("_q", F.greatest(F.lit(0), step("_a") - 1)), F.get("_q", F.least(F.lit(GRID), step("_b") + 2))
        asked = asked.select(*state.columns, near[0].alias("_l"), near[1].alias("_h"))
        within = join(asked).where("_v >= _lo and _v <= _hi").groupBy(*asked.columns)
        found = within.agg(F.count_if(F.col("_v") < F.col("_l")).alias("_under"), F.count_if(F.col("_v") <= F.col("_h")).alias("_upto"))
        low, high = F.col("_below") + F.col("_under") <= F.col("_a"), F.col("_below") + F.col("_upto") > F.col("_b")
        under, upto = F.when(low, F.col("_under")).otherwise(0), F.when(high, F.col("_upto")).otherwise(F.col("_m"))
        new = [F.when(low, F.col("_l")).otherwise(F.col("_lo")).alias("_lo"), F.when(high, F.col("_h")).otherwise(F.col("_hi")).alias("_hi"), (upto - under).alias("_m"), (F.col("_below") + under).alias("_below")]
        state = written(found.select(*what, *new, "_a", "_b", "_part"), "ranks")
    counts = join(state).where("_v >= _lo and _v <= _hi").groupBy(*what, "_v", "_below", "_a", "_b", "_part").agg(F.count("*").alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*what).orderBy("_v"))
    placed = counts.withColumn("_upto", upto).groupBy(*what, "_part").agg(*[F.min(F.when(F.col("_upto") > F.col(r), F.col("_v"))).alias(f"_v{r}") for r in ("_a", "_b")])
    value = F.when(F.col("_part") > 0, F.col("_v_a") + F.col("_part") * (F.col("_v_b") - F.col("_v_a"))).otherwise(F.col("_v_a"))
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == v, value)).alias(v) for v in values])
