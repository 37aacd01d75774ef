"""Mutations of the scene table and of the state beside it: clone, split, prune, relocate, optimise."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

#: Shrinkage of split children and the most copies in a relocation.
SPLIT_SHRINK, MOST_COPIES = 1.6, 51


def duplicate(rows: DataFrame, test: Column) -> DataFrame:
    """``rows`` and a copy of those that pass, marked in ``origin`` as kept or clone."""
    return rows.withColumn("origin", F.lit("kept")).unionByName(rows.where(test).withColumn("origin", F.lit("clone")))


def split(rows: DataFrame, test: Column, offset: float = 0.5) -> DataFrame:
    """Rows that pass become two children at mean +- R s offset with scales over 1.6; the others stay.

    One pass over the table: a row becomes an array of what stays of it.
    """
    q, s = R.columns("qw", "qx", "qy", "qz"), R.columns("sx", "sy", "sz")
    move = R.apply(R.rotation(q), tuple(x * offset for x in s))
    changed = {"mx", "my", "mz", "sx", "sy", "sz"}

    def version(sign: int) -> Column:
        new = {n: F.col(n) + sign * m for n, m in zip(("mx", "my", "mz"), move, strict=True)} | {n: F.col(n) / SPLIT_SHRINK for n in ("sx", "sy", "sz")}
        return F.struct(*[(new[c] if sign and c in changed else F.col(c)).alias(c) for c in rows.columns], F.lit(sign).alias("child"))

    return rows.select(F.inline(F.when(test, F.array(version(1), version(-1))).otherwise(F.array(version(0)))))


def reset_opacity(rows: DataFrame, value: float) -> DataFrame:
    """Opacities clamped from above, in logits."""
    logit = F.ln(F.col("opacity") / (1 - F.col("opacity")))
    return rows.withColumn("logit", F.least(logit, F.ln(F.lit(value / (1 - value)))))


def relocated(opacity: Column, copies: Column, least: float = 0.005) -> tuple[Column, Column]:
    """(opacity, scale factor) of each of ``copies`` primitives that together look like one.

    o' = 1 - (1 - o)**(1/n), at least ``least`` and less than 1 by a 32-bit step; the factor is o over
    the sum over i = 1..n, k = 0..i-1 of C(i-1, k) (-1)**k o'**(k+1) / sqrt(k+1).  The inner sums over
    i collapse to C(n, k+1).
    """
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), copies))
    new = F.least(F.greatest(1 - F.pow(1 - opacity, 1 / n), F.lit(least)), F.lit(1 - 2.0**-23))
    table = F.array(*[F.array(*[F.lit(float(comb(m, k + 1)) * (-1.0) ** k / (k + 1) ** 0.5) for k in range(m)]) for m in range(1, MOST_COPIES + 1)])
    terms = F.transform(F.element_at(table, n.cast("int")), lambda c, k: c * F.pow(new, k + 1))
    return new, opacity / F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def drawn_by_weight(rows: DataFrame, weight: Column, draws: DataFrame, share: str, key: str = "gaussian_id") -> DataFrame:
    """``draws`` with ``source``: the key of the row of ``rows`` in which its ``share`` in [0, 1) of the whole weight falls.

    Sampling with replacement; keys are whole numbers.  Rows are dealt into ranges of their key's
    remainder; running sums go over the ranges and then within each, where one ordered pass gives
    each draw the row that begins last before it.  Rows without weight are never drawn.
    """
    spans = 1 << 10
    placed = rows.where(weight > 0).select(F.col(key).alias("source"), weight.alias("_w"), F.pmod(F.col(key), F.lit(spans)).alias("_range"))
    ranges = placed.groupBy("_range").agg(F.sum("_w").alias("_all"))
    upto = F.sum("_all").over(Window.orderBy("_range"))  # one row for each range
    ranges = ranges.select("_range", (upto - F.col("_all")).alias("_low"), upto.alias("_high"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    at = F.col(share) * F.col("_total")
    met = draws.join(F.broadcast(ranges), (at >= F.col("_low")) & (at < F.col("_high")))  # at most ``spans`` rows
    drawn = met.select("_range", at.alias("_at"), F.lit(1).alias("_kind"), F.struct(*draws.columns).alias("_draw"))
    begins = F.col("_low") + F.sum("_w").over(Window.partitionBy("_range").orderBy("source")) - F.col("_w")
    steps = placed.join(F.broadcast(ranges.select("_range", "_low")), "_range").select("_range", begins.alias("_at"), F.lit(0).alias("_kind"), "source")
    last = F.last("source", ignorenulls=True).over(Window.partitionBy("_range").orderBy("_at", "_kind", "source"))
    both = steps.unionByName(drawn, allowMissingColumns=True)
    return both.withColumn("source", last).where("_kind = 1").select("_draw.*", "source")


def relocate(rows: DataFrame, dead: Column, share: Column, least: float = 0.005, key: str = "gaussian_id") -> DataFrame:
    """``rows`` in which each dead one stands at a living one drawn by opacity, and both share its looks.

    ``share`` in [0, 1) is each dead row's draw.  A drawn row and its copies get the opacity and the
    scales of ``relocated``; ``origin`` tells kept, drawn and moved rows, and the state of drawn ones is to be reset.
    """
    marked = rows.withColumn("_dead", F.coalesce(dead, F.lit(False)))
    alive = marked.where("not _dead")
    draws = marked.where("_dead").select(F.col(key).alias("_id"), share.alias("_share"))
    drawn = drawn_by_weight(alive, F.col("opacity"), draws, "_share", key)
    counts = drawn.groupBy("source").agg((F.count("*") + 1).alias("_n"))
    opacity, factor = relocated(F.col("opacity"), F.col("_n"), least)
    new = {"opacity": opacity} | {s: F.col(s) * factor for s in ("sx", "sy", "sz")}
    source = alive.join(counts, F.col(key) == F.col("source"), "left").drop("source", "_dead")
    source = source.select(*[F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns], F.when(F.col("_n").isNotNull(), "drawn").otherwise("kept").alias("origin"))
    moved = drawn.join(source.where("origin = 'drawn'"), F.col(key) == F.col("source"))
    moved = moved.select(*[F.col("_id").alias(c) if c == key else F.col(c) for c in rows.columns], F.lit("moved").alias("origin"))
    return source.unionByName(moved)


def sample_add(rows: DataFrame, draws: DataFrame, share: str, new_key: str, least: float = 0.005, key: str = "gaussian_id") -> DataFrame:
    """``rows`` and a new one for each draw, at a row drawn by opacity; drawn and new ones share its looks (see ``relocate``)."""
    drawn = drawn_by_weight(rows, F.col("opacity"), draws.select(F.col(new_key).alias("_id"), F.col(share).alias("_share")), "_share", key)
    counts = drawn.groupBy("source").agg((F.count("*") + 1).alias("_n"))
    opacity, factor = relocated(F.col("opacity"), F.col("_n"), least)
    new = {"opacity": opacity} | {s: F.col(s) * factor for s in ("sx", "sy", "sz")}
    old = rows.join(counts, F.col(key) == F.col("source"), "left").drop("source")
    old = old.select(*[F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns], F.when(F.col("_n").isNotNull(), "drawn").otherwise("kept").alias("origin"))
    added = drawn.join(old.where("origin = 'drawn'"), F.col(key) == F.col("source"))
    return old.unionByName(added.select(*[F.col("_id").alias(c) if c == key else F.col(c) for c in rows.columns], F.lit("added").alias("origin")))


def noisy(rows: DataFrame, noise: tuple[Column, Column, Column], scale: float, t: float = 0.005, k: float = 100.0) -> DataFrame:
    """``rows`` whose centres are moved by the covariance times standard normal ``noise``, the more the fainter they are."""
    body = R.symmetric(R.covariance(R.rotation(R.columns("qw", "qx", "qy", "qz")), R.columns("sx", "sy", "sz")))
    faint = scale / (1 + F.exp(k * (F.col("opacity") - t)))
    move = R.apply(body, tuple(n * faint for n in noise))
    return rows.withColumns({m: F.col(m) + d for m, d in zip(("mx", "my", "mz"), move, strict=True)})


def bincount(rows: DataFrame, value: str, size: int) -> DataFrame:
    """(value, n) for every value from 0 to size - 1."""
    whole = rows.sparkSession.range(size).withColumnRenamed("id", "value")
    counts = rows.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return whole.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def selective_adam(value: Column, grad: Column, first: Column, second: Column, visible: Column, rate: float = 0.01, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-15) -> tuple[Column, Column, Column]:
    """(value, first, second moment) after a step without bias correction; rows that aren't visible stay as they are."""
    m = beta1 * first + (1 - beta1) * grad
    v = beta2 * second + (1 - beta2) * grad * grad
    pick = lambda new, old: F.when(visible, new).otherwise(old)
    return pick(value - rate * m / (F.sqrt(v) + eps), value), pick(m, first), pick(v, second)
