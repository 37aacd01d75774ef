"""Densification over steps: clone, split, prune and reset by screen slopes, or relocate, add and shake by draws.

A scene is a table of primitives with their running statistics (grad2d, seen, radius2d) and, in columns that begin with
``m1_`` or ``m2_``, the optimiser's moments.  Every other column, such as a flag of moving primitives, goes on to clones
and children.  A step is one pass over the table (and draws, where there are any), committed as a version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatloom.functions import rotation as R
from splatloom.sources.tables import written
from splatloom.sources.versions import Versions

from . import mutate

STATISTICS = ("grad2d", "seen", "radius2d")
#: A standard normal number for (key, step, slot); a uniform one in [0, 1) for draws.
Draw = Callable[[Column, int, int], Column]


def uniform(key: Column, step: int, slot: int) -> Column:
    """In [0, 1), from a hash: the same whenever and wherever it is computed."""
    return F.pmod(F.xxhash64(key, F.lit(step), F.lit(slot)), F.lit(1 << 53)) / float(1 << 53)


def normal(key: Column, step: int, slot: int) -> Column:
    """Box-Muller from two hashes."""
    return F.sqrt(-2 * F.log1p(-uniform(key, step, 2 * slot))) * F.cos(2 * F.pi() * uniform(key, step, 2 * slot + 1))


@dataclass(frozen=True)
class Slopes:
    """Thresholds of densification by screen slopes; sizes are shares of ``scene_scale``, radii of the image."""

    prune_opacity: float = 0.005
    grow_slope: float = 0.0002
    grow_size: float = 0.01
    grow_radius: float = 0.05
    prune_size: float = 0.1
    prune_radius: float = 0.15
    radius_until: int = 0
    start: int = 500
    stop: int = 15_000
    every: int = 100
    reset_every: int = 3000
    pause: int = 0
    revised_opacity: bool = False
    scene_scale: float = 1.0

    def refines(self, step: int) -> bool:
        return self.start < step < self.stop and step % self.every == 0 and step % self.reset_every >= self.pause

    def resets(self, step: int) -> bool:
        return 0 < step < self.stop and step % self.reset_every == 0


@dataclass(frozen=True)
class Draws:
    """Thresholds of refinement by draws."""

    most: int = 1_000_000
    noise: float = 5e5
    start: int = 500
    stop: int = 25_000
    noise_stop: int = -1
    every: int = 100
    least_opacity: float = 0.005
    noise_t: float = 0.005
    noise_k: float = 100.0
    growth: float = 1.05

    def refines(self, step: int) -> bool:
        return self.start < step < self.stop and step % self.every == 0


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with the statistics that they lack, at 0."""
    return rows.select("*", *[F.lit(0.0).alias(c) for c in STATISTICS if c not in rows.columns])


def _moments(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith(("m1_", "m2_"))]


def observed(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``rows`` with statistics to which those of a step are added: ``seen`` has gaussian_id, grad2d, n and radius, as
    ``composite.screen_gradients`` gives them."""
    new = seen.select("gaussian_id", F.col("grad2d").alias("_grad"), F.col("n").alias("_n"), F.col("radius").alias("_radius"))
    joined = rows.join(new, "gaussian_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fresh = {"grad2d": F.col("grad2d") + zero("_grad"), "seen": F.col("seen") + zero("_n"), "radius2d": F.greatest(F.col("radius2d"), zero("_radius"))}
    return joined.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in rows.columns])


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 0 in the order of ``keys``, which tell them apart.

    A range sort numbers rows within tasks; one row for each task tells where its numbers begin.
    """
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed = written(placed, "numbered")
    base = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return placed.join(F.broadcast(base.select("_part", "_base")), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")  # one row for each task


def grown(rows: DataFrame, by: Slopes, step: int, noise: Draw = normal) -> DataFrame:
    """``rows`` after growth and pruning, with statistics at 0.

    A primitive of mean slope over ``grow_slope`` is cloned if it is small and split if it is large; until ``radius_until``, a
    large radius splits too.  Children stand at standard normal places of the primitive, with sizes over 1.6.  Then
    faint primitives go, and, after the first reset, those too large.  Clones and children get new ids behind the
    largest, in order of their parent, and moments of 0; the ids of split primitives are not used again.
    """
    q, s = R.columns("qw", "qx", "qy", "qz"), R.columns(*[f"s{n}" for n in "xyz"])
    largest, high = F.greatest(*s), F.col("grad2d") / F.greatest(F.lit(1.0), F.col("seen")) > by.grow_slope
    small = largest <= by.grow_size * by.scene_scale
    splits = high & ~small
    if step < by.radius_until:
        splits = splits | (F.col("radius2d") > by.grow_radius)
    turn = R.rotation(R.normalised(q))
    opacity = 1 - F.sqrt(1 - F.col("opacity")) if by.revised_opacity else F.col("opacity")
    moments = _moments(rows)

    def version(kind: int) -> Column:
        """0: what stays, 1: the clone, 2 and 3: the children."""
        new: dict[str, Column] = {}
        if kind >= 2:
            move = R.apply(turn, tuple(x * noise(F.col("gaussian_id"), step, 3 * (kind - 2) + k) for k, x in enumerate(s)))
            new = {f"m{n}": F.col(f"m{n}") + d for n, d in zip("xyz", move, strict=True)} | {f"s{n}": x / mutate.SPLIT_SHRINK for n, x in zip("xyz", s, strict=True)}
            new["opacity"] = opacity
        if kind:
            new |= {c: F.lit(0.0) for c in moments}
        return F.struct(*[new.get(c, F.col(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(kind).alias("_kind"))

    none = F.array().cast(f"array<{rows.select(version(0).alias('v')).schema['v'].dataType.simpleString()}>")
    kept = F.when(splits, F.array(version(2), version(3))).otherwise(F.array(version(0)))
    out = rows.select(F.inline(F.concat(kept, F.when(high & small, F.array(version(1))).otherwise(none))))
    gone = F.col("opacity") < by.prune_opacity
    if step > by.reset_every:
        large = F.greatest(*s) > by.prune_size * by.scene_scale
        gone = gone | (large | (F.col("radius2d") > by.prune_radius) if step < by.radius_until else large)
    out = out.where(~F.coalesce(gone, F.lit(False))).withColumns({c: F.lit(0.0) for c in STATISTICS})
    return _renamed(out, rows)


def _renamed(out: DataFrame, rows: DataFrame) -> DataFrame:
    top = rows.agg(F.max("gaussian_id")).first()[0]
    old = out.where("_kind = 0").select(*rows.columns)
    new = numbered(out.where("_kind > 0"), ["gaussian_id", "_kind"], "_place")
    id_type = rows.schema["gaussian_id"].dataType
    return old.unionByName(new.select(*[(F.lit((top or 0) + 1) + F.col("_place")).cast(id_type).alias(c) if c == "gaussian_id" else F.col(c) for c in rows.columns]))


def reset(rows: DataFrame, by: Slopes) -> DataFrame:
    """``rows`` with opacities of twice the pruning threshold at most, and with the opacity's moments at 0."""
    new = {"opacity": F.least(F.col("opacity"), F.lit(2 * by.prune_opacity))} | {c: F.lit(0.0) for c in _moments(rows) if c.endswith("_opacity")}
    return rows.withColumns(new)


def slope_step(rows: DataFrame, step: int, seen: DataFrame, by: Slopes, noise: Draw = normal) -> DataFrame:
    """``rows`` after a step of densification by slopes; after ``by.stop``, as they were."""
    if step >= by.stop:
        return rows
    rows = observed(prepared(rows), seen)
    if by.refines(step):
        rows = grown(rows, by, step, noise)
    return reset(rows, by) if by.resets(step) else rows


def draw_step(rows: DataFrame, step: int, rate: float, by: Draws, share: Draw = uniform, noise: Draw = normal) -> DataFrame:
    """``rows`` after a step of refinement by draws: faint ones relocated, some added up to ``by.most``, all shaken.

    ``rate`` is the learning rate of centres.  Moments of drawn, moved and added rows are 0.
    """
    columns, moments = rows.columns, _moments(rows)
    fresh = lambda df: df.select(*[F.when(F.col("origin") == "kept", F.col(c)).otherwise(0.0).alias(c) if c in moments else F.col(c) for c in columns])
    if by.refines(step):
        rows = written(fresh(mutate.relocate(rows, F.col("opacity") <= by.least_opacity, share(F.col("gaussian_id"), step, 0), by.least_opacity)), "relocated")
        n, top = rows.agg(F.count("*"), F.max("gaussian_id")).first()
        more = max(0, min(by.most, int(by.growth * n)) - n)
        if more:
            ids = rows.sparkSession.range(top + 1, top + 1 + more).select(F.col("id").cast(rows.schema["gaussian_id"].dataType).alias("_new"))
            rows = fresh(mutate.sample_add(rows, ids.withColumn("_u", share(F.col("_new"), step, 1)), "_u", "_new", by.least_opacity))
    if by.noise_stop < 0 or step < by.noise_stop:
        key = F.col("gaussian_id")
        rows = mutate.noisy(rows, tuple(noise(key, step, k) for k in range(3)), rate * by.noise, by.noise_t, by.noise_k)
    return rows


def run(scene: Versions, first: DataFrame, steps: range, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The scene after ``steps``: each is committed as a version, and steps that are committed already are left alone.

    The first version, before ``steps``, is ``first``.
    """
    scene.commit(steps[0] - 1, lambda _: prepared(first))
    for k in steps:
        scene.commit(k, lambda rows, k=k: step(rows, k))
    return scene.at(steps[-1])
