"""Steps of densification over versions of a scene, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import strategies as S
from splatloom.sources import views as V
from splatloom.sources.tables import shared_folder
from splatloom.sources.versions import Versions

from .common import r4
from .mutations import _DRAW, _TABLE

SLOPES = S.Slopes(prune_opacity=0.15, grow_slope=0.5, grow_size=0.1, prune_size=0.3, grow_radius=0.9, prune_radius=0.95, radius_until=6, start=0, every=2, reset_every=4, stop=7)
DRAWS = S.Draws(most=10**9, noise=20.0, start=0, every=1, stop=2, least_opacity=0.1, noise_t=0.4, noise_k=10.0)
_KEPT = ("mx", "my", "mz", "sx", "sy", "sz", "opacity")


def _mixed(key: Column, step: int, slot: int) -> Column:
    """A number in [0, 1) that SQL gives too."""
    return F.pmod(key * 7919 + step * 104729 + slot * 1299709, F.lit(10007)) / 10007.0


def _centred(key: Column, step: int, slot: int) -> Column:
    return 2 * _mixed(key, step, slot) - 1


def _scene(spark: SparkSession, folder: str) -> DataFrame:
    return V.gaussians(spark, folder).select("gaussian_id", "component_id", "mx", "my", "mz", "qw", "qx", "qy", "qz", "sx", "sy", "sz", "opacity")


def _versions(spark: SparkSession) -> Versions:
    return Versions(spark, f"{shared_folder(spark)}/scene-{uuid.uuid4().hex}")


def densify_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The scene after six steps: growth at the second, fourth and sixth, a reset of opacities at the fourth."""

    def step(rows: DataFrame, k: int) -> DataFrame:
        seen = rows.where(F.pmod("gaussian_id", F.lit(5)) > 0).select("gaussian_id", _mixed(F.col("gaussian_id"), k, 7).alias("grad2d"), F.lit(1).alias("n"), _mixed(F.col("gaussian_id"), k, 11).alias("radius"))
        return S.slope_step(rows, k, seen, SLOPES, _centred)

    done = S.run(_versions(spark), _scene(spark, folder), range(1, 7), step)
    return done.select("gaussian_id", "component_id", "seen", *[r4(c).alias(c) for c in (*_KEPT, "grad2d", "radius2d")])


def draw_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The scene after a step that relocates, adds and shakes, and two that only shake."""
    done = S.run(_versions(spark), _scene(spark, folder), range(1, 4), lambda rows, k: S.draw_step(rows, k, 0.05, DRAWS, _mixed, _centred))
    return done.select("gaussian_id", *[r4(c).alias(c) for c in _KEPT])


QUERIES = {f.__name__: f for f in (densify_steps, draw_steps)}

_MIX = lambda key, step, slot: f"((({key})*7919 + {step * 104729 + slot * 1299709}) % 10007)/10007::double"
_ROT = [["1 - 2*(qy*qy + qz*qz)", "2*(qx*qy - qw*qz)", "2*(qx*qz + qw*qy)"], ["2*(qx*qy + qw*qz)", "1 - 2*(qx*qx + qz*qz)", "2*(qy*qz - qw*qx)"], ["2*(qx*qz - qw*qy)", "2*(qy*qz + qw*qx)", "1 - 2*(qx*qx + qy*qy)"]]
_COLUMNS = "gaussian_id, component_id, mx, my, mz, qw, qx, qy, qz, sx, sy, sz, opacity"


def _slope_step(k: int) -> str:
    """CTEs from z<k-1> to z<k>."""
    by = SLOPES
    out = f"""a{k} as (select {_COLUMNS}, grad2d + case when gaussian_id % 5 > 0 then {_MIX('gaussian_id', k, 7)} else 0 end as grad2d, seen + (gaussian_id % 5 > 0)::int as seen,
  greatest(radius2d, case when gaussian_id % 5 > 0 then {_MIX('gaussian_id', k, 11)} else 0 end) as radius2d from z{k - 1})"""
    last = f"a{k}"
    if by.refines(k):
        spread = lambda i, c: " + ".join(f"({_ROT[i][j]})*s{n}*(2*{_MIX('gaussian_id', k, 3 * c + j)} - 1)" for j, n in enumerate("xyz"))
        child = lambda c: ", ".join(f"m{n} + {spread(i, c)} as m{n}" for i, n in enumerate("xyz")) + ", " + ", ".join(f"s{n}/1.6::double as s{n}" for n in "xyz")
        size = f"greatest(sx, sy, sz) > {by.prune_size}::double" + (f" or radius2d > {by.prune_radius}::double" if k < by.radius_until else "")
        gone = f"opacity < {by.prune_opacity}::double" + (f" or {size}" if k > by.reset_every else "")
        wide = f" or radius2d > {by.grow_radius}::double" if k < by.radius_until else ""
        out += f""", h{k} as (select *, grad2d/greatest(1, seen) > {by.grow_slope}::double and greatest(sx, sy, sz) <= {by.grow_size}::double as dup, (grad2d/greatest(1, seen) > {by.grow_slope}::double and greatest(sx, sy, sz) > {by.grow_size}::double){wide} as cut from a{k}),
g{k} as (select *, 0 as kind from h{k} where not cut union all select *, 1 from h{k} where dup union all select * replace ({child(0)}), 2 from h{k} where cut union all select * replace ({child(1)}), 3 from h{k} where cut),
l{k} as (select * from g{k} where not ({gone})),
n{k} as (select case when kind = 0 then gaussian_id else (select max(gaussian_id) from a{k}) + row_number() over (partition by kind > 0 order by gaussian_id, kind) end as gaussian_id, {_COLUMNS.removeprefix('gaussian_id, ')}, 0::double as grad2d, 0::double as seen, 0::double as radius2d from l{k})"""
        last = f"n{k}"
    opacity = f"least(opacity, {2 * by.prune_opacity}::double)" if by.resets(k) else "opacity"
    return f"{out}, z{k} as materialized (select * replace ({opacity} as opacity) from {last})"


def _shaken(source: str, step: int) -> str:
    cov = lambda i, j: "(" + " + ".join(f"({_ROT[i][k]})*({_ROT[j][k]})*s{n}*s{n}" for k, n in enumerate("xyz")) + ")"
    moves = ", ".join(f"m{n} + {0.05 * DRAWS.noise}/(1 + exp({DRAWS.noise_k}::double*(opacity - {DRAWS.noise_t}::double)))*({' + '.join(f'{cov(i, j)}*(2*{_MIX("gaussian_id", step, j)} - 1)' for j in range(3))}) as m{n}" for i, n in enumerate("xyz"))
    return f"select * replace ({moves}) from {source}"


_FULL = "mx, my, mz, opacity, sx, sy, sz"
_TURNED = lambda draw: draw.replace("select gaussian_id, case when copies is null then 'kept' else 'drawn' end as origin,", "select gaussian_id, case when copies is null then 'kept' else 'drawn' end as origin, qw, qx, qy, qz,")
_STEP = lambda alive, draws, moved: _TURNED(_DRAW).format(alive=alive, draws=draws, table=_TABLE, all=f"{_FULL}, qw, qx, qy, qz", moved=moved)
_SHOWN = ", ".join(f"round({c}, 4) + 0 as {c}" for c in _KEPT)
SQL = {
    "densify_steps": f"with {V.GAUSSIANS}, z0 as (select {_COLUMNS}, 0::double as grad2d, 0::double as seen, 0::double as radius2d from gaussians), {', '.join(_slope_step(k) for k in range(1, 7))} select gaussian_id, component_id, seen, {_SHOWN}, round(grad2d, 4) + 0 as grad2d, round(radius2d, 4) + 0 as radius2d from z6",
    "draw_steps": f"""with {V.GAUSSIANS}, alive as (select * from gaussians where not opacity <= {DRAWS.least_opacity}::double), dead as (select gaussian_id as id, {_MIX('gaussian_id', 1, 0)} as share from gaussians where opacity <= {DRAWS.least_opacity}::double),
moved as materialized (with {_STEP('alive', 'dead', 'moved').replace('0.005::double', f'{DRAWS.least_opacity}::double')}),
more as (select top + i as id, {_MIX('top + i', 1, 1)} as share from (select max(gaussian_id) as top, floor({DRAWS.growth}::double*count(*))::bigint - count(*) as n from moved), range(1, 100000) r(i) where i <= n),
added as materialized (with {_STEP('moved', 'more', 'added').replace('0.005::double', f'{DRAWS.least_opacity}::double')}),
s1 as ({_shaken('added', 1)}), s2 as ({_shaken('s1', 2)}), s3 as ({_shaken('s2', 3)}) select gaussian_id, {_SHOWN} from s3""",
}
