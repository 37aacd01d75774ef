"""Least squares and masks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import fitting, masks
from splatloom.sources import views as V
from splatloom.sources.tables import written

from . import rendering
from .common import r4

ROUNDS, SIZE = 2, 9


def color_quadratic(spark: SparkSession, folder: str) -> DataFrame:
    """Each camera's image corrected towards a version of itself with curved and exchanged channels."""
    image = rendering.composite_rgb(spark, folder).withColumns({"d0": F.sqrt("c1") * 0.7 + 0.1, "d1": F.exp(-2 * F.col("c2")) * 0.9, "d2": F.sin(2 * F.col("c0")) * 0.6 + 0.2 * F.sqrt("c1")})
    found = fitting.quadratic_correction(written(image, "image"), ["c0", "c1", "c2"], ["d0", "d1", "d2"], ROUNDS)
    return found.select("camera_id", "x", "y", *[F.round(f"corrected_c{k}", 3).alias(f"c{k}") for k in range(3)])


def inverse_polynomial_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse polynomials of a lens for each supplier: what three heights on the sensor give, and whether the fit holds."""
    bend = F.col("s_acctbal").cast("double") / 100_000
    rows = V.table(spark, folder, "supplier").select("s_suppkey", F.lit(0.0).alias("f0"), (1 + bend / 10).alias("f1"), F.lit(0.0).alias("f2"), (bend - 0.05).alias("f3"), F.lit(0.0).alias("f4"), (bend / 4).alias("f5"), F.lit(0.0).alias("low"), F.lit(1.1).alias("high"))
    found = fitting.inverse_polynomials(rows, "s_suppkey", samples=200)
    at = lambda y: sum(F.col(f"k{k}") * y**k for k in range(1, 6))
    return found.select("s_suppkey", "fits", *[r4(at(y)).alias(f"x{i}") for i, y in enumerate((0.2, 0.5, 0.9))])


def occlusion_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels within four of any that any camera covers by more than 0.9, with the number of cameras near."""
    covered = rendering.composite_rgb(spark, folder).select("camera_id", "x", "y", F.when(F.col("alpha") > 0.9, 1.0).otherwise(0.0).alias("mask"))
    near = written(masks.dilated(covered, SIZE), "near")
    counts = near.groupBy("x", "y").agg(F.sum("mask").cast("long").alias("cameras"))
    return masks.union(near).join(counts, ["x", "y"]).select("x", "y", "mask", "cameras")


QUERIES = {f.__name__: f for f in (color_quadratic, inverse_polynomial_fit, occlusion_mask)}


def _eliminated(name: str, source: str, keys: str, n: int, ridge: str = "0") -> str:
    """CTEs from sums in ``source`` (a<i>_<j>, b<i>) to ``name`` with w<i>: one for each unknown there, one for each back."""
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out = [f"{name}_0 as (select * replace ({', '.join(f'a{i}_{i} + {ridge} as a{i}_{i}' for i in range(n))}), {', '.join(f'a{i}_{i} + {ridge} as s{i}' for i in range(n))} from {source})"]
    for k in range(n):
        share = lambda i, k=k: f"case when {at(k, k)} > 1e-12*s{k} then {at(k, i)}/{at(k, k)} else 0 end"
        new = [f"{share(i)} as {at(k, i)}" for i in range(k + 1, n)] + [f"case when {at(k, k)} > 1e-12*s{k} then b{k}/{at(k, k)} else 0 end as b{k}"]
        for i in range(k + 1, n):
            new += [f"{at(i, j)} - ({share(i)})*{at(k, j)} as {at(i, j)}" for j in range(i, n)] + [f"b{i} - ({share(i)})*b{k} as b{i}"]
        out.append(f"{name}_{k + 1} as (select * replace ({', '.join(new)}) from {name}_{k})")
    for m, k in enumerate(range(n - 1, -1, -1)):
        out.append(f"{name}_{n + m + 1} as (select * replace (b{k} - ({' + '.join(['0'] + [f'{at(k, i)}*b{i}' for i in range(k + 1, n)])}) as b{k}) from {name}_{n + m})")
    return ", ".join(out) + f", {name} as materialized (select {keys}, {', '.join(f'b{i} as w{i}' for i in range(n))} from {name}_{2 * n})"


def _sums(features: list[str], target: str) -> str:
    n = range(len(features))
    return ", ".join([f"sum(({features[i]})*({features[j]})) as a{i}_{j}" for i in n for j in n if i <= j] + [f"sum(({features[i]})*({target})) as b{i}" for i in n])


_FEATURES = ["e0*e0", "e0*e1", "e0*e2", "e1*e1", "e1*e2", "e2*e2", "e0", "e1", "e2", "1::double"]
_FREE = lambda c: f"{c} >= {0.5 / 255!r}::double and {c} <= {1 - 0.5 / 255!r}::double"


def _correction() -> str:
    out = [f"r0 as materialized (select camera_id, x, y, c0, c1, c2, c0 as e0, c1 as e1, c2 as e2, sqrt(c1)*0.7::double + 0.1::double as d0, exp(-2*c2)*0.9::double as d1, sin(2*c0)*0.6::double + 0.2::double*sqrt(c1) as d2 from ({rendering.SQL['composite_rgb']}))"]
    for k in range(1, ROUNDS + 1):
        cases = " union all ".join(f"select camera_id, {i} as i, e0, e1, e2, d{i} as t from r{k - 1} where {_FREE(f'c{i}')} and {_FREE(f'e{i}')} and {_FREE(f'd{i}')}" for i in range(3))
        out.append(f"u{k} as ({cases}), n{k} as (select camera_id, i, {_sums(_FEATURES, 't')} from u{k} group by all), {_eliminated(f'w{k}_', f'n{k}', 'camera_id, i', 10)}")
        mapped = ", ".join(f"greatest(0, least(1, {' + '.join(f'f{i}.w{j}*({e})' for j, e in enumerate(_FEATURES))})) as e{i}" for i in range(3))
        joins = " ".join(f"left join w{k}_ f{i} on f{i}.camera_id = r.camera_id and f{i}.i = {i}" for i in range(3))
        out.append(f"r{k} as materialized (select r.* replace ({mapped}) from r{k - 1} r {joins})")
    return ", ".join(out)


SQL = {
    "color_quadratic": f"with {_correction()} select camera_id, x, y, {', '.join(f'round(coalesce(e{k}, 0), 3) as c{k}' for k in range(3))} from r{ROUNDS}",
    "inverse_polynomial_fit": f"""with l as (select s_suppkey, s_acctbal::double/100000 as b from supplier), p as (select *, 1.1::double*i/199 as x from l, unnest(range(200)) u(i)),
q as (select *, ((((b/4*x)*x + (b - 0.05::double))*x)*x + (1 + b/10))*x as y from p), n as (select s_suppkey, {_sums([f'pow(y, {k})' for k in range(1, 6)], 'x')} from q group by 1), {_eliminated('w', 'n', 's_suppkey', 5, '1e-10::double')},
m as (select q.s_suppkey, max(abs({' + '.join(f'w{k}*pow(y, {k + 1})' for k in range(5))} - x)) as e from q join w on w.s_suppkey = q.s_suppkey where i % 2 = 0 group by 1)
select w.s_suppkey, e <= 1.1::double/1000 as fits, {', '.join(f'round({" + ".join(f"w{k}*pow({y}::double, {k + 1})" for k in range(5))}, 4) + 0 as x{i}' for i, y in enumerate((0.2, 0.5, 0.9)))} from w join m on m.s_suppkey = w.s_suppkey""",
    "occlusion_mask": f"""with c as materialized ({rendering.SQL['composite_rgb']}), s as (select camera_id, x, y from c where alpha > 0.9::double),
d as (select distinct camera_id, x + dx as x, y + dy as y from s, unnest(range(-{SIZE // 2}, {SIZE // 2 + 1})) u(dx), unnest(range(-{SIZE // 2}, {SIZE // 2 + 1})) v(dy)), n as (select x, y, count(*) as n from d group by all)
select g.x::int as x, h.y::int as y, (n is not null)::int::double as mask, coalesce(n, 0)::bigint as cameras from unnest(range(64)) g(x) cross join unnest(range(48)) h(y) left join n on n.x = g.x and n.y = h.y""",
}
