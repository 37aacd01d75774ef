"""Mutations and filters of the scene table as queries."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import filters, mutate
from splatloom.sources import views as V

from .common import r4

_KEPT = ("mx", "my", "mz", "opacity", "sx", "sy", "sz")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("gaussian_id", *more, *[r4(c).alias(c) for c in _KEPT])


def relocate_dead(spark: SparkSession, folder: str) -> DataFrame:
    """Faint primitives moved to others that are drawn by opacity."""
    share = F.pmod(F.col("gaussian_id") * 7919, F.lit(10007)) / 10007.0
    return _shown(mutate.relocate(V.gaussians(spark, folder), F.col("opacity") < 0.3, share), "origin")


def sample_add(spark: SparkSession, folder: str) -> DataFrame:
    """A new primitive for each supplier, at one drawn by opacity."""
    draws = V.table(spark, folder, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("new_id"), (F.pmod(F.col("s_suppkey") * 7919, F.lit(10007)) / 10007.0).alias("share"))
    return _shown(mutate.sample_add(V.gaussians(spark, folder), draws, "share", "new_id"), "origin")


def inject_noise(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(mutate.noisy(V.gaussians(spark, folder), (F.col("e13"), F.col("e14"), F.col("e15")), 50.0, t=0.4, k=10.0))


def bincount(spark: SparkSession, folder: str) -> DataFrame:
    """How many line items each quantity from 0 to 63 has."""
    rows = V.table(spark, folder, "lineitem").select(F.col("l_quantity").cast("long").alias("v"))
    return mutate.bincount(rows, "v", 64)


def finite_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives whose logarithms of colours and logits are all finite."""
    rows = V.gaussians(spark, folder).withColumns({"l0": F.ln("c0"), "l1": F.ln(F.col("c1") - 0.3), "l2": F.when(F.col("e5") > 0.2, F.lit(float("inf"))).otherwise(F.col("e5"))})
    return _shown(filters.finite(rows, "l0", "l1", "l2"))


def crop_box(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(filters.inside_box(V.gaussians(spark, folder), ("mx", "my", "mz"), (-1.0, -1.0, 3.5), (1.0, 0.8, 4.5)))


def components_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives of the components that a list names."""
    listed = V.table(spark, folder, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("int").alias("component_id"))
    return _shown(filters.of_components(V.gaussians(spark, folder), listed), "component_id")


def unused_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that no primitive has as its component."""
    nations = V.table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("class_id"))
    return filters.difference(nations, V.gaussians(spark, folder).select(F.col("component_id").cast("int").alias("class_id")))


def subset(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the points, drawn by their id, as a sampling operator does."""
    return filters.subset(V.points(spark, folder), "point_id", 0.2).select("point_id", "x", "y", "z")


QUERIES = {f.__name__: f for f in (relocate_dead, sample_add, inject_noise, bincount, finite_rows, crop_box, components_kept, unused_ids, subset)}

_ALL = ", ".join(f"round({c}, 4) + 0 as {c}" for c in _KEPT)
_TABLE = "[" + ", ".join("[" + ", ".join(repr(float(comb(m, k + 1)) * (-1.0) ** k / (k + 1) ** 0.5) + "::double" for k in range(m)) + "]" for m in range(1, 13)) + "]"
_DRAW = """w as (select gaussian_id as source, (sum(opacity) over (order by gaussian_id % 1024, gaussian_id rows unbounded preceding)) as upto, opacity as w from {alive}),
t as (select sum(w) as total from w), drawn as (select d.id, w.source from {draws} d, t, w where d.share*t.total >= w.upto - w.w and d.share*t.total < w.upto),
n as (select source, count(*) + 1 as copies from drawn group by 1),
o as (select a.*, copies, case when copies is null then a.opacity else least(greatest(1 - pow(1 - a.opacity, 1/copies::double), 0.005::double), 1 - pow(2::double, -23)) end as o from {alive} a left join n on n.source = a.gaussian_id),
f as (select *, case when copies is null then 1 else opacity/list_sum(list_transform(range(1, copies + 1), lambda k: {table}[copies][k]*pow(o, k))) end as f from o),
s as (select gaussian_id, case when copies is null then 'kept' else 'drawn' end as origin, mx, my, mz, o as opacity, sx*f as sx, sy*f as sy, sz*f as sz from f)
select gaussian_id, origin, {all} from s union all select drawn.id, '{moved}', {all} from drawn join s on s.gaussian_id = drawn.source"""
SQL = {
    "relocate_dead": f"with {V.GAUSSIANS}, alive as (select * from gaussians where not opacity < 0.3::double), draws as (select gaussian_id as id, (gaussian_id*7919 % 10007)/10007::double as share from gaussians where opacity < 0.3::double), "
    + _DRAW.format(alive="alive", draws="draws", table=_TABLE, all=_ALL, moved="moved"),
    "sample_add": f"with {V.GAUSSIANS}, draws as (select s_suppkey + 1000000 as id, (s_suppkey*7919 % 10007)/10007::double as share from supplier), " + _DRAW.format(alive="gaussians", draws="draws", table=_TABLE, all=_ALL, moved="added"),
    "bincount": "select r.range as value, count(l.l_quantity) as n from range(0, 64) r left join lineitem l on l.l_quantity::bigint = r.range group by 1",
    "finite_rows": f"with {V.GAUSSIANS} select gaussian_id, {_ALL} from gaussians where c0 > 0 and c1 - 0.3::double > 0 and not e5 > 0.2::double",
    "crop_box": f"with {V.GAUSSIANS} select gaussian_id, {_ALL} from gaussians where mx >= -1 and mx <= 1 and my >= -1 and my <= 0.8::double and mz >= 3.5::double and mz <= 4.5::double",
    "components_kept": f"with {V.GAUSSIANS} select gaussian_id, component_id, {_ALL} from gaussians where component_id in (select n_nationkey from nation where n_regionkey < 2)",
    "unused_ids": "select n_nationkey::int as class_id from nation where n_nationkey not in (select label from embeddings)",
    "subset": "select l_orderkey*8 + l_linenumber as point_id, l_quantity/10 as x, l_discount*50 as y, l_extendedprice/20000 as z from lineitem where (l_orderkey*8 + l_linenumber)*2654435761 % 1048576 < 209715",
}
_ROT = [["1 - 2*(qy*qy + qz*qz)", "2*(qx*qy - qw*qz)", "2*(qx*qz + qw*qy)"], ["2*(qx*qy + qw*qz)", "1 - 2*(qx*qx + qz*qz)", "2*(qy*qz - qw*qx)"], ["2*(qx*qz - qw*qy)", "2*(qy*qz + qw*qx)", "1 - 2*(qx*qx + qy*qy)"]]
_COV = lambda i, j: "(" + " + ".join(f"({_ROT[i][k]})*({_ROT[j][k]})*s{a}*s{a}" for k, a in enumerate("xyz")) + ")"
_MOVES = ", ".join(f"round(m{a} + 50/(1 + exp(10*(opacity - 0.4::double)))*({' + '.join(f'{_COV(i, j)}*e{13 + j}' for j in range(3))}), 4) + 0 as m{a}" for i, a in enumerate("xyz"))
SQL["inject_noise"] = f"with {V.GAUSSIANS} select gaussian_id, {_MOVES}, round(opacity, 4) + 0 as opacity, round(sx, 4) + 0 as sx, round(sy, 4) + 0 as sy, round(sz, 4) + 0 as sz from gaussians"
