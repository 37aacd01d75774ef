"""Feature planes as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import planes as P
from splatloom.sources import views as V

from .common import r4

SIZES, FEATURES, REST = P.resolutions((8, 8, 8, 5)), 4, 0.3


def plane_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of two scales; embeddings that fall into one cell are averaged."""
    k = F.floor(F.col("vec_id") / 12)
    side = lambda n: F.element_at(F.element_at(F.array(*[F.array(*[F.lit(s[pair[n]]) for pair in P.PAIRS]) for s in SIZES]), F.col("scale") + 1), F.col("plane") + 1)
    rows = V.table(spark, folder, "embeddings").select("embedding", k.alias("k"), (F.col("vec_id") % 2).cast("int").alias("scale"), (F.floor(F.col("vec_id") / 2) % 6).cast("int").alias("plane"))
    rows = rows.select("*", (F.col("k") % side(0)).cast("int").alias("i"), (F.floor(F.col("k") / side(0)) % side(1)).cast("int").alias("j"))
    means = [F.avg(0.5 + F.element_at("embedding", n + 1).cast("double")) for n in range(FEATURES)]
    return rows.groupBy("scale", "plane", "i", "j").agg(F.array(*means).alias("values"))


def field_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points at their time; of the lines with one point_id the first of the table."""
    lines, row = V.table(spark, folder, "lineitem"), F.col("_metadata.row_index")
    # The place of a line is one number, so that the first of each point is found by hashes of numbers.
    files = sorted(r[0] for r in lines.select(F.col("_metadata.file_path")).distinct().collect())
    if len(files) > 1:
        known = spark.createDataFrame(list(enumerate(files)), "_file long, _path string")
        lines = lines.select("*", F.col("_metadata.file_path").alias("_path"), row.alias("_row")).join(F.broadcast(known), "_path")
        lines = lines.withColumn("place", F.shiftleft("_file", 40) + F.col("_row"))
    else:
        lines = lines.select("*", row.alias("place"))
    points = V.points_of(lines, "place").groupBy("point_id").agg(*[F.min_by(a, "place").alias(a) for a in "xyz"])
    return points.select("point_id", *[(F.col(a) - 2.5).alias(a) for a in "xyz"], (F.pmod("point_id", F.lit(1000)) / 500 - 1).alias("t"))


def plane_field(spark: SparkSession, folder: str) -> DataFrame:
    """Features of every point at its time, from two scales of six planes."""
    got = P.sample(field_points(spark, folder), plane_cells(spark, folder), SIZES, FEATURES, 2.5, REST)
    return got.select("point_id", *[r4(F.element_at("features", n + 1)).alias(f"f{n}") for n in range(FEATURES * len(SIZES))])


def plane_regularisers(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothness and distance from 1 of each plane."""
    return P.regularisers(plane_cells(spark, folder), SIZES, FEATURES, REST).select("scale", "plane", "timed", r4("smooth").alias("smooth"), r4("away").alias("away"))


QUERIES = {"plane_field": plane_field, "plane_regularisers": plane_regularisers}
_AXES = "xyzt"
_PLANES = ", ".join(f"({s}, {p}, {size[a]}, {size[b]}, '{_AXES[a]}', '{_AXES[b]}', {1.0 if b == 3 else REST}::double)" for s, size in enumerate(SIZES) for p, (a, b) in enumerate(P.PAIRS))
_CELLS = f"""planes(scale, plane, na, nb, aa, ab, rest) as (values {_PLANES}),
r as (select e.embedding, vec_id // 12 as k, p.* from embeddings e join planes p on p.scale = vec_id % 2 and p.plane = (vec_id // 2) % 6),
cells as materialized (select scale, plane, na, nb, rest, k % na as i, (k // na) % nb as j, {", ".join(f"avg(0.5::double + embedding[{n + 1}]::double) as v{n}" for n in range(FEATURES))} from r group by all)"""
_MADE = ", ".join(f"sum(w * coalesce(v{n}, rest)) as v{n}" for n in range(FEATURES))
SQL = {
    "plane_field": f"""with {_CELLS},
pts as (select distinct on (point_id) (l_orderkey*8 + l_linenumber)::bigint as point_id, -(l_quantity::double/10 - 2.5::double)/2.5::double as x, -(l_discount::double*50 - 2.5::double)/2.5::double as y, -(l_extendedprice::double/20000 - 2.5::double)/2.5::double as z,
  ((l_orderkey*8 + l_linenumber) % 1000)::double/500 - 1 as t from lineitem),
long as (select point_id, a, greatest(0::double, least(1::double, (c + 1)/2)) as c from (select point_id, unnest(['x','y','z','t']) as a, unnest([x, y, z, t]) as c from pts)),
u as (select f.point_id, p.*, f.c*(na - 1) as pu, g.c*(nb - 1) as pv from planes p join long f on f.a = p.aa join long g on g.a = p.ab and g.point_id = f.point_id),
l as (select *, least(floor(pu), na - 2)::int as i0, least(floor(pv), nb - 2)::int as j0 from u),
k as (select l.*, di, dj, (case di when 1 then pu - i0 else 1 - (pu - i0) end)*(case dj when 1 then pv - j0 else 1 - (pv - j0) end) as w from l, (values (0), (1)) a(di), (values (0), (1)) b(dj)),
s as (select k.point_id, k.scale, k.plane, {_MADE.replace("rest", "k.rest")} from k left join cells c on c.scale = k.scale and c.plane = k.plane and c.i = k.i0 + k.di and c.j = k.j0 + k.dj group by all),
m as (select point_id, scale, {", ".join(f"product(v{n}) as v{n}" for n in range(FEATURES))} from s group by all)
select point_id, {", ".join(f"round(max(case when scale = {k} then v{n} end), 4) + 0 as f{k * FEATURES + n}" for k in range(len(SIZES)) for n in range(FEATURES))} from m group by point_id""",
    # Whole planes, missing cells filled in.
    "plane_regularisers": f"""with {_CELLS},
g as (select p.*, i.i, j.j from (select * from planes where (scale, plane) in (select (scale, plane) from cells)) p, range(16) i(i), range(16) j(j) where i.i < na and j.j < nb),
f as (select g.scale, g.plane, g.na, g.nb, g.ab, g.i, g.j, unnest(range({FEATURES})) as n, unnest([{", ".join(f"coalesce(c.v{n}, g.rest)" for n in range(FEATURES))}]) as v from g left join cells c on c.scale = g.scale and c.plane = g.plane and c.i = g.i and c.j = g.j),
d as (select *, lag(v) over w + lead(v) over w - 2*v as s from f window w as (partition by scale, plane, i, n order by j))
select scale, plane, ab = 't' as timed, round(avg(s*s), 4) + 0 as smooth, round(case when ab = 't' then avg(abs(1 - v)) end, 4) + 0 as away from d group by scale, plane, ab""",
}
