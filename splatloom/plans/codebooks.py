"""A codebook as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators import codebook as B
from splatloom.sources import views as V

from .common import r4

CLUSTERS, ROUNDS, WIDTH = 24, 3, 12


def harmonics_codebook(spark: SparkSession, folder: str) -> DataFrame:
    """Label, distance and decoded first components of every primitive's harmonics."""
    rows = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("gaussian_id"), F.transform(F.slice("embedding", 1, WIDTH), lambda x: x.cast("double")).alias("v"))
    book = B.codebook(rows, CLUSTERS, ROUNDS)
    found = B.decoded(book).join(book.labels.withColumnRenamed("key", "gaussian_id"), "gaussian_id")
    return found.select("gaussian_id", "label", "distance", *[r4(F.element_at("v", k + 1)).alias(f"v{k}") for k in range(3)])


QUERIES = {"harmonics_codebook": harmonics_codebook}


def _round(k: int) -> str:
    near = f"""a{k} as materialized (select vec_id, (r % 65536)::int as label, r // 65536 as distance from (select vec_id, min(far*65536 + label) as r from
  (select p.vec_id, c.label, sum(abs(p.x - c.x))::bigint as far from p join c{k} c on c.d = p.d group by all) group by vec_id))"""
    moved = f"""c{k + 1} as materialized (select c.label, c.d, coalesce(m.x, c.x) as x from c{k} c left join
  (select a.label, p.d, list_sort(list(p.x))[(count(*) + 1)//2] as x from p join a{k} a on a.vec_id = p.vec_id group by all) m on m.label = c.label and m.d = c.d)"""
    return near if k == ROUNDS else f"{near},\n{moved}"


SQL = {
    "harmonics_codebook": f"""with b as (select min(x) as lo, max(x) as hi from (select unnest(embedding[1:{WIDTH}])::double as x from embeddings)),
e as (select vec_id, unnest(range({WIDTH})) as d, unnest(embedding[1:{WIDTH}])::double as x from embeddings),
p as materialized (select vec_id, d, round_even((x - lo)/(hi - lo)*4095, 0)::int as x from e, b),
s as (select vec_id, row_number() over (order by md5(vec_id::varchar), vec_id) - 1 as label from embeddings),
c0 as materialized (select s.label, p.d, p.x from s join p on p.vec_id = s.vec_id where s.label < {CLUSTERS}),
{(","+chr(10)).join(_round(k) for k in range(ROUNDS + 1))},
v as (select label, d, x/4095::double*(hi - lo) + lo as c from c{ROUNDS}, b),
q as (select min(c) as lo, max(c) as hi from v),
w as (select label, d, round_even((c - lo)/(hi - lo)*63, 0)::int/63::double*(hi - lo) + lo as c from v, q)
select vec_id as gaussian_id, a.label, a.distance, {", ".join(f"round(max(case when d = {k} then c end), 4) + 0 as v{k}" for k in range(3))} from a{ROUNDS} a join w on w.label = a.label group by all""",
}
