"""Points in moving boxes as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.operators.boxes import first_posed_box
from splatloom.operators.project import spread_out
from splatloom.sources import views as V

from .common import r4

#: Frames of the sample; boxes turn from frame to frame.
FRAMES = 8


def points_in_posed_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The first box of its frame that holds each point, and the point in that box's own axes; boxes of 0.1 to 4 across."""
    points = V.points(spark, folder).select(F.pmod("point_id", F.lit(FRAMES)).cast("int").alias("frame"), "point_id", "x", "y", "z")
    parts = spread_out(V.table(spark, folder, "part")).select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    angle = 0.1 * F.col("frame") + 0.05 * F.col("p_size")
    size = F.when(F.pmod("p_partkey", F.lit(97)) == 0, 2.0).otherwise(0.05 + 0.02 * F.pmod("p_partkey", F.lit(11)))
    boxes = parts.select(
        "frame", F.col("p_partkey").cast("long").alias("box_id"), (F.col("p_size").cast("double") / 10 + 0.1 * F.col("frame")).alias("bx"), F.pmod("p_partkey", F.lit(6)).cast("double").alias("by"), (F.col("p_retailprice").cast("double") / 500).alias("bz"),
        size.alias("hx"), (size / 2).alias("hy"), (size / 3 + 0.1).alias("hz"), F.cos(angle / 2).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(angle / 2).alias("qz"),
    )
    return first_posed_box(points, boxes).select("frame", "point_id", F.coalesce("box_id", F.lit(-1)).cast("long").alias("box_id"), r4("lx").alias("lx"), r4("ly").alias("ly"), (F.round("lz", 7) + 0.0).alias("lz"))


QUERIES = {"points_in_posed_boxes": points_in_posed_boxes}
SQL = {
    # Every point is held against every box of its frame.
    "points_in_posed_boxes": f"""with p as materialized (select row_number() over () as r, ((l_orderkey*8 + l_linenumber) % {FRAMES})::int as frame, (l_orderkey*8 + l_linenumber)::bigint as point_id, l_quantity::double/10 as x, l_discount::double*50 as y, l_extendedprice::double/20000 as z from lineitem),
b as (select f::int as frame, p_partkey::bigint as box_id, p_size::double/10 + 0.1::double*f as bx, (p_partkey % 6)::double as by_, p_retailprice::double/500 as bz, 0.1::double*f + 0.05::double*p_size as a,
  case when p_partkey % 97 = 0 then 2::double else 0.05::double + 0.02::double*(p_partkey % 11) end as h from part, unnest(range({FRAMES})) u(f)),
m as (select r, min(struct_pack(box_id := box_id, lx := cos(a)*(x - bx) + sin(a)*(y - by_), ly := cos(a)*(y - by_) - sin(a)*(x - bx), lz := z - bz)) as m from p join b on b.frame = p.frame
  and abs(z - bz) <= h/3 + 0.1::double and abs(x - bx) <= 2*h and abs(y - by_) <= 2*h and abs(cos(a)*(x - bx) + sin(a)*(y - by_)) <= h and abs(cos(a)*(y - by_) - sin(a)*(x - bx)) <= h/2 group by all)
select p.frame, p.point_id, coalesce(m.box_id, -1) as box_id, round(m.lx, 4) + 0 as lx, round(m.ly, 4) + 0 as ly, round(m.lz, 7) + 0 as lz from p left join m on m.r = p.r""",
}
