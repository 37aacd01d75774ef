"""Queries over tables in many parts: what is first, and what is broadcast."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from splatloom.operators.boxes import first_posed_box
from splatloom.operators.spatial import LISTED, _lists, first_box, fitting_cell, nearest_neighbours
from splatloom.plans.fields import field_points
from splatloom.sources import views as V
from splatloom.sources.tables import written


def test_the_first_line_of_a_point_counts_however_the_table_is_read(spark, tmp_path):
    line = lambda n, q: (n, 1, float(q), 0.01, 20000.0)
    rows = [line(n % 50, n) for n in range(20_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double").coalesce(1).write.option("parquet.block.size", "4096").option("parquet.page.size", "1024").parquet(f"{tmp_path}/lineitem.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        assert V.table(spark, str(tmp_path), "lineitem").rdd.getNumPartitions() > 1
        got = {r["point_id"]: r["x"] for r in field_points(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n * 8 + 1: n / 10 - 2.5 for n in range(50)}


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_listed_boxes_are_not_broadcast(spark):
    f = "/root/testdata/sf0.001"
    points = V.points(spark, f)
    assert "Broadcast" not in _final(first_box(points, V.boxes(spark, f)))
    half = F.lit(0.2)
    boxes = V.boxes(spark, f).select(F.lit(0).alias("frame"), "box_id", "bx", "by", "bz", *[half.alias(f"h{a}") for a in "xyz"], F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(f"q{a}") for a in "xyz"])
    assert "Broadcast" not in _final(first_posed_box(points.withColumn("frame", F.lit(0)), boxes))


def test_neighbours_of_crowded_points_are_no_rows(spark):
    # Nearly all points are crowded in a small part of the box; a look takes at most k rows from a list.
    far = lambda c: F.when(F.col("id") < 40, F.rand(c) * 100).otherwise(50 + F.randn(c + 3) / 10)
    points = written(spark.range(3000).select(F.col("id").alias("point_id"), far(1).alias("x"), far(2).alias("y"), far(3).alias("z")), "points")
    size = fitting_cell(points, 100 / (3000 / 4) ** (1 / 3), 4)
    assert size < 0.2
    near = nearest_neighbours(points, 3)
    rows = points.join(points.select(F.col("point_id").alias("other_id"), *[F.col(a).alias(f"o{a}") for a in "xyz"]), F.expr("point_id <> other_id"))
    rows = rows.select("point_id", "other_id", F.expr("sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))").alias("distance"))
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "other_id"))).where("rank <= 3").select(near.columns)
    got = {tuple(r) for r in near.collect()}
    assert len(got) == 9000 and got == {tuple(r) for r in want.collect()}


def test_neighbours_of_copies(spark):
    points = spark.range(700).select(F.col("id").alias("point_id"), *[F.when(F.col("id") < 600, F.lit(1.0)).otherwise(F.col("id") * k % 97 / 9.7).alias(a) for a, k in zip("xyz", (7, 11, 13), strict=True)])
    got = nearest_neighbours(points, 2).where("point_id < 600").collect()
    assert len(got) == 1200 and all(r["distance"] == 0 and r["other_id"] == [i for i in (0, 1, 2) if i != r["point_id"]][r["rank"] - 1] for r in got)
    assert _lists(points, 1.0).agg(F.max(F.size("others"))).first()[0] <= LISTED
