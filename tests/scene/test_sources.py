"""Files round trip; streams equal their batch results."""

from pyspark.sql import functions as F

from splatloom.sources import views as V
from splatloom.sources.splat_files import PlySource, splat_bytes, splat_rows
from splatloom.streaming.poses import append_batches, pose_windows

SF = "/root/testdata/sf0.001"


def test_ply_round_trip(spark, tmp_path):
    spark.dataSource.register(PlySource)
    rows = V.gaussians(spark, SF).select(*[F.col(c).cast("float").alias(c) for c in ("mx", "my", "mz", "opacity")], F.col("component_id").cast("int").alias("component"))
    for _ in range(2):
        rows.repartition(3).write.format("splat_ply").mode("overwrite").save(str(tmp_path / "scene"))
    back = spark.read.format("splat_ply").load(str(tmp_path / "scene"))
    assert back.schema["mx"].dataType.typeName() == "float" and back.schema["component"].dataType.typeName() == "integer"
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_splat_round_trip(spark):
    rows = V.gaussians(spark, SF)
    back = splat_rows(splat_bytes(rows))
    assert back.count() == rows.count()
    a, b = (sorted(x.select("mx", "opacity", "qw").collect()) for x in (rows, back))
    for x, y in zip(a, b, strict=True):
        assert abs(x["mx"] - y["mx"]) < 1e-5 and abs(x["opacity"] - y["opacity"]) < 0.003 and abs(x["qw"] - y["qw"]) < 0.009


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = V.table(spark, SF, "events").select("ts", "user_id", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = pose_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    pick = lambda df: sorted((r["track_id"], str(r["start"]), r["n"], round(r["tx"], 6)) for r in df.collect())
    assert pick(spark.table("windows")) == pick(pose_windows(events))


def test_batches_are_idempotent(spark, tmp_path):
    events = V.table(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
