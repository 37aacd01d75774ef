"""Streams of timed poses: late-tolerant window summaries, and scene updates by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pose_windows(stream: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(track_id, start, n, tx, ty, last_value): sums over tumbling windows of each track.

    ``stream`` has ts, user_id and value.  Rows later than ``late`` behind the newest are dropped,
    and a window's state goes when the watermark passes its end.
    """
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.col("user_id").alias("track_id"), F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("value") / 10).alias("tx"), F.avg(F.col("value") / 20 - 1).alias("ty"), F.max_by("value", "ts").alias("last_value"))
    return out.select("track_id", F.col("w.start").alias("start"), "n", "tx", "ty", "last_value")


def append_batches(stream: DataFrame, folder: str, checkpoint: str):
    """A started query that writes each micro-batch to a folder of its own number: a replayed batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
