"""As-of joins of queries to timed pose tracks.

Keys and queries meet in pieces of a track (``piece_us`` of its time), so a hot track is spread over
many tasks.  What a piece needs from other pieces, the last key before and the first key after it,
comes from a table with one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

POSE = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")


def bracket(keys: DataFrame, queries: DataFrame, piece_us: int = 6 * 3_600_000_000) -> DataFrame:
    """(query_id, track_id, t_us, before, after): structs of the last key before and the first at or after each query.

    ``keys`` has track_id, t_us, key_id and the pose; ``queries`` has query_id, track_id, t_us.
    Keys of one time go by key_id.  A side without keys is null.
    """
    empty = F.lit(None)
    key = F.struct("t_us", "key_id", *POSE)
    kind = keys.select(key.alias("k")).schema["k"].dataType
    both = keys.select("track_id", "t_us", F.lit(1).alias("side"), F.col("key_id").alias("id"), key.alias("k")).union(queries.select("track_id", "t_us", F.lit(0), "query_id", empty.cast(kind)))
    both = both.withColumn("piece", F.floor(F.col("t_us") / piece_us))
    pieces = both.groupBy("track_id", "piece").agg(F.max("k").alias("last"), F.min("k").alias("first"))
    past = Window.partitionBy("track_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy("track_id").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.select("track_id", "piece", F.last("last", True).over(past).alias("past"), F.first("first", True).over(future).alias("future"))
    order = Window.partitionBy("track_id", "piece").orderBy("t_us", "side", "id")
    near = both.select("track_id", "piece", "t_us", "side", "id", F.last("k", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("b"), F.first("k", True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("a"))
    near = near.where("side = 0").join(pieces, ["track_id", "piece"])
    return near.select(F.col("id").alias("query_id"), "track_id", "t_us", F.coalesce("b", "past").alias("before"), F.coalesce("a", "future").alias("after"))


def interpolate(keys: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """(query_id, track_id, t_us, pose, exact): the pose of each track at each query's time.

    Times outside the track are clamped to its ends; a time that a key has gets that key's pose;
    all others get the linear and spherical interpolation between the keys around them.  Queries of
    tracks without keys get the identity and ``exact`` null.
    """
    rows = bracket(keys, queries, **options)
    b, a = F.col("before"), F.col("after")
    whole = F.when(a.isNull(), b).when(b.isNull() | (a["t_us"] == F.col("t_us")), a)
    share = (F.col("t_us") - b["t_us"]) / (a["t_us"] - b["t_us"])
    rows = rows.select("query_id", "track_id", "t_us", whole.alias("w"), "before", "after", share.alias("s"), (a.isNull() & b.isNull()).alias("none"))
    shift = R.lerp(tuple(b[c] for c in POSE[:3]), tuple(a[c] for c in POSE[:3]), F.col("s"))
    before, after = tuple(b[c] for c in POSE[3:]), tuple(a[c] for c in POSE[3:])
    u, v = R.slerp_shares(before, after, F.col("s"))
    rows = rows.select("query_id", "track_id", "t_us", "w", "none", *[c.alias(f"i{n}") for n, c in zip(POSE[:3], shift, strict=True)], *[c.alias(f"{side}{n}") for side, q in (("b", before), ("a", after)) for n, c in zip(POSE[3:], q, strict=True)], u.alias("u"), v.alias("v"))
    rows = rows.select("query_id", "track_id", "t_us", "w", "none", "itx", "ity", "itz", *[(F.col("u") * F.col(f"b{c}") + F.col("v") * F.col(f"a{c}")).alias(f"k{c}") for c in POSE[3:]])
    turn = R.normalised(R.columns(*[f"k{c}" for c in POSE[3:]]))
    identity = (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    pose = [F.when(F.col("none"), F.lit(i)).when(F.col("w").isNotNull(), F.col("w")[c]).otherwise(x).alias(c) for c, x, i in zip(POSE, (*R.columns("itx", "ity", "itz"), *turn), identity, strict=True)]
    return rows.select("query_id", "track_id", "t_us", *pose, F.when(~F.col("none"), F.col("w").isNotNull()).alias("exact"))


def nearest(keys: DataFrame, queries: DataFrame, tolerance_us: int, **options) -> DataFrame:
    """(query_id, track_id, t_us, key_id, gap_us): the key nearest in time, the earlier one of two; null beyond the tolerance."""
    rows = bracket(keys, queries, **options)
    left, right = F.col("t_us") - F.col("before.t_us"), F.col("after.t_us") - F.col("t_us")
    take = F.when(right.isNull() | (left <= right), F.struct(left.alias("gap"), F.col("before.key_id").alias("key"))).otherwise(F.struct(right.alias("gap"), F.col("after.key_id").alias("key")))
    rows = rows.select("query_id", "track_id", "t_us", take.alias("n"))
    ok = F.col("n.gap") <= tolerance_us
    return rows.select("query_id", "track_id", "t_us", F.when(ok, F.col("n.key")).alias("key_id"), F.when(ok, F.col("n.gap")).alias("gap_us"))
