"""As-of joins: each event meets the version in force at its time, from a history of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def asof_join(events: DataFrame, history: DataFrame, on: list[str], time: str, since: str, bucket_seconds: int = 7 * 86_400, how: str = "inner") -> DataFrame:
    """``events`` with the columns of the latest row of ``history`` with the same ``on`` and ``since`` <= ``time``.

    Of versions with one time the last by its other columns counts. Events before the first version, or without a time or
    key, are dropped, or kept with nulls if ``how`` is ``left``. Versions without a key or time are none.

    Time is cut in buckets. A version is listed in the bucket in which it begins, and the one in force as a bucket begins
    is listed in that bucket too, where there are events; so an event looks among the versions of its own bucket only, and
    the events of a busy key are spread over its buckets. Events are never sorted as a whole, and a history that is small
    enough is sent to them by Spark.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    values = [c for c in history.columns if c not in (*on, since)]
    known = history.where(F.col(since).isNotNull())
    for key in on:
        known = known.where(F.col(key).isNotNull())
    versions = known.groupBy(*on, since).agg(F.max(F.struct(*values)).alias("_values")) if values else known.select(*on, since).distinct().withColumn("_values", F.struct(F.lit(True).alias("_there")))
    order = Window.partitionBy(*on).orderBy(since)
    held = versions.withColumn("_until", F.lead(since).over(order)).withColumn("_from", _bucket(F.col(since), bucket_seconds))
    # buckets with events, and the version in force at the start of each: the last one of an earlier bucket
    keyed = events.withColumn("_bucket", _bucket(F.col(time), bucket_seconds))
    busy = keyed.select(*on, "_bucket").where(F.col("_bucket").isNotNull()).distinct()
    marks = held.select(*on, F.col("_from").alias("_bucket"), F.struct(F.col(since), F.col("_until"), F.col("_values")).alias("_v"), F.col(since).alias("_at"))
    by_bucket = marks.groupBy(*on, "_bucket").agg(F.max_by("_v", "_at").alias("_last"))
    stream = by_bucket.withColumn("_busy", F.lit(False)).unionByName(busy.select(*on, "_bucket", F.lit(None).cast(by_bucket.schema["_last"].dataType).alias("_last"), F.lit(True).alias("_busy")))
    one = stream.groupBy(*on, "_bucket").agg(F.max("_last").alias("_last"), F.max("_busy").alias("_busy"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = one.withColumn("_v", before).where("_busy AND _v IS NOT NULL").select(*on, "_bucket", "_v")
    listed = marks.select(*on, "_bucket", "_v").unionByName(carried).select(*on, "_bucket", F.col(f"_v.{since}").alias("_since"), F.col("_v._until").alias("_until"), F.col("_v._values").alias("_values"))
    inside = (keyed[time] >= listed["_since"]) & (listed["_until"].isNull() | (keyed[time] < listed["_until"]))
    same = inside & (keyed["_bucket"] == listed["_bucket"])
    for key in on:
        same = same & (keyed[key] == listed[key])
    joined = keyed.join(listed, same, how)
    return joined.select(*[keyed[c] for c in events.columns], listed["_since"].alias(since) if since not in events.columns else listed["_since"].alias(f"{since}_version"), *[F.col(f"_values.{v}").alias(v) for v in values])
