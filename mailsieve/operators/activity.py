"""Request-rate and failure reports over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import prefix_sums


def quota_pressure(events: DataFrame, window_seconds: int = 60, quota: int = 30) -> DataFrame:
    """Requests of a user in the last ``window_seconds`` at each moment.

    Events are first counted per (user, instant); each count then enters its own time
    bucket and the next, so a group covers two buckets of time and never a whole user.
    """
    moments = events.groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    span = window_seconds * 1_000_000
    own = F.floor(F.col("micros") / span)
    placed = moments.withColumn("_own", own) \
        .withColumn("_bucket", F.explode(F.array(own, own + 1)))
    recent = Window.partitionBy("user_id", "_bucket").orderBy("micros").rangeBetween(-span, 0)
    return placed.withColumn("in_window", F.sum("n").over(recent)) \
        .where(F.col("_bucket") == F.col("_own")) \
        .select("user_id", "ts", "in_window", (F.col("in_window") > quota).alias("over_quota"))


def failure_streaks(events: DataFrame, minimum: int = 3) -> DataFrame:
    """Runs of at least ``minimum`` consecutive failures per user.

    The running number of successes names each run; it comes from
    :func:`prefix_sums`, so one very active user does not fill one task.
    """
    failed = F.col("event_type") == "error"
    numbered = prefix_sums(
        events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"],
        {"successes": F.when(failed, 0).otherwise(1)})
    return numbered.where(failed).groupBy("user_id", "successes").agg(
        F.count(F.lit(1)).alias("failures"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts")).where(F.col("failures") >= minimum).drop("successes")
