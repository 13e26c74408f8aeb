"""As-of join: each row with the last version of its key at the row's time, for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import durable


def last_version(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """Rows with ``version``, the struct of the last row of ``versions`` of the same ``key`` whose ``since`` is
    not after the row's ``at``; null where there is none.

    Rows and versions are sorted together by (key, time) in range partitions, so a hot key spreads over many
    slices and no pair of row and version is ever made.  A slice keeps its last version as it reads; what
    it starts with is the last version of earlier slices (one row per slice and key that crosses or ends there).  Of versions of
    one key and time the greatest by the other columns, in their order, counts.  Rows with a null key or time find nothing, versions with
    one are found by nothing.  No row is lost or repeated.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload = F.struct(since, *[c for c in versions.columns if c != since])
    kept, time = rows.schema, rows.select(F.col(at).cast("timestamp")).schema[0].dataType
    told = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("_key"), F.col(since).cast(time).alias("_at"), F.lit(0).alias("_side"),
        payload.alias("_version"), F.lit(None).cast(kept).alias("_row"))
    asking = rows.select(
        F.col(key).alias("_key"), F.col(at).cast(time).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(told.schema["_version"].dataType).alias("_version"), F.struct(*rows.columns).alias("_row"))
    lost = F.col("_key").isNull() | F.col("_at").isNull()
    order = ["_at", "_side", "_version"]
    # the hash parts rows that agree in all else, so that a moment of very many rows is not one task
    placed = durable(told.unionByName(asking.where(~lost)).withColumn("_part", F.xxhash64("_row"))
                     .repartitionByRange(slices, "_key", *order, "_part").withColumn("_slice", F.spark_partition_id()))
    here = Window.partitionBy("_slice", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("_slice", "_key").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_version"))).alias("_last")) \
        .select("_slice", "_key", F.last("_last", ignorenulls=True).over(before)["_version"].alias("_carried"))
    running = placed.withColumn("_seen", F.last("_version", ignorenulls=True).over(here)).where("_side = 1")
    found = running.join(heads, ["_slice", "_key"]).select("_row.*", F.coalesce("_seen", "_carried").alias("version"))
    none = asking.where(lost).select("_row.*", F.col("_version").alias("version"))
    return found.unionByName(none)
