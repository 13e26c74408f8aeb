"""Building blocks that keep skewed keys from landing in one task."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if named:
            spark.sparkContext.setCheckpointDir(named)
        elif spark.sparkContext.master.startswith("local"):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mailsieve-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so several readers share one pass
    and a lost executor never forces (or changes) a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs; its own are put back."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def let_go(spark: SparkSession) -> None:
    """The driver drops what ended jobs left (plans, broadcasts, shuffles) before the next large plan is made."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prefix_sums(df: DataFrame, by: list[str], order: list[str],
                sums: dict[str, Column]) -> DataFrame:
    """Running totals per key in order, inclusive, for keys of any size.

    Rows are range-partitioned by (key, order), so a hot key spreads over many
    slices; each slice sums locally and adds what earlier slices of its key hold.
    ``order`` must be unique within a key.  The slice table has at most one row per
    (slice, key).  The placement is checkpointed because slice numbers must not
    change between the two passes.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_v_{n}": e.cast("bigint") for n, e in sums.items()})
    placed = durable(valued.repartitionByRange(slices, *by, *order)
                     .withColumn("_slice", F.spark_partition_id()))
    keys = ["_slice", *by]
    local = Window.partitionBy(*keys).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]) \
        .withColumns({f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0))
                      for n in sums}) \
        .drop(*[f"_t_{n}" for n in sums])
    running = placed.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(local) for n in sums})
    joined = running.join(heads, keys)
    out = joined.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_slice", *[f"_{p}_{n}" for p in "vro" for n in sums])


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: str,
                  salts: int = 16) -> DataFrame:
    """Left join to a table with one row per key, when some keys are very frequent.

    Left rows of a key are spread over ``salts`` groups by ``spread``; the right
    row is repeated once per group.  No row is dropped or duplicated.
    """
    spreaded = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spreaded.join(copies, [key, "_salt"], "left").drop("_salt")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values; combined before the shuffle, so hot values cost nothing."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()
