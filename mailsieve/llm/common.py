"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.operators.scale import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; a null text counts as empty."""
    return whole_texts(read(spark, sf_dir, "documents", "doc_id", "text"))


def whole_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_table(df: DataFrame) -> DataFrame:
    """Write a stage as parquet in the shared checkpoint folder and read it back.

    Several readers share one pass, columns are pruned, and a lost executor costs
    nothing that was written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def remembered(owner, make):
    """What a worker process remembers between tasks for one operator; another operator's memory is
    let go first, so a worker that runs several stages holds one at a time."""
    if owner not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[owner] = make()
    return _held[owner]


def _give_back() -> None:
    """Return freed memory to the machine; the allocator of a long-lived worker would keep it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):    # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
