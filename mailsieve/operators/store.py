"""Keyed table of files, updated by increments that rewrite only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scale import durable

BUCKETS = 64

_BUCKET = "store_bucket"
_COMMIT = "bucket int, generation bigint, buckets int"


def create(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
    """An empty store.  Choose ``buckets`` so that the rows of one, in their last versions, fit a task."""
    _commit(spark.createDataFrame([(-1, 0, buckets)], _COMMIT), folder)


def _commit(rows: DataFrame, folder: str) -> None:
    """One file holds a commit, and it appears by one rename: all of it counts, or nothing."""
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def _live(spark: SparkSession, folder: str) -> tuple[int, int, dict[int, int]]:
    """Number of buckets, last generation, and the generation of each bucket that has rows (one row a bucket)."""
    rows = spark.read.schema(_COMMIT).parquet(f"{folder}/commits").groupBy("bucket").agg(
        F.max("generation").alias("generation"), F.max("buckets").alias("buckets")).collect()
    if not rows:
        raise ValueError(f"no store in {folder}")
    return rows[0].buckets, max(r.generation for r in rows), {r.bucket: r.generation for r in rows if r.bucket >= 0}


def read(spark: SparkSession, folder: str, schema: StructType, only: set[int] | None = None) -> DataFrame:
    """Last versions of all keys, or of those in the buckets ``only``; no other files are listed or opened."""
    _, _, live = _live(spark, folder)
    paths = [f"{folder}/data/generation={g}/{_BUCKET}={b}" for b, g in sorted(live.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(increment: DataFrame, folder: str, keys: list[str], version: str | None = None) -> int:
    """Merge rows into the store; returns how many buckets were rewritten.

    Of the rows of a key, stored or new, the one of the greatest ``version`` stays, of equal versions (or
    without one) the greatest by the other columns in their order, so repeated and late rows and increments in any order give
    the same table; columns must be orderable.  A null version is the least, null keys are a key.  The
    increment is spread over buckets by a hash of its keys; each touched bucket is read, merged and written as a new generation,
    which a commit then makes the one to read.  A run that ends before its commit changes nothing for readers, and its
    repetition replaces what it left.  There is one writer at a time.  Earlier generations stay for readers that opened them.
    """
    spark, rest = increment.sparkSession, [c for c in increment.columns if c not in keys and c != version]
    buckets, last, live = _live(spark, folder)
    new = durable(increment)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = {r[0] for r in new.select(place).distinct().collect()}      # at most ``buckets`` numbers
    if not touched:
        return 0
    both = new.unionByName(read(spark, folder, increment.schema, touched & set(live)))
    order = ([version] if version else []) + rest
    if order:
        both = both.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    else:
        both = both.distinct()
    generation = last + 1
    both.select(*increment.columns, place.alias(_BUCKET)).repartition(len(touched), _BUCKET) \
        .write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/data/generation={generation}")
    _commit(spark.createDataFrame([(b, generation, buckets) for b in sorted(touched)], _COMMIT), folder)
    return len(touched)
