"""Search index over stored records: postings of three-character grams, intersected and then verified."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import records as stored
from .scale import durable

GRAM = 3
BUCKETS = 64
#: Files over which the postings of one bucket, and so of one very frequent gram, are spread.
SPREAD = 8

_POSTINGS = "gram string, field string, record bigint"


def _grams(value):
    """Distinct grams of a text; none if it is shorter than one."""
    size = F.length(value)
    return F.when(size >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), size - GRAM + 1), lambda i: F.substring(value, i, F.lit(GRAM)))))


def build(records: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``records`` (id, filename, finding_json and any others) to an empty ``folder``.

    Rows lie in buckets by a hash of their id, postings (gram, field, hash of the id) in buckets by gram,
    each bucket in files by id, so that a gram of all records is no task's alone.  Null ids and repeated rows are kept; null
    fields have no grams.  The list of buckets is written last, by one rename: a build that ended early is no index.
    """
    key = F.xxhash64("id")
    fields = [("filename", F.col("filename")), ("subject", stored.finding_field("subject")),
              ("from_addr", stored.finding_field("from_addr"))]
    place = F.pmod(key, F.lit(buckets)).cast("int")
    postings = records.select(key.alias("record"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.lower(v).alias("value")) for n, v in fields])).alias("f")) \
        .select("record", "f.field", F.explode(_grams(F.col("f.value"))).alias("gram")) \
        .withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    postings.withColumn("_file", F.pmod(F.col("record"), F.lit(SPREAD))).repartition("bucket", "_file").drop("_file") \
        .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    records.select("*", place.alias("_bucket")).repartition("_bucket") \
        .write.partitionBy("_bucket").parquet(f"{folder}/rows")
    live = records.select(F.lit("rows").alias("kind"), place.alias("bucket")) \
        .union(postings.select(F.lit("postings"), "bucket")).distinct() \
        .union(records.sparkSession.createDataFrame([("buckets", buckets)], "kind string, bucket int"))
    live.coalesce(1).write.parquet(f"{folder}/live")


def search(spark: SparkSession, folder: str, schema: StructType, term: str, user_id=None, risk_level: str = "All") -> DataFrame:
    """The rows that ``records.history(all rows, user_id, risk_level, term)`` gives.

    Postings of the term's grams alone are opened; the records that have all of them in one field are
    candidates, and only the buckets of rows that hold one are read, for the exact comparison.  ``%`` and ``_`` in the
    term stand for other text, as there, and cut it into runs.  A term without a run of three characters is compared with all rows.
    """
    live = spark.read.schema("kind string, bucket int").parquet(f"{folder}/live").collect()    # two rows a bucket at most
    have = {kind: {r.bucket for r in live if r.kind == kind} for kind in ("rows", "postings")}
    buckets = next(r.bucket for r in live if r.kind == "buckets")

    def rows(only: set[int]) -> DataFrame:
        paths = [f"{folder}/rows/_bucket={b}" for b in sorted(only & have["rows"])]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    runs = re.split(r"(?s)\\.|[%_]", spark.range(1).select(F.lower(F.lit((term or "").strip().lower()))).first()[0])
    grams = sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})
    if not grams:
        return stored.history(rows(have["rows"]), user_id, risk_level, term)
    asked = spark.createDataFrame([(g,) for g in grams], "gram string") \
        .select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()
    if not {r[0] for r in asked} <= have["postings"]:
        return spark.createDataFrame([], schema)
    found = durable(spark.read.schema(_POSTINGS).parquet(*[f"{folder}/postings/bucket={r[0]}" for r in asked])
                    .where(F.col("gram").isin(grams)).groupBy("record", "field")
                    .agg(F.size(F.collect_set("gram")).alias("n")).where(F.col("n") == len(grams))
                    .select(F.col("record").alias("_record")).distinct())
    parts = {r[0] for r in found.select(F.pmod("_record", F.lit(buckets)).cast("int")).distinct().collect()}
    near = rows(parts).join(found, F.xxhash64("id") == F.col("_record"), "left_semi")
    return stored.history(near, user_id, risk_level, term)
