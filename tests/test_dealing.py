"""Messages are spread over tasks by their number, wherever their ids lie in the files."""

import pytest
from pyspark.sql import functions as F

from mailsieve.plans import identity_queries, tables


@pytest.fixture
def narrow(spark, tmp_path, monkeypatch):
    """2,000 messages whose ids lie in the first of twenty files of events."""
    monkeypatch.setattr(tables, "MESSAGES", 50)
    spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("Some words.").alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.lit(11).cast("long").alias("n_chars")).coalesce(1) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40_000, numPartitions=20).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")) \
        .write.parquet(f"{tmp_path}/events.parquet")
    spark.range(50).select(F.col("id").alias("page_id"), F.lit("https://github.com/a").alias("url"),
                           F.lit("<p>x</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def most_in_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


@pytest.mark.parametrize("threshold", ["10m", "10k"])    # with and without broadcast of messages
def test_no_task_gets_most_messages(spark, narrow, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        d = tables.letters(spark, narrow, attachments=False).select("msg_id", "from_raw", "headers")
        assert d.count() == 2000
        assert most_in_a_task(d) < 120
        pairs = identity_queries.sender_relationships(spark, narrow)
        assert pairs.count() == 6000
        assert most_in_a_task(pairs) < 360
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
