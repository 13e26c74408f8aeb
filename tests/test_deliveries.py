"""Replayed mail takes the disk of one batch, not of all deliveries several times over."""

import datetime
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailsieve.operators.scale import session_settings
from mailsieve.plans import stream_queries

PARTITIONS = "spark.sql.shuffle.partitions"


def taken(*folders):
    return sum(p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.is_file())


def shuffled(spark):
    """Bytes of the session's shuffle files."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data") if p.exists())


def test_settings_are_put_back(spark):
    before = spark.conf.get(PARTITIONS)
    with pytest.raises(ZeroDivisionError), session_settings(spark, {PARTITIONS: "3"}):
        assert spark.conf.get(PARTITIONS) == "3"
        1 / 0
    assert spark.conf.get(PARTITIONS) == before


def test_batches_are_all_rows_one_after_another(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 10 == 0 else begin + datetime.timedelta(seconds=i), f"m{i}") for i in range(100)]
    rows += rows[20:40] + [(None, begin, None)]
    d = spark.createDataFrame(rows, "msg_id long, ts timestamp, content string").repartition(5)
    seen, streams = [], set()
    for stream in stream_queries._delivered(spark, d, str(tmp_path), (1, 0), 5):
        assert stream.isStreaming
        streams.add(id(stream))
        seen.append([tuple(r) for r in spark.read.parquet(str(tmp_path / "in")).collect()])
    assert len(streams) == 1 and len(seen) == 2
    assert sorted(map(repr, seen[0] + seen[1])) == sorted(map(repr, rows))
    assert {r[0] for r in seen[0]} == {i for i in range(50, 100) if i % 10}      # the later half, sent first


def test_verdicts_of_a_replay_keep_one_delivery_on_disk(spark, tmp_path, monkeypatch):
    r, many = random.Random(5), 120
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJ", k=20_000)) for _ in range(many)]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(many).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")) \
        .write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20).select(F.col("id").alias("page_id"), F.lit("https://github.com/a").alias("url"),
                           F.lit("<p>x</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    kept, store, sizes, sent = [], stream_queries.arrivals.store_verdicts, [], []
    stream_queries.ensure_checkpoint_dir(spark)
    checkpoints = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    was, moved = taken(checkpoints), shuffled(spark)

    def watched(verdicts, out, checkpoint):
        sizes.append(taken(checkpoints) - was + max(0, shuffled(spark) - moved))
        sent.append({x.msg_id for x in spark.read.parquet(f"{os.path.dirname(out)}/in").select("msg_id").collect()})
        kept.append(store(verdicts, out, checkpoint))
        return kept[-1]

    monkeypatch.setattr(stream_queries.arrivals, "store_verdicts", watched)
    found = stream_queries.streamed_verdicts(spark, str(tmp_path))
    got = [x.msg_id for x in found.collect()]
    assert sorted(got) == [i for i in range(many) if i % 50 not in (7, 9)]       # one verdict each
    assert sent == [set(range(many))] * 2                                        # every message comes twice
    # a delivery is 1.7 times the texts before it is compressed; both, twice, are 6.7 times
    assert max(*sizes, taken(checkpoints) - was) < 1.7 * sum(map(len, texts))
    assert [q.lastProgress["numInputRows"] for q in kept] == [many, many]        # one micro-batch each, none without rows
