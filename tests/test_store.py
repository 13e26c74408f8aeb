import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import records, store

ROW = "id string, version int, bucket int, generation string"


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_increments_equal_the_whole_log(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice([None, "hot", *map(str, range(60))]), r.choice([None, *range(6)]), k, f"g{k}") for k in range(500)]
    log = spark.createDataFrame(rows, ROW)
    folder = str(tmp_path)
    store.create(spark, folder, 8)
    r.shuffle(rows)
    for part in (rows[:200], rows[200:], rows[:50]):      # the last is a repetition
        assert store.upsert(spark.createDataFrame(part, ROW), folder, ["id"], "version") == 8
    got = store.read(spark, folder, log.schema)
    assert got.columns == log.columns
    want = log.groupBy("id").agg(F.max(F.struct("version", "bucket", "generation")).alias("x")).select("id", "x.*")
    assert rows_of(got) == rows_of(want)
    assert {(x.id, x.version) for x in got.collect()} == {(x.id, x.version) for x in records.current(log).collect()} | {
        (x.id, x.version) for x in want.where("version IS NULL").collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder, schema = str(tmp_path), "id long, version int"
    store.create(spark, folder, 16)
    many = spark.range(2000).select("id", F.lit(0).alias("version"))
    assert store.upsert(many, folder, ["id"], "version") == 16
    before = set(store.read(spark, folder, many.schema).inputFiles())
    assert store.upsert(spark.createDataFrame([(7, 3)], schema), folder, ["id"], "version") == 1
    found = store.read(spark, folder, many.schema)
    assert len(before & set(found.inputFiles())) == 15 and found.count() == 2000
    assert found.where("id = 7").collect()[0].version == 3
    assert store.upsert(spark.createDataFrame([], schema), folder, ["id"], "version") == 0


def test_a_run_without_commit_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path), "id long, version int"
    store.create(spark, folder, 4)
    first = spark.createDataFrame([(k, 0) for k in range(20)], schema)
    store.upsert(first, folder, ["id"], "version")
    second = spark.createDataFrame([(k, 1) for k in range(10, 30)], schema)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(second, folder, ["id"], "version")
    assert rows_of(store.read(spark, folder, first.schema)) == rows_of(first)
    store.upsert(second, folder, ["id"], "version")
    assert sorted(tuple(x) for x in store.read(spark, folder, first.schema).collect()) == \
        [(k, 0) for k in range(10)] + [(k, 1) for k in range(10, 30)]


def test_keys_alone_and_empty_store(spark, tmp_path):
    folder = str(tmp_path)
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "id string, user_id long")
    store.create(spark, folder)
    assert store.read(spark, folder, pairs.schema).count() == 0
    store.upsert(pairs, folder, ["id", "user_id"])
    store.upsert(pairs.limit(1), folder, ["id", "user_id"])
    assert rows_of(store.read(spark, folder, pairs.schema)) == [("a", 1), ("a", 2)]
