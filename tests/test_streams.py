"""Streams with keyed state equal their batch twins and touch only the keys that arrive."""

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from mailsieve.operators.baseline import sender_baseline
from mailsieve.streaming import baseline, ratelimit

LOG = "id long, user_id long, ts timestamp, from_addr string"


def arrivals(spark, batches, schema, folder):
    """One file for each batch, in the given order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def mails(many, users=5):
    r = random.Random(4)
    begin = datetime.datetime(2024, 1, 1)
    return [(i, r.choice([None, *range(users)]), begin + datetime.timedelta(seconds=7 * (i // 2)),
             f"p{r.randrange(4)}@d{r.randrange(6)}.com" if r.random() < 0.95 else None) for i in range(many)]


def facts(rows):
    return sorted((r.id, r.user_id, r.prior_messages, r.address_count, r.domain_count, r.available, r.first_time_address,
                   r.first_time_domain) for r in rows.collect())


def test_baseline_stream_equals_batch_out_of_order(spark, tmp_path):
    rows = mails(400)
    batches = [rows[200:300], rows[0:100], rows[300:400], rows[100:200] + rows[150:170]]   # the last repeats some
    log = arrivals(spark, batches, LOG, str(tmp_path / "in"))
    baseline.run_baseline_stream(log, str(tmp_path / "out"), 20, 5, lateness=1e6).awaitTermination()
    got = facts(baseline.streamed_facts(spark, str(tmp_path / "out")))
    want = sender_baseline(spark.createDataFrame([r for r in rows if r[1] is not None], LOG), 20, 5)
    assert [g for g in got if g[1] is not None] == facts(want)
    assert len(got) == sum(r[3] is not None for r in rows)


def test_baseline_state_is_bounded_and_idle_recipients_cost_nothing(spark, tmp_path):
    rows = mails(600, 40)
    one = [(10_000 + k, 3, rows[-1][2], "new@d1.com") for k in range(3)]
    log = arrivals(spark, [rows, one], LOG, str(tmp_path / "in"))
    live = baseline.run_baseline_stream(log, str(tmp_path / "out"), 4, 2, lateness=0.0)
    live.awaitTermination()
    states = [p["stateOperators"][0] for p in live.recentProgress if p["numInputRows"]]
    assert states[0]["numRowsUpdated"] >= 40 and states[1]["numRowsUpdated"] <= 9     # one short list
    found = {r[0]: r for r in facts(baseline.streamed_facts(spark, str(tmp_path / "out")))}
    assert [found[10_000 + k][2] for k in range(3)] == [4, 4, 4] and found[10_002][3] >= 2


def test_a_long_mailbox_keeps_a_short_list():
    class Held:
        rows = []

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    held, handler = Held(), baseline._handler(10, 2, 5, None)
    handler.init(held)
    for start in range(0, 1000, 100):
        new = [Row(us=t, id=t, from_addr="a@b.c", from_org="b.c") for t in range(start, start + 100)]
        assert len(list(handler.handleInputRows((1,), iter(new), None))) == 100
        assert len(held.rows) == 16                          # ten, and those of the last five microseconds
    late = list(handler.handleInputRows((1,), iter([Row(us=996, id=-1, from_addr="x@y.z", from_org="y.z")]), None))
    assert [(r.id, r.prior_messages, r.domain_count, r.revision) for r in late] == [
        (-1, 10, 0, 0), (996, 10, 9, 1), (997, 10, 9, 1), (998, 10, 9, 1), (999, 10, 9, 1)]


def test_a_mailbox_is_kept_in_blocks():
    """Late, repeated and ordered batches give the facts of all messages at once; the state has few entries."""
    class Held:
        rows, read = [], 0

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            self.read += len(self.rows)
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

    def facts_of(batches):
        held, handler, found = Held(), baseline._handler(80, 2, 10**9, None), {}
        handler.init(held)
        for batch in batches:
            for r in handler.handleInputRows((1,), iter(batch), None):
                assert r.id not in found or r.revision > found[r.id].revision
                found[r.id] = r
        return held, {i: r[:-1] for i, r in found.items()}

    r = random.Random(7)
    rows = [Row(us=t // 2, id=t, from_addr=f"p{r.randrange(9)}@d{t % 5}.c", from_org=f"d{t % 5}.c") for t in range(3000)]
    slices = [rows[900:1500], rows[:700], rows[2000:], rows[1500:2000] + rows[1450:1600], rows[700:900], rows[700:900]]
    for batch in slices:
        r.shuffle(batch)
    _, want = facts_of([rows])
    held, got = facts_of(slices)
    assert got == want and len(got) == 3000
    assert len(held.rows) <= 3000 // 10 + 1 and held.read <= 3000


def test_idle_buckets_vanish(spark, tmp_path):
    """Buckets are dropped once full again; decisions equal the batch's."""
    rows = [(100 * u + k, u, 60 * u + 5 * k) for u in range(30) for k in range(8)]
    rows += [(9000 + k, 2, 3000 + k) for k in range(8)]
    batches = [[r for r in rows if lo <= r[2] < lo + 500] for lo in (0, 500, 1000, 1500, 3000)]
    seconds = "event_id long, user_id long, s long"
    log = arrivals(spark, batches, seconds, str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    live = ratelimit.limit_stream(log, str(tmp_path / "out"), 3, 60.0)
    live.awaitTermination()
    left = live.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    # one client is within a minute of the last request: a bucket and its timer's entries
    assert left <= 3
    batch = spark.createDataFrame(rows, seconds).withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in ratelimit.stream_decisions(spark, str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.allowed for r in ratelimit.limited(batch, 3, 60.0).collect()}
    assert 0 < sum(got.values()) < len(got) == len(rows)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """25 000 requests of one client out of order, over several frames and micro-batches."""
    d = spark.range(25_600).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 40 > 0, 1).otherwise(F.col("id") % 7).alias("user_id"),
        F.timestamp_seconds(F.col("id") * F.lit(0.5)).alias("ts"))
    for k in range(3):
        d.where(F.floor(F.col("event_id") / 9000) == k).orderBy(F.xxhash64("event_id")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = ratelimit.limit_stream(stream, str(tmp_path / "out"), 50, 30.0)
    live.awaitTermination()
    got = {r.event_id: r.allowed for r in ratelimit.stream_decisions(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 25_600
    assert got == {r.event_id: r.allowed for r in ratelimit.limited(d, 50, 30.0).collect()}
    assert 0 < sum(got.values()) < len(got)


def test_redelivered_messages_count_once(spark, tmp_path):
    day = [[(k, f"{k}.eml", bytearray(b"m%d" % (k % 40))) for k in range(60)],
           [(k + 100, f"{k}.eml", bytearray(b"m%d" % k)) for k in range(50)] + [(1, "x.eml", None), (2, "y.eml", None), (3, "z.eml", bytearray())]]
    files = arrivals(spark, day, "msg_id long, path string, content binary", str(tmp_path / "in"))
    from mailsieve.streaming.arrivals import first_deliveries, store_verdicts
    for _ in range(2):     # the second run finds nothing new
        store_verdicts(first_deliveries(files), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    held = [bytes(x.content) for x in got if x.content is not None]
    assert sorted(held) == sorted([b"m%d" % k for k in range(50)] + [b""])
    assert sum(x.content is None for x in got) == 2
    assert {x.msg_id for x in got if x.content and int(x.content[1:]) >= 40} == set(range(140, 150))
