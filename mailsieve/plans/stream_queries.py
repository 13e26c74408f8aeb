"""Batch runs of the streaming operators: the tables are replayed as file streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import reputation
from ..operators.scale import ensure_checkpoint_dir, let_go, session_settings
from ..streaming import baseline as live_baseline
from ..streaming import arrivals, lookups, ratelimit
from .lookup_queries import baseline_sql
from .registry import query
from .result_queries import FULL_CTES
from .tables import dealt_partitions, table, view
from .views import AS_OF


#: Shuffle files of a job or micro-batch go when it ends, not when the driver happens to collect its garbage; no micro-batch
#: without input is planned after each, only to let old state expire.
ONE_BATCH = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
             "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def _work_folder(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}{uuid.uuid4().hex}"


def _sliced(rows, parts: int):
    """Rows and ``_part``, which of ``parts`` equal spans of time they fall in; rows without time are in the first."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(us), F.max(us)).first()
    width = ((last or 0) - (first or 0)) // parts + 1
    return rows.withColumn("_part", F.coalesce(F.floor((us - (first or 0)) / width), F.lit(0)))


def _arrivals(spark, rows, folder: str, order: tuple[int, ...] = (0, 1, 2, 3)):
    """Rows as a stream of one folder of files after another, cut by time and sent in ``order``; rows
    without time come with the first.  All partitions write; a micro-batch is a folder's files."""
    many = rows.rdd.getNumPartitions()
    sliced = _sliced(rows, len(order)).sortWithinPartitions("_part", F.xxhash64(*rows.columns))
    for at in order:
        sliced.where(F.col("_part") == at).drop("_part").write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, many)).parquet(f"{folder}/in")


def _delivered(spark, rows, folder: str, order: tuple[int, ...], many: int):
    """Wide rows cut and sent like those of :func:`_arrivals`, but only one batch is on disk: whenever the stream
    is yielded the caller reads it to its end, then the next batch takes the place of the last.  ``many``: partitions
    that the tables behind the rows are dealt to; joins that want another number would shuffle the texts twice."""
    sliced, stream = _sliced(rows, len(order)), None
    for at in order:
        with session_settings(spark, {"spark.sql.shuffle.partitions": str(many)}):
            sliced.where(F.col("_part") == at).drop("_part").sortWithinPartitions(F.xxhash64(*rows.columns)) \
                .write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/in")
        if stream is None:
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        let_go(spark)
        yield stream
        let_go(spark)


def replay(spark, rows, name: str, transform):
    """Write rows, stream them back through ``transform``, return the result table."""
    folder = _work_folder(spark, name)
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    stream.writeStream.format("parquet").option("path", f"{folder}/out") \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True) \
        .start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("streamed_sender_baseline", "T2", ctes=baseline_sql(500), oracle="SELECT * FROM contacts")
def streamed_sender_baseline(spark, sf):
    """The log arrives in four batches out of order; what they change in each other is corrected."""
    folder = _work_folder(spark, "baseline-")
    log = view(spark, sf, "mail_log").select("id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "from_addr")
    live_baseline.run_baseline_stream(
        _arrivals(spark, log, folder, (1, 0, 3, 2)), folder, lateness=10 * 365 * 86400.0).awaitTermination()
    return live_baseline.streamed_facts(spark, folder).select(
        "id", "user_id", "prior_messages", "address_count", "domain_count", "available",
        "first_time_address", "first_time_domain")


def _bucket_sql(per: float) -> str:
    """A walk of five tokens per ``per`` seconds, request by request."""
    refilled = f"least(5.0::DOUBLE, w.tokens + (o.now - w.now) * 5 / {per}::DOUBLE)"
    return f"""
    WITH RECURSIVE o AS (
      SELECT user_id, event_id, epoch_us(ts) / 1000000::DOUBLE AS now,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
    w AS (
      SELECT user_id, event_id, now, place, 4.0::DOUBLE AS tokens, true AS allowed FROM o WHERE place = 1
      UNION ALL
      SELECT o.user_id, o.event_id, o.now, o.place,
             CASE WHEN {refilled} >= 1 THEN {refilled} - 1 ELSE {refilled} END, {refilled} >= 1
      FROM w JOIN o ON o.user_id = w.user_id AND o.place = w.place + 1)
    SELECT user_id, event_id, allowed FROM w"""


@query("request_rate_limit", "T3", oracle=_bucket_sql(21600.0))
def request_rate_limit(spark, sf):
    """Order-dependent bucket per user, five requests in six hours."""
    return ratelimit.limited(table(spark, sf, "events"), rate=5, per=60 * 60 * 6.0)


@query("request_rate_limit_default", "T3", oracle=_bucket_sql(60.0))
def request_rate_limit_default(spark, sf):
    return ratelimit.limited(table(spark, sf, "events"))


@query("streamed_rate_limit", "T3", oracle=_bucket_sql(21600.0))
def streamed_rate_limit(spark, sf):
    """The events arrive in several files, in order of time from file to file but not within one."""
    folder = _work_folder(spark, "limits-")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    ratelimit.limit_stream(_arrivals(spark, rows, folder), folder, rate=5, per=60 * 60 * 6.0).awaitTermination()
    return ratelimit.stream_decisions(spark, folder)


@query("streamed_lookups", "T4 S15", ctes={
    "asked": "SELECT e.event_id, s.domain, e.ts FROM events e JOIN senders s ON s.k = e.event_id % 16",
    "held": """
      SELECT s.domain, e.event_type <> 'error' AS ok,
             e.ts + CASE WHEN e.event_type <> 'error' THEN INTERVAL 604800 SECOND ELSE INTERVAL 3600 SECOND END AS expires
      FROM (SELECT event_id % 16 AS k, max_by(ts, event_id) AS ts, max_by(event_type, event_id) AS event_type
            FROM events GROUP BY ALL) e JOIN senders s ON s.k = e.k"""}, oracle="""
    SELECT a.event_id, a.domain, coalesce(h.expires > a.ts, FALSE) AS cached, CASE WHEN h.expires > a.ts THEN h.ok END AS ok
    FROM asked a LEFT JOIN held h ON h.domain = a.domain""")
def streamed_lookups(spark, sf):
    """Events ask for sender domains as a stream; the last answer of each domain is the table they join."""
    senders = F.broadcast(view(spark, sf, "senders").select("k", "domain"))     # a fixed list
    events = table(spark, sf, "events").withColumn("k", F.col("event_id") % 16)
    last = events.groupBy("k").agg(
        F.max_by("ts", "event_id").alias("fetched"), (F.max_by("event_type", "event_id") != "error").alias("ok"))
    held = reputation.with_expiry(last.join(senders, "k").select("domain", "fetched", "ok")) \
        .withColumn("created", F.lit(None).cast("string"))
    asked = events.join(senders, "k").select("event_id", "domain", "ts")
    return replay(spark, asked, "lookups-", lambda rows: lookups.with_valid_answer(rows, held)) \
        .select("event_id", "domain", "cached", "ok")


def _as_posted(sql: str) -> str:
    return re.sub(r"\b(FROM|JOIN) letters\b", r"\1 posted", sql)


# What the parser reads of a message with a repeated header: where the first is not there, the repetition counts.
_ARRIVED = {"posted": """SELECT * REPLACE (
                CASE WHEN subject = '' AND msg_id % 8 = 5 THEN 'again' ELSE subject END AS subject,
                CASE WHEN message_id = '' AND msg_id % 8 = 4 THEN '<second@harbor.com>' ELSE message_id END AS message_id)
              FROM letters""",
            **{name: _as_posted(sql) for name, sql in FULL_CTES.items()},
            "before_history": _as_posted(FULL_CTES["before_history"]).replace(
                "UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM g_age_sig\n", "\n"),
            "all_sig": "SELECT * FROM before_history"}


@query("streamed_verdicts", "T1 S1", ctes=_ARRIVED, oracle="""
    SELECT msg_id, raw_score, score, risk_level, reason, trusted AS trusted_sender
    FROM msg_verdicts WHERE msg_id % 50 NOT IN (7, 9)""")
def streamed_verdicts(spark, sf):
    """The raw mail arrives in two batches, each message twice; every message gets one verdict.
    Messages that cannot be parsed get none."""
    folder = _work_folder(spark, "arrivals-")
    raw = view(spark, sf, "raw_mail").select(
        "msg_id", "path", F.encode("raw_text", "UTF-8").alias("content"))
    sent = F.col("created_at").cast("timestamp")
    times = view(spark, sf, "letters").select("msg_id", F.explode(F.array(sent, sent + F.expr("INTERVAL 30 DAYS"))).alias("ts"))
    verdicts = None
    with session_settings(spark, ONE_BATCH):
        for stream in _delivered(spark, raw.join(times, "msg_id"), folder, (0, 1), dealt_partitions(spark, sf)):
            if verdicts is None:
                verdicts = arrivals.verdict_stream(arrivals.first_deliveries(stream.drop("ts")), AS_OF)
            arrivals.store_verdicts(verdicts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "msg_id", "raw_score", "score", "risk_level", "reason", "trusted_sender")
