"""Token-bucket flags per client, for batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import state

DECIDED = "user_id bigint, event_id bigint, allowed boolean"


def bucket(rate: int, per: float):
    """A function that decides one request: (now, tokens, last) to (allowed, tokens).

    It is made inside a function so that it travels to the workers by value and the
    package need not be installed there.
    """
    def decide(now: float, tokens: float, last: float | None):
        if last is not None:
            tokens = min(float(rate), tokens + (now - last) * rate / per)
        return (True, tokens - 1) if tokens >= 1 else (False, tokens)
    return decide


def idle_segments(requests: DataFrame, per: float) -> DataFrame:
    """Number the stretches of a client's requests that idle pauses of ``per`` separate.

    After such a pause the bucket is full again, so stretches are independent.  A pause
    can only lie between two time slots of width ``per``, so it shows in the first and
    last request of each slot, which are aggregated before the shuffle.
    """
    span = int(per * 1_000_000)
    d = requests.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))) \
        .withColumn("_slot", F.floor(F.col("_us") / span))
    in_order = Window.partitionBy("user_id").orderBy("_slot")
    slots = d.groupBy("user_id", "_slot").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"))
    pause = F.coalesce(F.col("lo") - F.lag("hi").over(in_order) >= span, F.lit(False))
    slots = slots.withColumn("_pause", pause.cast("int")) \
        .withColumn("segment", F.sum("_pause").over(in_order)) \
        .select("user_id", "_slot", "segment")
    return d.join(slots, ["user_id", "_slot"]).drop("_us", "_slot")


def _walked(requests: DataFrame, rate: int, per: float) -> DataFrame:
    """Decisions; rows are sorted inside partitions of whole stretches and walked in batches with
    one bucket at a time; nothing is held but the current bucket."""
    decide = bucket(rate, per)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, float(rate), None
        for frame in frames:
            out = []
            seconds = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            for key, event, now in zip(zip(frame["user_id"], frame["segment"]), frame["event_id"], seconds):
                if key != current:
                    current, tokens, last = key, float(rate), None
                allowed, tokens = decide(now, tokens, last)
                last = now
                out.append((key[0], event, allowed))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"]).astype(
                {"user_id": "Int64", "event_id": "Int64", "allowed": "boolean"})

    return (idle_segments(requests.select("user_id", "event_id", "ts"), per).repartition("user_id", "segment")
            .sortWithinPartitions("user_id", "segment", "ts", "event_id")
            .select("user_id", "segment", "event_id", "ts").mapInPandas(walk, DECIDED))


def limited(requests: DataFrame, rate: int = 5, per: float = 60.0) -> DataFrame:
    """Which requests (event_id, user_id, ts) a client's bucket lets through, in order of time
    and event."""
    return _walked(requests, rate, per)


def _handler(rate: int, per: float):
    """The state handler; made here so that it travels to the workers by value."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor
    decide = bucket(rate, per)

    class Bucket(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.bucket = handle.getValueState("bucket", "tokens double, us bigint, expires bigint")

        def handleInputRows(self, key, rows, timerValues):
            tokens, last, expires = float(rate), None, None
            if self.bucket.exists():
                tokens, us, expires = self.bucket.get()
                last = us / 1e6
            latest = us if last is not None else None
            for us, event in sorted((r.us, r.event_id) for r in rows):
                latest = us if latest is None else max(us, latest)        # a late request finds no refill
                allowed, tokens = decide(latest / 1e6, tokens, last)
                last = latest / 1e6
                yield Row(user_id=key[0], event_id=event, allowed=allowed)
            if expires is not None:
                self.handle.deleteTimer(expires)
            expires = -(-(latest + int(per * 1e6)) // 1000)
            self.bucket.update((tokens, latest, expires))
            self.handle.registerTimer(expires)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            """After so long a pause the bucket is full, as is that of a client without state."""
            self.bucket.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Bucket()


def decision_stream(requests: DataFrame, rate: int = 5, per: float = 60.0, lateness: str = "0 seconds") -> DataFrame:
    """Decisions on arriving requests (``event_id, user_id, ts``).

    The state of a client is its bucket, kept by the engine until a timer finds that the client has
    paused for ``per``, when it would be full again; only clients that ask, or whose timer is due, are touched.
    A micro-batch is sorted by client and time before it is walked.  Time is the requests' own; a micro-batch may
    go back by ``lateness`` behind the one before.  A request older than what its client asked last is
    decided as of that; none is dropped but those without time.
    """
    rows = requests.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).where(F.col("ts").isNotNull()) \
        .withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness)
    # without the time column the engine has no late rows to leave out; the watermark still drives the timers
    return rows.select("event_id", "user_id", "us").groupBy("user_id").transformWithState(
        _handler(rate, per), DECIDED, "append", "EventTime")


def limit_stream(requests: DataFrame, folder: str, rate: int = 5, per: float = 60.0, lateness: str = "0 seconds") -> StreamingQuery:
    """Append the decisions on arriving requests to ``folder``; see :func:`decision_stream`."""
    return state.start(decision_stream(requests, rate, per, lateness), f"{folder}/decisions", f"{folder}/state")


def stream_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All decisions that ``limit_stream`` has written."""
    return spark.read.schema(DECIDED).parquet(f"{folder}/decisions")
