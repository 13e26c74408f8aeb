"""Running sender baseline per recipient, with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..functions.identity import registrable
from . import state

FACTS = ("id bigint, user_id bigint, prior_messages bigint, address_count bigint, domain_count bigint, "
         "available boolean, first_time_address boolean, first_time_domain boolean, revision int")


def _handler(limit: int, minimum: int, lateness_us: int, ttl_ms: int | None):
    """The state handler; made here so that it travels to the workers by value.

    A recipient's messages are kept in order of time, in blocks of an eighth of ``limit`` with the time and id of
    their last message.  Only blocks from the earliest arrival on, and of ``limit`` messages before it, are unpacked.
    """
    import pickle
    from bisect import bisect_left
    from collections import Counter

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    size = max(1, limit // 8)

    def counted(messages: list, first: int) -> list[tuple]:
        """(prior, address, domain) of the messages from ``first`` on, against ``limit`` before each."""
        held = messages[max(0, first - limit):first]
        domains, addresses = Counter(m[3] for m in held), Counter((m[3], m[2]) for m in held)
        out = []
        for at in range(first, len(messages)):
            _, _, address, domain, _ = messages[at]
            out.append((min(at, limit), addresses[domain, address], domains[domain]))
            domains[domain] += 1
            addresses[domain, address] += 1
            if at >= limit:
                _, _, address, domain, _ = messages[at - limit]
                domains[domain] -= 1
                addresses[domain, address] -= 1
        return out

    def packed(messages: list) -> list[tuple]:
        parts = [messages[k:k + size] for k in range(0, len(messages), size)]
        return [(*part[-1][:2], len(part), pickle.dumps(part, 5)) for part in parts]

    def recent(blocks: list[tuple]) -> list[tuple]:
        """Blocks without what lies before the horizon and the ``limit`` messages before that."""
        horizon, begin = blocks[-1][0] - lateness_us, 0
        for until, _, many, raw in blocks:
            if until >= horizon:
                begin += bisect_left(pickle.loads(raw), horizon, key=lambda m: m[0])
                break
            begin += many
        drop, at = max(0, begin - limit), 0
        while drop >= blocks[at][2]:
            drop, at = drop - blocks[at][2], at + 1
        return [*packed(pickle.loads(blocks[at][3])[drop:]), *blocks[at + 1:]] if drop else blocks[at:]

    class Baseline(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getListState("blocks", "us bigint, id bigint, messages int, packed binary", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            blocks = [(r[0], r[1], r[2], bytes(r[3])) for r in self.kept.get()] if self.kept.exists() else []
            new = {(r.us, r.id): (r.us, r.id, r.from_addr, r.from_org, 0) for r in rows}
            if not new:
                return
            earliest = min(new)
            at = next((k for k, b in enumerate(blocks) if b[:2] >= earliest), len(blocks))
            kept = [m for b in blocks[at:] for m in pickle.loads(b[3])]
            known = {m[:2] for m in kept}
            new = {k: m for k, m in new.items() if k not in known}
            if not new:
                return
            earliest = min(new)
            before = sum(m[:2] < earliest for m in kept)
            while at and before < limit:
                at -= 1
                kept, before = pickle.loads(blocks[at][3]) + kept, before + blocks[at][2]
            both = sorted([*kept, *new.values()], key=lambda m: m[:2])
            first = next(i for i, m in enumerate(both) if m[:2] in new)
            # facts of messages behind a late one may have changed
            old = dict(zip([m[:2] for m in kept[first:]], counted(kept, first)))
            for place, facts in enumerate(counted(both, first), first):
                us, message, address, domain, revision = both[place]
                if old.get((us, message)) == facts:
                    continue
                if (us, message) in old:
                    revision += 1
                    both[place] = (us, message, address, domain, revision)
                prior, addresses, domains = facts
                ready = prior >= minimum
                yield Row(id=message, user_id=key[0], prior_messages=prior, address_count=addresses, domain_count=domains,
                          available=ready, first_time_address=ready and not addresses,
                          first_time_domain=ready and not domains, revision=revision)
            self.kept.put(recent(blocks[:at] + packed(both)))

        def close(self) -> None:
            pass

    return Baseline()


def baseline_stream(log: DataFrame, limit: int = fv.BASELINE_LIMIT, minimum: int = fv.BASELINE_MINIMUM,
                    lateness: float = 86400.0, ttl: float | None = None) -> DataFrame:
    """First-contact facts of each arriving message (``id, user_id, ts, from_addr``).

    The state of a recipient is the list of its messages, in blocks, of the last ``lateness`` seconds and the
    ``limit`` before those; only recipients with new mail are read and written.  A message that is late by no
    more than that gets the facts of its own time, and later messages whose facts it changes are
    sent again with a higher ``revision``.  One that is later still is compared with what is kept.  A message that
    is delivered again is ignored.  Messages without sender are left out; those without time come first.  With
    ``ttl`` (seconds) the store forgets recipients without mail for so long.
    """
    rows = log.where(F.col("from_addr").isNotNull()).select(
        "id", "user_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 60))).alias("us"), "from_addr",
        registrable(F.substring_index("from_addr", "@", -1)).alias("from_org"))
    handler = _handler(limit, minimum, int(lateness * 1e6), None if ttl is None else int(ttl * 1000))
    return rows.groupBy("user_id").transformWithState(
        handler, FACTS, "append", "None" if ttl is None else "ProcessingTime")


def run_baseline_stream(log: DataFrame, folder: str, limit: int = fv.BASELINE_LIMIT,
                        minimum: int = fv.BASELINE_MINIMUM, lateness: float = 86400.0) -> StreamingQuery:
    """Append the facts of arriving messages to ``folder``; see :func:`baseline_stream`."""
    return state.start(baseline_stream(log, limit, minimum, lateness), f"{folder}/facts", f"{folder}/state")


def streamed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The last revision of all facts that the stream has written."""
    facts = spark.read.schema(FACTS).parquet(f"{folder}/facts")
    rest = [c for c in facts.columns if c not in ("id", "user_id", "revision")]
    return facts.groupBy("id", "user_id").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("id", "user_id", "r.*")
