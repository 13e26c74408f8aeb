"""Which hashes occur in more than one unit of documents: the exchange both substring operators use.

Documents with neighbouring ids form units; all that a unit sends about itself is the sorted set
of its distinct 64-bit hashes, cut by value into buckets.  A bucket finds the hashes that
several units hold and answers each unit.  A hash counts once for each unit however often it occurs there, so a
passage that a third of all documents share weighs no more than one that few share.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remembered

#: Document ids of a unit; a unit is one group in a task.
UNIT = 1024
#: Bytes of text that numpy works on at once (a longer document is taken alone).
CHUNK = 250_000
#: Buckets of the exchange for each shuffle partition; a bucket is one group in a task.
BUCKETS = 4
_STEP = np.uint64((1 << 48) - 1)


def with_units(docs: DataFrame) -> DataFrame:
    """``unit, doc_id, text`` of rows that have an id; a null text is empty."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.floor(F.col("doc_id") / UNIT).alias("unit"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values: the first whole, then gaps of six bytes; a wider gap takes filler steps.

    The values of a high bucket would else begin with tens of thousands of steps.
    """
    gaps = np.diff(values)
    fill = (gaps // _STEP).astype(np.int64)
    if fill.any():
        out = np.full(int(fill.sum()) + len(gaps), _STEP)
        out[np.cumsum(fill + 1) - 1] = gaps % _STEP
        gaps = out
    return values[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    six = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 6)
    gaps = np.zeros((len(six) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(raw, np.uint8, 8)
    gaps[1:, :6] = six
    gaps = gaps.view("<u8").ravel()
    real = gaps != _STEP
    real[0] = True
    return np.cumsum(gaps, dtype=np.uint64)[real]


def sorted_docs(group: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and UTF-8 texts of a unit, by id (then text, so that repeated ids have an order)."""
    rows = sorted(zip(group.column("doc_id").to_pylist(),
                      group.column("text").cast(pa.binary()).to_pylist()))
    return [r[0] for r in rows], [r[1] for r in rows]


def chunks(texts: list[bytes]):
    """Index ranges of texts of about ``CHUNK`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def shared(units: DataFrame, hashes: Callable[[list[bytes]], np.ndarray], first_keeps: bool) -> DataFrame:
    """``unit, raw``: packed hashes of each unit that other units hold as well.

    ``hashes`` gives the distinct sorted hashes of a unit's texts.  With ``first_keeps`` only units
    after the first that holds a hash are answered; else all of them.
    """
    buckets = BUCKETS * partitions(units.sparkSession)
    borders = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=object).astype(np.uint64)
    sent = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("raw", pa.binary())])

    def send(group: pa.Table) -> pa.Table:
        remembered("repeats", dict)
        values = hashes(sorted_docs(group)[1])
        parts = np.split(values, np.searchsorted(values, borders))
        held = [(b, pack(p)) for b, p in enumerate(parts) if len(p)]
        unit = group.column("unit")[0].as_py()
        return pa.Table.from_arrays([pa.array([b for b, _ in held], pa.int32()),
                                     pa.array([unit] * len(held), pa.int64()),
                                     pa.array([r for _, r in held], pa.binary())], schema=sent)

    def answer(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("unit").to_pylist(), group.column("raw").to_pylist()))
        lists = [unpack(raw) for _, raw in rows]
        values = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        count, lists = len(lists), None
        order = np.argsort(values, kind="stable")        # units ascend within a value
        values, owner = values[order], owner[order]
        again = np.zeros(len(values), bool)
        again[1:] = values[1:] == values[:-1]
        if not first_keeps and len(again):
            again[:-1] |= again[1:]
        values, owner = values[again], owner[again]
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
        ends = np.searchsorted(owner, np.arange(count + 1))
        held = [(rows[k][0], pack(values[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        return pa.table({"unit": pa.array([u for u, _ in held], pa.int64()),
                         "raw": pa.array([r for _, r in held], pa.binary())})

    return (units.groupBy("unit").applyInArrow(send, "bucket int, unit long, raw binary")
            .groupBy("bucket").applyInArrow(answer, "unit long, raw binary"))


def answers(group: pa.Table) -> np.ndarray:
    """Sorted hashes out of a unit's answers."""
    raws = group.column("raw").to_pylist()
    return np.sort(np.concatenate([unpack(r) for r in raws])) if raws else np.zeros(0, np.uint64)


def contains(values: np.ndarray, looked_up: np.ndarray) -> np.ndarray:
    """Which of ``looked_up`` are among sorted ``values``."""
    if not len(values):
        return np.zeros(len(looked_up), bool)
    at = np.minimum(np.searchsorted(values, looked_up), len(values) - 1)
    return values[at] == looked_up


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions under any of the spans (ends exclusive)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and exclusive ends of the stretches of true flags."""
    edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
