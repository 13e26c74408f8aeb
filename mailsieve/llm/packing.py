"""Best-fit packing of token sequences in bulk-synchronous steps.

Documents and gaps are ordered by size.  A superstep takes the documents of one size, longest
first, finds the successor of that size among the gaps (the smallest that holds it), pairs documents with
sequences of that gap by rank, moves these to their new gap and repeats until the size is used up;
what finds no gap opens new sequences.  Documents of one size are interchangeable, and so are
sequences of one gap, so a superstep works on runs (first rank, count): its state is bounded
by the capacity, not by the number of documents.  Spark does what grows with the data: the
token counts, the histogram, the range sort that ranks all documents, and the join that
hands each rank its sequence and offset.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.scale import prefix_sums

from . import bpe
from .common import stage_table

#: Ranks of one row of the plan at most, so that no task expands a long run alone.
RUN = 20_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and one ``end_id``; only a longer one than ``capacity`` is cut.
    A null or empty text is the end id alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = bpe.encoder(path), 1000
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                texts = [t or "" for t in batch.column("text").slice(at, step).to_pylist()]
                rows = []
                for doc_id, raw in zip(batch.column("doc_id").slice(at, step).to_pylist(), enc.encode_many(texts)):
                    raw += end
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start:start + 4 * capacity]
                        rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit supersteps over the histogram ``length -> documents``.

    Returns runs (first rank, documents, first sequence, offset); ranks count documents from the
    longest to the shortest, and document ``first rank + i`` goes to sequence ``first sequence + i``.
    """
    out: list[tuple[int, int, int, int]] = []
    gaps: dict[int, deque] = {}            # gap -> runs of sequences (first, count)
    sizes: list[int] = []                  # gaps with sequences, ascending
    rank = opened = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):           # no successor: open as many as the rest may need
                new = -(-left // (capacity // length))
                gap, runs = capacity, deque([(opened, new)])
                gaps[gap], opened = runs, opened + new
                sizes.append(gap)
            else:
                gap = sizes[at]
                runs = gaps[gap]
            first, many = runs.popleft()
            take = min(many, left)
            if take < many:
                runs.appendleft((first + take, many - take))
            if not runs:
                del gaps[gap], sizes[bisect.bisect_left(sizes, gap)]
            out.append((rank, take, first, capacity - gap))
            rank, left = rank + take, left - take
            if gap > length:
                if gap - length not in gaps:
                    gaps[gap - length] = deque()
                    bisect.insort(sizes, gap - length)
                gaps[gap - length].append((first, take))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack documents into few sequences of at most ``capacity`` tokens.

    Returns a row for each piece: those of ``pieces`` and ``sequence_id, offset``; each sequence is
    filled from 0 without holes.  Repeated rows are packed once each; an empty table gives no rows.
    Other columns are ignored.
    """
    cut = stage_table(pieces(docs, path, capacity, end_id))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = [(rank + k, min(RUN, many - k), first + k, offset)
            for rank, many, first, offset in plan(counts, capacity) for k in range(0, many, RUN)]
    spark = docs.sparkSession
    placed = (spark.createDataFrame(runs, "rank long, many long, first long, offset long")
              .repartition(max(1, min(len(runs), int(spark.conf.get("spark.sql.shuffle.partitions")))))
              .select(F.posexplode(F.sequence(F.col("rank"), F.col("rank") + F.col("many") - 1)).alias("k", "rank"),
                      "first", "offset")
              .select("rank", (F.col("first") + F.col("k")).alias("sequence_id"), "offset"))
    ranked = prefix_sums(cut.withColumn("_size", -F.col("length")).withColumn("_all", F.lit(0)),
                         ["_all"], ["_size", "doc_id", "piece"], {"_count": F.lit(1)})
    return (ranked.withColumn("rank", F.col("_count") - 1).join(placed, "rank")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
