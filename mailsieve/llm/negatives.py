"""Hard negatives by coordinate pruning in length buckets.

The index holds the vectors by length, longest first; neighbours form a bucket with a sorted list
of the normalised values of every coordinate.  For an anchor and a score that must be reached,
a bucket asks for a least cosine.  If its longest vector cannot give it, the bucket is skipped.
Otherwise the anchor's largest coordinates are its focus: a unit vector within the angle
can only have values in a certain range there, a range is a slice of a sorted list, and the candidates
are the rows in all slices.  Their scores are computed exactly, in integers.

Anchors go in rounds of bounded bytes; a round is broadcast to the index, which stays where it
is.  A task carries what it has found for an anchor from bucket to bucket, so the score to reach
rises as it goes; tasks' findings are merged by anchor, a few rows from each.  Sorted lists are made
when a bucket is read: that costs little beside a round's anchors, and the stored rows stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage_table

#: Values (rows times dimensions) of a bucket, and bytes of a round of anchors.
BUCKET, ROUND_BYTES = 1 << 18, 8 << 20
#: Focus coordinates of an anchor.
FOCUS = 6
#: Slack for values stored as 32-bit floats and for rounding in the angles.
SLACK = 2e-6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: components as floor(256 * x).

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
    part.  An id names one row: of rows that share it the least by (label, vector) stands for all.
    Other columns are ignored.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        "embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(e * 256)).alias("v"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.*")


def _index(vectors: DataFrame) -> DataFrame:
    """The vectors in length buckets: by dimensions, longest first."""
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    keys = ["dim", "short", "vec_id"]
    return stage_table(vectors.withColumns({"dim": F.size("v"), "short": -length})
                       .repartitionByRange(partitions(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
                       .select("vec_id", "label", "v"))


class _Bucket:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.longest = float(lengths.max())
        unit = (vectors / np.where(lengths > 0, lengths, 1)[:, None]).astype(np.float32).T
        self.order = np.argsort(unit, axis=1, kind="stable")
        self.values = np.take_along_axis(unit, self.order, 1)

    def candidates(self, q: np.ndarray, length: float, least: int) -> np.ndarray | None:
        """Rows that may score ``least`` with ``q``; None if they must all be looked at."""
        if least <= 0:
            return None
        reach = length * self.longest
        if reach < least * (1 - 1e-9):
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, least * (1 - 1e-9) / reach))
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(q[focus] / length, -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
        high = np.cos(np.maximum(0, own - angle)) + SLACK
        found = None
        for f, a, b in zip(focus.tolist(), low, high):
            values = self.values[f]
            first, last = np.searchsorted(values, np.float32(a), "left"), np.searchsorted(values, np.float32(b), "right")
            if last - first == len(values):
                continue
            inside = np.zeros(len(values), bool)
            inside[self.order[f, first:last]] = True
            found = inside if found is None else found & inside
            if not found.any():
                break
        return None if found is None else np.flatnonzero(found)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Bucket]:
    for batch in batches:
        lists = batch.column("v")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        dims = np.diff(at)
        edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for a, b in zip(edges, edges[1:]):
            step = max(1, size // int(dims[a])) if b > a else 1
            for c in range(a, b, step):
                d = min(b, c + step)
                yield _Bucket(ids[c:d], labels[c:d], values[at[c]:at[d]].reshape(d - c, -1))


def _search(some, k: int, same: bool, size: int):
    """Best ``k`` rows of a task for each anchor and ceiling: of its own label, or of others, with
    scores between floor and ceiling."""
    schema = pa.schema([("anchor_id", pa.int64()), ("ceiling", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        anchors = [(i, label, q := np.array(v, np.int64), float(np.sqrt((q.astype(np.float64) ** 2).sum())), limits)
                   for i, label, v, limits in some.value]
        found = [[nothing] * len(a[4]) for a in anchors]
        for bucket in _buckets(batches, size):
            for (own, label, q, length, limits), held in zip(anchors, found):
                if len(q) != bucket.vectors.shape[1]:
                    continue
                # what a row must score to change any of the lists
                least = min(max(low, int(s[-1])) if len(s) == k else low for (low, _), (s, _) in zip(limits, held))
                rows = bucket.candidates(q.astype(np.float64), length, least)
                fits = ((bucket.labels if rows is None else bucket.labels[rows]) == label) == same
                rows = np.flatnonzero(fits) if rows is None else rows[fits]
                rows = rows[bucket.ids[rows] != own]
                if not len(rows):
                    continue
                scores, ids = bucket.vectors[rows] @ q, bucket.ids[rows]
                for n, (low, top) in enumerate(limits):
                    fine = (scores >= low) & (scores <= top)
                    if fine.any():
                        held[n] = _best(np.append(held[n][0], scores[fine]), np.append(held[n][1], ids[fine]), k)
        for (own, _, _, _, limits), held in zip(anchors, found):
            for (_, top), (s, i) in zip(limits, held):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), own)), pa.array(np.full(len(s), top)),
                                                      pa.array(i), pa.array(s)], schema=schema)
    return run


def _merged(index: DataFrame, anchors: DataFrame, k: int, same: bool, size: int) -> DataFrame:
    """Best ``k`` of all tasks by anchor and ceiling, ranked: ``anchor_id, ceiling, vec_id, score, rank``.

    Anchors are ``vec_id, label, v, limits``, a list of (floor, ceiling)."""
    ddl = "anchor_id long, ceiling long, vec_id long, score long"
    spark = index.sparkSession
    found = spark.createDataFrame([], ddl)
    size = anchors.agg(F.sum(8 * F.size("v"))).first()[0]
    rounds = -(-(size or 0) // ROUND_BYTES)
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rounds)))
    for at in range(rounds):
        # ROUND_BYTES on average: bounded, whatever the table's size
        some = [(r.vec_id, r.label, r.v, [tuple(x) for x in r.limits])
                for r in anchors.where(number == at).select("vec_id", "label", "v", "limits").collect()]
        sent = spark.sparkContext.broadcast(some)
        found = found.unionByName(stage_table(index.mapInArrow(_search(sent, k, same, size), ddl)))
        sent.unpersist()
    best = Window.partitionBy("anchor_id", "ceiling").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, bucket: int = BUCKET) -> DataFrame:
    """Hard negatives of every anchor: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both tables are ``vec_id, label, v`` (see ``labelled_vectors`` for nulls and repeated ids).  An anchor's positives are
    the best ``positives`` other rows of its label; for each of them the best ``negatives`` rows of other labels
    whose score in percent of the positive's is between ``low`` and ``high``.  Ties go to the smaller id; vectors
    of another length than the anchor's are not compared; with fewer rows all are returned; a
    negative positive score admits none, and empty tables give no rows.  Scores must fit 64 bits.
    """
    # of equal vectors of a label only so many smallest ids can be in a result, one of them the anchor's own
    alike = Window.partitionBy("label", F.xxhash64("v"), "v").orderBy("vec_id")
    kept = vectors.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= max(positives, negatives) + 1).drop("_n")
    index = _index(kept)
    limit = F.struct(F.lit(int(LEAST)).alias("floor"), F.lit(int(MOST)).alias("ceiling"))
    asked = stage_table(anchors.select("vec_id", "label", "v"))
    best = stage_table(_merged(index, asked.withColumn("limits", F.array(limit)), positives, True, bucket)
                       .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    window = best.withColumns({"floor": F.ceil(score * low / 100).cast("bigint"), "ceiling": F.floor(score * high / 100).cast("bigint")}) \
        .where(F.col("floor") <= F.col("ceiling"))
    limits = window.groupBy(F.col("anchor_id").alias("vec_id"), "ceiling").agg(F.min("floor").alias("floor")) \
        .groupBy("vec_id").agg(F.collect_list(F.struct("floor", "ceiling")).alias("limits"))
    found = _merged(index, asked.join(limits, "vec_id"), negatives, False, bucket)
    return window.join(found, ["anchor_id", "ceiling"]).where(F.col("score") >= F.col("floor")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (
  SELECT vec_id, min({'l': label, 'v': v}) AS m FROM (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.m.l = c.m.l AS same,
    CAST(list_inner_product(CAST(a.m.v AS DOUBLE[]), CAST(c.m.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.m.v) = len(c.m.v) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
