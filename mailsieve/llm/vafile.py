"""Exact top-k inner products with a vector-approximation file.

Each component is quantised to one byte, a cell of a uniform grid between the least and
greatest value of its dimension.  A scan over blocks of cells bounds every score from both sides;
the kth best lower bound sets what a candidate's upper bound must reach.  Of the survivors
exact vectors are read in the order of their bounds (best first) until the kth result is certain.

Queries go in blocks, each met by every block of cells; no pair of rows is formed before the
bounds have cut the candidates.  Of equal vectors only the ``k + 1`` smallest ids can ever be
in a result, so a very common vector does not multiply; rows of equal id and vector are one with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage_table

CELLS = 256
ROWS = 4096       # vectors of a block of cells
QUERIES = 1024    # queries of a block


def integer_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: components as floor(256 * x).  Vectors that are null, empty or hold null or
    non-finite components, and rows without id, take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        "embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256)).alias("v"))


def _blocks(rows: DataFrame, marks: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file: blocks of ids and cells, by dimension count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            values = batch.column("v")
            sizes = np.diff(values.offsets.to_numpy())
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                low, width = marks[int(dim)]
                for at in range(0, len(pick), ROWS):
                    some = pick[at:at + ROWS]
                    x = values.take(pa.array(some)).flatten().to_numpy().reshape(-1, dim)
                    cells = np.clip(np.floor((x - low) / width), 0, CELLS - 1).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([int(dim)], pa.int32()),
                        "ids": [ids[some].astype("<i8").tobytes()], "cells": [cells.tobytes()]})
    return rows.mapInArrow(run, "dim int, ids binary, cells binary")


def _bounds(marks, k: int):
    """Survivors of one block of cells for one block of queries, with their bounds."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()),
                        ("upper", pa.float64()), ("kth", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                low, width = marks[dim]
                ids = np.frombuffer(row["ids"], "<i8")
                cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, dim).astype(np.float64)
                qids = np.asarray(row["query_ids"], np.int64)
                q = np.asarray(row["queries"], np.float64).reshape(-1, dim)
                for at in range(0, len(qids), 64):
                    some, own = q[at:at + 64], qids[at:at + 64]
                    scaled = some * width
                    base = scaled @ cells.T + (some @ low)[:, None]
                    slack = 1 + 1e-9 * (np.abs(some) @ (np.abs(low) + CELLS * width))
                    upper = base + (np.maximum(scaled, 0).sum(1) + slack)[:, None]
                    lower = base + (np.minimum(scaled, 0).sum(1) - slack)[:, None]
                    self_ = own[:, None] == ids[None, :]
                    lower[self_] = -np.inf
                    kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(own), -np.inf)
                    a, b = np.nonzero((upper >= kth[:, None]) & ~self_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[a]), pa.array(ids[b]), pa.array(upper[a, b]), pa.array(kth[a])], schema=schema)
    return run


def _exact(k: int):
    """Best ``k`` of one query; exact vectors are read best bound first until none left can enter."""
    def run(group: pa.Table) -> pa.Table:
        upper = group.column("upper").to_numpy()
        order = np.argsort(-upper, kind="stable")
        q = np.array(group.column("q")[0].as_py(), dtype=object)
        ids, vectors, copies, best = group.column("vec_id"), group.column("v"), group.column("copies"), []
        for at in order:
            if len(best) >= k and upper[at] < best[k - 1][0]:
                break
            score = -int(np.dot(q, np.array(vectors[int(at)].as_py(), dtype=object)))
            best += [(-score, ids[int(at)].as_py())] * min(k, copies[int(at)].as_py())
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        return pa.table({"query_id": pa.array([group.column("query_id")[0].as_py()] * len(best), pa.int64()),
                         "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                         "vec_id": pa.array([b[1] for b in best], pa.int64()),
                         "score": pa.array([b[0] for b in best], pa.int64())})
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact ``k`` best integer inner products of each query: ``query_id, rank, vec_id, score``.

    Both tables are ``vec_id, v`` (see ``integer_vectors``).  Rows with the query's own id are no candidates;
    ties go to the smaller id; vectors of another length than the query's are not compared; with
    fewer candidates than k all are returned.  Repeated query rows count once, repeated candidate
    rows count each.  Scores must fit 64 bits.
    """
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    counted = candidates.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    kept = stage_table(counted.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"))
    asked = queries.dropDuplicates(["vec_id"])
    edges = (kept.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
             .groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim", "at").collect())
    marks: dict = {}                       # two numbers for each dimension
    for r in edges:
        low, width = marks.setdefault(r.dim, ([], []))
        low.append(float(r.low))
        width.append((float(r.high) - float(r.low) + 1) / CELLS)
    marks = {d: (np.array(a), np.array(b)) for d, (a, b) in marks.items()}
    # queries are numbered in blocks by a hash, sized to QUERIES on average
    many = asked.count()
    blocks = max(1, -(-many // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")) \
        .withColumn("dim", F.size("v"))
    grouped = asked.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("_q")).select(
        "dim", "block", F.col("_q.vec_id").alias("query_ids"), F.flatten(F.col("_q.v")).alias("queries"))
    file = _blocks(kept.select("vec_id", "v"), marks).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = file.join(grouped, ["dim", "block"]).repartition(partitions(candidates.sparkSession))
    found = stage_table(met.drop("block").mapInArrow(
        _bounds(marks, k), "query_id long, vec_id long, upper double, kth double"))
    least = found.groupBy("query_id").agg(F.max("kth").alias("least"))
    # an id with several vectors is found once for each of them, and is read with all of the query's length
    left = (found.join(least, "query_id").where(F.col("upper") >= F.col("least"))
            .groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")))
    read = (left.join(kept, "vec_id")
            .join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
            .where(F.size("v") == F.size("q")))
    return read.groupBy("query_id").applyInArrow(_exact(k), "query_id long, rank int, vec_id long, score long")


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
