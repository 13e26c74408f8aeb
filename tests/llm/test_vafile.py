import math
import random

from pyspark.sql import functions as F

from mailsieve.llm import vafile


def brute_force(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
            if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, v in {i: v for i, v in fine if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    table = vafile.integer_vectors(spark.createDataFrame(
        [(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, block int"))
    found = vafile.top_k(table, table.where(F.col("vec_id") % 50 == 0)).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def test_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(600)]
    common = [0.5] * 16
    rows += [(1000 + i, common) for i in range(200)]                    # one very common vector, among it queries
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 8), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16),
             (2250, [0.0] * 16), (2300, [1.0, 2.0]), (2301, [3.0, -1.0]), (None, common), (2350, [1e6, -1e6] * 8)]
    assert run(spark, rows) == brute_force(rows)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [2.0]), (4, [2.0])]) == [(0, 1, 3, 131072), (0, 2, 4, 131072)]
    assert run(spark, []) == []


def test_repeated_ids(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(1, 400) if i % 50]
    best = [2.0] * 8
    rows += [(50, best)] * 9 + [(1001, best), (1002, best)]                  # a query's own copies do not push others out
    rows += [(1010, [1.5] * 8)] * 2 + [(1020, [1.2] * 8)] * 12               # candidates count once for each row
    rows += [(1030, [1.4] * 8), (1030, [1.3] * 8), (1030, [1.3] * 8), (1030, [9.0] * 3)]   # an id of several vectors
    rows += [(1050, [0.1] * 8), (1100, [-0.1] * 8), (1150, [1.0, 0.0, 0.0])]
    got = run(spark, rows)
    assert got == brute_force(rows)
    assert [x[2] for x in got if x[0] == 50] == [1001, 1002, 1010, 1010, 1030]
    few = [(50, [1.0]), (1, [2.0]), (1, [2.0]), (2, [2.0])]
    assert run(spark, few) == [(50, 1, 1, 131072), (50, 2, 1, 131072), (50, 3, 2, 131072)] == brute_force(few)
