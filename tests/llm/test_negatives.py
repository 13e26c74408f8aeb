import math
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.llm import negatives


def brute_force(rows):
    fine = {}
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e):
            key = (label, [math.floor(256 * x) for x in e])
            fine[i] = min(fine.get(i, key), key)
    out = []
    for a, (label, v) in fine.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in fine.items()
                        if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(n, i) for n, i, other in scored if other != label and -50 * p <= -100 * n <= -95 * p]
            out += [(a, positive, rank + 1, i, -p, -n) for rank, (n, i) in enumerate(fit[:3])]
    return sorted(out)


def run(spark, rows, bucket=negatives.BUCKET):
    table = negatives.labelled_vectors(spark.createDataFrame(
        [(i, e, c, 1, [2]) for i, e, c in rows], "vec_id long, embedding array<double>, label int, dim int, v array<int>"))
    found = negatives.mine(table, table.where(F.col("vec_id") % 50 == 0), bucket=bucket)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clusters(r, many, dims, labels=4):
    middle = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    for i in range(many):
        c = r.randrange(labels)
        length = r.expovariate(1) + 0.2
        yield i, [length * (m + r.gauss(0, 0.8)) for m in middle[c]], r.randrange(labels) if r.random() < 0.4 else c


@pytest.mark.parametrize("bucket,round_bytes", [(negatives.BUCKET, negatives.ROUND_BYTES), (160, 500)])
def test_equals_brute_force(spark, monkeypatch, bucket, round_bytes):
    monkeypatch.setattr(negatives, "ROUND_BYTES", round_bytes)
    r = random.Random(bucket)
    rows = list(clusters(r, 500, 8))
    common = rows[7][1]
    rows += [(1000 + i, common, i % 3) for i in range(120)]                # one very common vector, anchors among it
    rows += [(2000, None, 1), (2050, [], 1), (2100, [1.0, None] * 4, 1), (2150, [float("nan")] * 8, 0), (2200, [1.0] * 8, None),
             (2250, [0.0] * 8, 1), (2300, [1.0, 2.0], 1), (2301, [3.0, -1.0], 1), (2302, [2.0, 1.0], 0), (None, common, 1),
             (2350, [1e6, -1e6] * 4, 2), (2400, [float("inf")] * 8, 0), (100, common, 0), (100, common, 0)]
    got = run(spark, rows, bucket)
    assert got == brute_force(rows)
    assert len(got) > 100


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    few = [(0, [1.0], 1), (1, [2.0], 1), (2, [1.5], 2), (3, [1.5], 3), (4, [0.5], 2), (5, [1.0], 2)]
    assert run(spark, few) == brute_force(few) == [
        (0, 1, 1, 2, 131072, 98304), (0, 1, 2, 3, 131072, 98304), (0, 1, 3, 5, 131072, 65536)]


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [-0.7, 0.0], 2)]
    assert run(spark, rows) == brute_force(rows) == [(0, 2, 1, 3, 0, 0)]


def test_pruning_reads_few_rows():
    """Nearly all rows fall to the coordinate ranges when a high score must be reached."""
    import numpy as np
    r = np.random.default_rng(3)
    x = r.normal(0, 100, (4000, 8)).astype(np.int64)
    bucket = negatives._Bucket(np.arange(4000), np.zeros(4000, np.int64), x)
    q = x[5].astype(np.float64)
    length = float(np.sqrt(q @ q))
    least = int(0.9 * length * bucket.longest)
    found = bucket.candidates(q, length, least)
    assert set(np.flatnonzero(x @ x[5] >= least)) <= set(found)
    assert len(found) < 400
    assert len(bucket.candidates(q, length, int(1.01 * length * bucket.longest))) == 0
