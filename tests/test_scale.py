"""Skewed keys: the shared building blocks against plain counting."""

from pyspark.sql import functions as F

from mailsieve.operators.baseline import sender_baseline
from mailsieve.operators.scale import prefix_sums, salted_lookup


def _skewed(spark, n=3000):
    # two thirds of all rows belong to user 0
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("user_id"),
        (F.col("id") * 7919 % 1000).alias("t"), (F.col("id") % 5).alias("v"))


def test_prefix_sums(spark):
    rows = prefix_sums(_skewed(spark), ["user_id"], ["t", "id"],
                       {"rn": F.lit(1), "total": F.col("v")}).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.t, r.id)):
        n, total = seen.get(r.user_id, (0, 0))
        seen[r.user_id] = (n + 1, total + r.v)
        assert (r.rn, r.total) == seen[r.user_id]
    assert len(rows) == 3000


def test_baseline_of_a_hot_recipient(spark):
    log = _skewed(spark, 1500).select(
        "id", "user_id", F.timestamp_seconds("t").alias("ts"),
        F.concat(F.lit("u"), F.col("id") % 7, F.lit("@d"), F.col("id") % 4, F.lit(".com"))
        .alias("from_addr"))
    got = {r.id: r for r in sender_baseline(log, limit=20).collect()}
    past = {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.id)):
        prior = past.setdefault(r.user_id, [])[-20:]
        g = got[r.id]
        assert g.prior_messages == len(prior)
        assert g.address_count == sum(p == r.from_addr for p in prior)
        assert g.domain_count == sum(p.split("@")[1] == r.from_addr.split("@")[1] for p in prior)
        past[r.user_id].append(r.from_addr)


def test_salted_lookup_keeps_every_row(spark):
    left = _skewed(spark)
    right = spark.range(40).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("twice"))
    got = salted_lookup(left, right, "user_id", "id")
    assert got.count() == 3000
    assert got.where("twice <> user_id * 2").count() == 0
    assert got.where("twice is null and user_id < 40").count() == 0
