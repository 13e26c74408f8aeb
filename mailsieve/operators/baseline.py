"""Sender baseline: what a recipient had received before a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.base import string_array
from ..functions.identity import registrable
from ..functions.scores import no_signals, signal
from .scale import prefix_sums

FAMILY = "sender history"


def sender_baseline(log: DataFrame, limit: int = fv.BASELINE_LIMIT,
                    minimum: int = fv.BASELINE_MINIMUM) -> DataFrame:
    """First-contact facts of each message against the recipient's previous ``limit``.

    ``log``: id, user_id, ts, from_addr (parsed).  Messages are numbered per
    recipient with :func:`prefix_sums`, then cut into blocks of ``limit``
    consecutive messages.  A message's window lies in its own block and the one
    before, so copying each row into the next block bounds every group by
    ``2 * limit`` rows, whatever the size of the mailbox.
    """
    senders = log.where(F.col("from_addr").isNotNull()) \
        .select("id", "user_id", "ts", "from_addr",
                registrable(F.substring_index("from_addr", "@", -1)).alias("from_org"))
    numbered = prefix_sums(senders, ["user_id"], ["ts", "id"], {"rn": F.lit(1)})
    block = F.floor((F.col("rn") - 1) / limit)
    blocks = numbered.withColumn("_own", block) \
        .withColumn("_block", F.explode(F.array(block, block + 1))) \
        .repartition("user_id", "_block")

    def before(*who):
        w = Window.partitionBy("user_id", "_block", *who).orderBy("rn").rangeBetween(-limit, -1)
        return F.count(F.lit(1)).over(w)

    prior = F.least(F.col("rn") - 1, F.lit(limit))
    out = blocks.withColumns({"domain_count": before("from_org"),
                              "address_count": before("from_org", "from_addr")}) \
        .where(F.col("_block") == F.col("_own")) \
        .withColumn("prior_messages", prior)
    ready = F.col("prior_messages") >= minimum
    return out.select(
        "id", "user_id", "prior_messages", "address_count", "domain_count",
        ready.alias("available"),
        (ready & (F.col("address_count") == 0)).alias("first_time_address"),
        (ready & (F.col("domain_count") == 0)).alias("first_time_domain"))


def first_contact_signals(signals: str = "signals") -> Column:
    """Signal of a first contact, stronger when the message asks for money or secrets."""
    fired = F.array_distinct(F.transform(signals, lambda s: s["indicator"]))
    context = F.array_sort(F.array_intersect(fired, string_array(fv.PAYMENT_INDICATORS)))
    detail = F.concat(F.lit("prior="), F.col("prior_messages").cast("string"))

    def one(key, evidence):
        name, weight, strength = fv.FIRST_CONTACT[key]
        return F.array(signal(name, weight, strength, evidence, FAMILY))

    return (
        F.when(~F.coalesce("available", F.lit(False)), no_signals())
        .when(F.col("first_time_domain") & (F.size(context) > 0), one(
            "payment", F.concat(detail, F.lit(" with "), F.array_join(context, ", "))))
        .when(F.col("first_time_domain"), one("domain", detail))
        .when(F.col("first_time_address"), one("address", detail))
        .otherwise(no_signals()))
