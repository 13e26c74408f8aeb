"""Expiring lookups for a stream: answers are a table with validity, joined per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import salted_lookup


def with_valid_answer(asked: DataFrame, answers: DataFrame, at: str = "ts") -> DataFrame:
    """Stream-static left join on domain; expired answers count as absent.

    ``answers`` has one row per domain with ``expires``.  Rows that ask for a frequent domain are
    spread by their time, so no domain is one task.
    """
    held = answers.select("domain", F.col("created"), F.col("ok"), "expires")
    d = salted_lookup(asked, held, "domain", at)
    usable = F.col("expires") > F.col(at)
    return d.select(*asked.columns, F.coalesce(usable, F.lit(False)).alias("cached"),
                    F.when(usable, F.col("created")).alias("created"),
                    F.when(usable, F.col("ok")).alias("ok"))
