"""The built-in reference lists as DataFrames, for inspection or replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fv

LISTS = {
    "brands": fv.BRANDS,
    "brand_owned": fv.BRAND_OWNED_DOMAINS,
    "trusted": fv.TRUSTED_SENDER_DOMAINS,
    "mail_platforms": fv.ESP_DOMAINS,
    "free_mail": fv.FREE_MAIL_DOMAINS,
    "high_risk_tlds": fv.HIGH_RISK_TLDS,
    "common_tlds": fv.COMMON_TLDS,
    "suffixes": fv.MULTI_LABEL_SUFFIXES,
    "shorteners": fv.SHORTENER_HOSTS,
    "risky_extensions": fv.RISKY_EXTENSIONS,
    "mailers": fv.SUSPICIOUS_MAILERS,
}


def reference_lists(spark: SparkSession) -> DataFrame:
    """(list, ord, value)"""
    rows = [(name, i, v) for name, values in LISTS.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "list string, ord int, value string")


def magic_numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, h, label) for i, (h, label) in enumerate(fv.MAGIC_NUMBERS)],
        "ord int, magic_hex string, label string")
