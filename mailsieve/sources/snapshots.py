"""Lookup snapshots: registration dates and DNS answers kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOIS_SCHEMA = "domain string, created string, registrar string, ok boolean, expires timestamp"
DNS_SCHEMA = "name string, rdtype string, value string, status string"


def read_whois(spark: SparkSession, path: str, as_of) -> DataFrame:
    """Unexpired registration answers from JSON lines."""
    now = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return spark.read.schema(WHOIS_SCHEMA).json(path).where(F.col("expires") > now)


def read_dns(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(DNS_SCHEMA).format(format).load(path)
