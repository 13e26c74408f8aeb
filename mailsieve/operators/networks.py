"""Range join of addresses to networks, by an index on (length, masked number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ipv4_number, is_ipv6
from .dnsauth import ipv6_hex
from .scale import distinct_values, durable, salted_lookup

#: Copies of the networks that each of the addresses' salts meets.
SALTS = 16


def address_bits(ip) -> Column:
    """The bits of an IPv4 or IPv6 address as text; null if it is neither."""
    v6 = ipv6_hex(ip)
    half = [F.lpad(F.conv(F.substring(v6, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    v4 = F.lpad(F.conv(ipv4_number(ip).cast("string"), 10, 2), 32, "0")
    return F.when(is_ipv6(ip) & (F.length(v6) == 32), F.concat(*half)).otherwise(v4)


def network_parts(network) -> tuple[Column, Column]:
    """Bits and length of ``address`` or ``address/length``; both null if it is no network."""
    bits = address_bits(F.substring_index(network, "/", 1))
    stated = F.when(F.contains(network, F.lit("/")), F.coalesce(
        F.regexp_extract(network, r"/(\d+)$", 1).try_cast("int"), F.lit(-1))).otherwise(F.length(bits))
    fits = (stated >= 0) & (stated <= F.length(bits))
    return F.when(fits, bits), F.when(fits, stated)


def indexed(networks: DataFrame, column: str = "network") -> DataFrame:
    """Networks with ``wide`` (bits of an address of the family), ``length`` and the masked number as ``prefix``.

    Text that is no network, or one longer than an address, is left out.
    """
    bits, length = network_parts(column)
    return networks.withColumns({"wide": F.length(bits), "length": length, "prefix": F.substring(bits, F.lit(1), length)}) \
        .where(F.col("prefix").isNotNull())


def match_networks(rows: DataFrame, networks: DataFrame, column: str = "ip") -> DataFrame:
    """The longest network that holds each row's address, with its columns, or null where none does.

    An address asks once for each length that occurs among the networks (at most 33 and 129), so
    a match is an equality of (family, length, masked number): no address meets a network that does not hold
    it.  Addresses are made distinct first, and a short network that holds very many of them is met in ``SALTS``
    parts.  Of networks that are equal the least by text answers.  Null, empty and malformed addresses match
    nothing; no row is lost or repeated.  ``networks`` has a column ``network``; its other columns must not clash with those of ``rows``.
    """
    index = durable(indexed(networks))
    lengths = index.groupBy("wide").agg(F.collect_set("length").alias("lengths")).collect()     # two rows, 162 numbers at most
    asked = distinct_values(rows, column).withColumn("_bits", address_bits(column))
    tries = F.array().cast("array<int>")
    for r in lengths:
        tries = F.when(F.length("_bits") == r.wide, F.array(*[F.lit(n) for n in sorted(r.lengths)])).otherwise(tries)
    keys = ["wide", "length", "prefix", "_salt"]
    keyed = asked.withColumn("length", F.explode(tries)).select(
        column, F.length("_bits").alias("wide"), "length", F.substring("_bits", F.lit(1), F.col("length")).alias("prefix"),
        F.pmod(F.xxhash64(column), F.lit(SALTS)).alias("_salt"))
    carried = [c for c in networks.columns]
    copies = index.groupBy("wide", "length", "prefix").agg(F.min_by(F.struct(*carried), "network").alias("_net")) \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    best = keyed.join(copies, keys).groupBy(column).agg(F.max_by(F.struct("_net", "length"), "length").alias("_best"))
    # rows of one very common address are spread by their other columns
    spread = salted_lookup(rows.withColumn("_spread", F.xxhash64(*rows.columns)), best, column, "_spread")
    return spread.select(
        *rows.columns, *[F.col(f"_best._net.{c}").alias(c) for c in carried])
