"""IP addresses and Received headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, col, let, strip, text
from .mailtime import parse_mail_date

HOP_IP = r"\[([0-9a-fA-F:.]+)\]|\b(\d{1,3}(?:\.\d{1,3}){3})\b"
VALID_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"
IPV4_IN_TEXT = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"


def ipv4_number(ip) -> Column:
    """Dotted quad to a 32-bit number, NULL when not a valid IPv4 address."""
    quads = F.split(col(ip), r"\.")
    value = F.aggregate(quads, F.lit(0).cast("bigint"),
                        lambda acc, q: acc * 256 + q.try_cast("bigint"))
    return F.when(text(ip).rlike(VALID_IPV4), value)


def _in_block(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    low = 0
    for part in base.split("."):
        low = low * 256 + int(part)
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


# IPv4 blocks that are not globally reachable.
NOT_GLOBAL_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]


def _any_block(number, blocks):
    hit = _in_block(number, blocks[0])
    for block in blocks[1:]:
        hit = hit | _in_block(number, block)
    return hit


def is_ipv6(ip) -> Column:
    return text(ip).rlike(r"^(?=.*:.*:)[0-9a-fA-F:]{2,39}$")


def ip_class(ip) -> Column:
    """Loopback / Private / CGNAT / Public / Invalid / Unknown."""
    def decide(v):
        number, shown = v["number"], v["shown"]
        v6_local = shown.rlike(r"^f[cd]|^fe[89ab]|^2001:db8") | (shown == "::")
        return (
            F.when(shown == "", F.lit("Unknown"))
            .when(_in_block(number, "127.0.0.0/8") | (shown == "::1"), F.lit("Loopback"))
            .when(_any_block(number, NOT_GLOBAL_BLOCKS), F.lit("Private"))
            .when(_in_block(number, "100.64.0.0/10"), F.lit("CGNAT"))
            .when(number.isNotNull(), F.lit("Public"))
            .when(is_ipv6(shown) & v6_local, F.lit("Private"))
            .when(is_ipv6(shown), F.lit("Public"))
            .otherwise(F.lit("Invalid")))

    return let(decide, number=ipv4_number(ip), shown=F.lower(text(ip)))


def is_routable(ip) -> Column:
    """Could have opened a connection from the internet."""
    def decide(v):
        number = v["number"]
        v4 = number.isNotNull() & ~_any_block(number, NOT_GLOBAL_BLOCKS + ["224.0.0.0/4"])
        v6 = is_ipv6(v["shown"]) & (v["kind"] == "Public") \
            & ~F.startswith(v["shown"], F.lit("ff"))
        return F.coalesce(v4, F.lit(False)) | v6

    return let(decide, number=ipv4_number(ip), shown=F.lower(text(ip)), kind=ip_class(ip))


def candidate_ips(value) -> Column:
    """Every address in a header: bracketed ones first, then bare IPv4."""
    return F.concat(
        F.regexp_extract_all(text(value), F.lit(r"\[([0-9a-fA-F:.]+)\]"), F.lit(1)),
        F.regexp_extract_all(text(value), F.lit(IPV4_IN_TEXT), F.lit(0)))


def sending_ip(received_chain, originating_headers) -> Column:
    """First routable address, newest Received header first, then originating-IP headers."""
    def routable(values):
        return F.get(F.filter(F.flatten(F.transform(values, candidate_ips)), is_routable), F.lit(0))
    return F.coalesce(routable(col(received_chain)), routable(col(originating_headers)))


def received_host(raw) -> Column:
    """Host in the ``by`` clause as used for attribution."""
    return blank_to_null(F.btrim(
        F.lower(F.regexp_extract(text(raw), r"(?i)\bby\s+([A-Za-z0-9._-]+)", 1)), F.lit(".")))


def hop_fields(raw) -> dict[str, Column]:
    """Columns parsed out of one Received header."""
    r = text(raw)

    def clause(word):
        return blank_to_null(F.regexp_extract(r, rf"(?i)\b{word}\s+([^\s;]+)", 1))

    ip = F.coalesce(blank_to_null(F.regexp_extract(r, HOP_IP, 1)),
                    blank_to_null(F.regexp_extract(r, HOP_IP, 2)))
    stamp = F.when(F.contains(r, F.lit(";")), strip(F.substring_index(r, ";", -1)))
    return {
        "from_host": clause("from"),
        "by_host": clause("by"),
        "ip": ip,
        "protocol": clause("with"),
        "recipient": blank_to_null(F.regexp_extract(r, r"(?i)\bfor\s+<([^>]+)>", 1)),
        "stamp": stamp,
        "ts": parse_mail_date(stamp),
    }
