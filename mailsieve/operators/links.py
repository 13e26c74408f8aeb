"""Links: extraction, normalisation, risk flags and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import identity as ident
from ..functions import urls
from ..functions.base import among, compact, explode_rows, extend, let, strip, text
from ..functions.scores import signal
from ..functions.text import decode_entities

FAMILY = "link forensics"


def _raw_links(body_html, body_plain) -> Column:
    """Links of the HTML part, then of the plain part, as (raw, anchor).

    An element ends at the first closing tag after it opens, so the text is cut at the closing tags and
    each piece is searched once; elements that never close cost no second look at what follows.
    """
    def anchor_link(piece):
        return F.struct(
            strip(F.regexp_extract(piece, urls.OPEN_ANCHOR, 1)).alias("raw"),
            strip(F.regexp_replace(F.regexp_extract(piece, urls.OPEN_ANCHOR, 2), r"<[^>]+>", "")).alias("anchor"))

    def closed(v):
        return F.filter(F.slice(v["pieces"], F.lit(1), F.size(v["pieces"]) - 1), lambda p: p.rlike(urls.OPEN_ANCHOR))

    in_html = F.transform(let(closed, pieces=F.split(text(body_html), urls.ANCHOR_END, -1)), anchor_link)
    in_text = F.transform(
        F.regexp_extract_all(text(body_plain), F.lit(urls.PLAIN_URL), F.lit(0)),
        lambda u: F.struct(strip(u).alias("raw"), F.lit("").alias("anchor")))
    return F.concat(in_html, in_text)


def _first_of_each(links: Column) -> Column:
    """Drop repeats of a raw URL and links that lead nowhere; sorted, so repeats are neighbours."""
    def ordered(v):
        return F.array_sort(F.transform(v["links"], lambda u, i: F.struct(
            u["raw"].alias("raw"), i.alias("at"), u["anchor"].alias("anchor"))))

    def distinct(v):
        first = F.filter(v["sorted"], lambda u, i: (
            (i == 0) | (F.get(v["sorted"], i - 1)["raw"] != u["raw"])) & ~urls.is_skipped(u["raw"]))
        placed = F.array_sort(F.transform(first, lambda u: F.struct(
            u["at"].alias("at"), u["raw"].alias("raw"), u["anchor"].alias("anchor"))))
        return F.transform(placed, lambda u: F.struct(u["raw"].alias("raw"), u["anchor"].alias("anchor")))
    return let(lambda v: let(distinct, sorted=ordered(v)), links=links)


def with_links(messages: DataFrame) -> DataFrame:
    """Add ``links``: array of analysed links in order of first appearance."""
    d = messages.withColumn("links", _first_of_each(_raw_links("body_html", "body_plain")))
    d = d.withColumn("links", extend(F.col("links"), url=lambda u: decode_entities(u["raw"])))
    d = d.withColumn("links", extend(F.col("links"), host=lambda u: urls.host(u["url"])))
    d = d.withColumn("links", extend(
        F.col("links"),
        normalised=lambda u: urls.normalised(u["url"], u["host"]),
        is_ip=lambda u: ident.is_ipv4_host(u["host"]),
        is_shortener=lambda u: urls.is_shortener(u["host"]),
        risky_tld=lambda u: among(ident.tld(u["host"]), fv.HIGH_RISK_TLDS),
        idn=lambda u: ident.idn_reason(u["host"]),
        lookalike=lambda u: ident.lookalike_brand(u["host"]),
        redirect=lambda u: urls.open_redirect(u["url"]),
        leaves_site=lambda u: urls.redirects_elsewhere(u["raw"]),
        claims=lambda u: F.when((u["anchor"] != "") & (u["host"] != ""),
                                urls.claimed_host(u["anchor"]))))
    d = d.withColumn("links", extend(
        F.col("links"),
        is_suspicious=lambda u: u["risky_tld"] | u["idn"].isNotNull() | u["lookalike"].isNotNull(),
        is_mismatched=lambda u: u["claims"].isNotNull()
        & (ident.registrable(u["claims"]) != ident.registrable(u["host"]))))
    return d.withColumn("links", extend(F.col("links"), findings=lambda u: compact(
        F.when(u["is_ip"], F.concat(F.lit("ip:"), u["host"])),
        F.when(u["is_shortener"], F.concat(F.lit("shortener:"), u["host"])),
        F.when(u["risky_tld"], F.concat(F.lit("tld:"), ident.tld(u["host"]))),
        u["idn"],
        F.when(u["lookalike"].isNotNull(), F.concat(F.lit("lookalike:"), u["lookalike"])),
        F.when(u["redirect"].isNotNull(), F.concat(F.lit("redirect:"), u["redirect"])),
        F.when(u["is_mismatched"], F.concat(F.lit("anchor:"), u["claims"])))))


def link_rows(messages: DataFrame) -> DataFrame:
    """Child table, one row per link."""
    return explode_rows(messages, "links", "msg_id", pos="pos")


def link_totals(messages: DataFrame) -> DataFrame:
    return messages.select(
        "msg_id", F.size("links").alias("total_urls"),
        F.size(F.filter("links", lambda u: F.size(u["findings"]) > 0)).alias("suspicious_count"),
        F.transform(F.filter("links", lambda u: F.size(u["findings"]) > 0), lambda u: F.concat(
            u["raw"], F.lit(": "), F.array_join(u["findings"], "; ")))
        .alias("flags"))


def search_links(links: DataFrame, needle: str) -> DataFrame:
    """Case-blind contains over normalised URL, host and anchor."""
    n = F.lower(F.lit(needle))
    return links.filter(F.contains(F.lower("normalised"), n) | F.contains(F.lower("host"), n)
                        | F.contains(F.lower("anchor"), n))


def link_signals() -> Column:
    first_leaving = F.array_position(F.transform("links", lambda u: u["leaves_site"]), F.lit(True))

    def of(u, i):
        strong_domain = u["lookalike"].isNotNull() | u["idn"].isNotNull()
        return compact(
            F.when(u["is_mismatched"], signal(
                "Deceptive / Mismatched Hyperlink", 30, "strong",
                F.concat(u["claims"], F.lit(" -> "), u["host"]), FAMILY)),
            F.when(u["is_ip"], signal("IP-Based Link Target", 25, "strong", u["raw"], FAMILY)),
            F.when(u["is_shortener"], signal("URL Shortener Link", 10, "weak", u["raw"], FAMILY)),
            F.when(u["is_suspicious"], signal(
                "Suspicious Link Domain", F.when(strong_domain, 25).otherwise(10),
                F.when(strong_domain, F.lit("strong")).otherwise(F.lit("weak")),
                u["host"], FAMILY)),
            F.when(i + 1 == first_leaving, signal(
                "Multiple / Open Redirect Link Parameter", 15, "weak", u["raw"], FAMILY)))

    return F.flatten(F.transform("links", of))
