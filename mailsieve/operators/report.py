"""Evidence log, recommendations and the nested finding of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import compact, explode_rows

ENTRY = "struct<category:string,title:string,evidence:string>"


def evidence_log(analysed: DataFrame) -> DataFrame:
    """Every observation of a message in one table, in report order.

    The five sources sit on the same row, so the union is a concatenation of arrays
    and needs a single pass over the messages.
    """
    def entry(category, title, evidence):
        return F.struct(F.lit(category).alias("category"), title.alias("title"),
                        evidence.alias("evidence"))

    sources = [
        F.transform("signals", lambda s: entry("signal", s["indicator"], s["evidence"])),
        F.transform("header_findings", lambda h: entry("header", h["title"], h["evidence"])),
        F.transform("html_findings", lambda h: entry("html", h["indicator"], h["evidence"])),
        F.transform(F.filter("links", lambda u: F.size(u["findings"]) > 0),
                    lambda u: entry("url", u["host"], F.array_join(u["findings"], "; "))),
        F.transform(F.filter("attachments", lambda a: F.size(a["reasons"]) > 0),
                    lambda a: entry("attachment", a["filename"], F.array_join(
                        F.transform(a["reasons"], lambda r: r["reason"]), "; "))),
    ]
    log = F.concat(*[c.cast(f"array<{ENTRY}>") for c in sources])
    return explode_rows(analysed.select("msg_id", log.alias("log")), "log", "msg_id", pos="seq")


def recommendations(level, suspicious_urls, has_executable) -> Column:
    """Steps for an analyst, by verdict and content."""
    serious = F.col(level).isin("High", "Critical") if isinstance(level, str) \
        else level.isin("High", "Critical")
    steps = compact(
        F.lit("contain: remove the message from mailboxes"),
        F.lit("block: sender at the gateway"),
        F.when(suspicious_urls > 0, F.lit("network: block the linked hosts")),
        F.when(has_executable, F.lit("endpoint: block the attachment hashes")),
        F.lit("accounts: reset credentials of readers"))
    return F.when(serious, steps).otherwise(F.array(F.lit("none required")))


def findings(analysed: DataFrame, *scalars: str) -> DataFrame:
    """Nested finding per message: scalars plus child lists, ready for JSON."""
    children = [c for c in ("signals", "header_findings", "html_findings", "links", "attachments",
                            "hops", "routing_flags") if c in analysed.columns]
    return analysed.select("msg_id", *scalars, *children)


def write_findings(analysed: DataFrame, path: str, *scalars: str) -> None:
    """One JSON object per message."""
    findings(analysed, *scalars).write.mode("overwrite").json(path)


def write_summary(ranked: DataFrame, path: str) -> None:
    """Ranked batch summary as JSON lines, in rank order across part files."""
    ranked.select("path", "subject", "from_raw", "score", "risk_level") \
        .write.mode("overwrite").json(path)
