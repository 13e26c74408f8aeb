"""Authentication claims read from headers, their consistency, and merging with
independently computed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import identity as ident
from ..functions.base import blank_to_null, col, compact, text
from ..functions.scores import signal
from .headers import attributed, authserv_id

FAMILY = "authentication"

# Verdict words in Authentication-Results headers.
SPF_CLAIM = r"(?i)spf=(pass|fail|softfail|neutral|none|temperror|permerror)"
DKIM_CLAIM = r"(?i)dkim=(pass|fail|neutral|none|policy|temperror|permerror)"
DMARC_CLAIM = r"(?i)dmarc=(pass|fail|none|temperror|permerror)"
POLICY_CLAIM = r"(?i)(?:\bdmarc=[^\s;]*\s+)?(?:\([^\)]*\bp=|\bp=)([a-z]+)"
DESIGNATED_IP = r"(?i)designates\s+(\d{1,3}(?:\.\d{1,3}){3})\s+as\s+permitted\s+sender"
HARD_FAILS = ["fail", "softfail"]
DEFINITIVE = ["pass", "fail", "softfail", "neutral", "none", "policy", "permerror"]

MISMATCH = "verification mismatch"


def _claim(combined, pattern) -> Column:
    return F.coalesce(blank_to_null(F.lower(F.regexp_extract(combined, pattern, 1))),
                      F.lit("not_present"))


def with_header_auth(messages: DataFrame) -> DataFrame:
    """Add SPF/DKIM/DMARC claims and details from Authentication-Results."""
    d = messages.withColumn("auth_raw", F.array_join("authentication_results", " "))
    raw = F.col("auth_raw")
    signer = F.lower(F.rtrim(F.regexp_extract(raw, r"(?i)header\.d=([^\s;]+)", 1), F.lit(".")))
    agent = F.lower(F.rtrim(F.ltrim(F.regexp_extract(raw, r"(?i)header\.i=([^\s;]+)", 1),
                                    F.lit("@")), F.lit(".")))
    d = d.withColumns({
        "spf": _claim(raw, SPF_CLAIM),
        "dkim": _claim(raw, DKIM_CLAIM),
        "dmarc": _claim(raw, DMARC_CLAIM),
        "mailfrom": blank_to_null(F.regexp_extract(raw, r"(?i)smtp\.mailfrom=([^\s;]+)", 1)),
        "dkim_domain": F.coalesce(blank_to_null(signer),
                                  blank_to_null(F.substring_index(agent, "@", -1))),
        "dkim_tag": F.when(signer != "", "header.d").when(agent != "", "header.i"),
        "dmarc_policy": blank_to_null(F.regexp_extract(raw, POLICY_CLAIM, 1)),
        "designated_ip": blank_to_null(F.regexp_extract(raw, DESIGNATED_IP, 1)),
    })
    return d.withColumns({
        "spf_details": F.coalesce(F.concat(F.lit("smtp.mailfrom="), F.col("mailfrom")), F.lit("")),
        "dkim_details": F.coalesce(F.concat(F.col("dkim_tag"), F.lit("="), F.col("dkim_domain")),
                                   F.lit("")),
        "dmarc_details": F.coalesce(F.concat(F.lit("p="), F.col("dmarc_policy")), F.lit("")),
        "auth_attributed": is_attributed(),
    })


def is_attributed() -> Column:
    """Some Authentication-Results header names a host that received the message."""
    def names_receiver(a):
        who = authserv_id(a)
        return F.contains(who, F.lit(".")) & attributed(who, F.col("received_hosts"))
    return F.exists("authentication_results", names_receiver)


def envelope_domain() -> Column:
    """SMTP mail-from domain: the header claim, else Return-Path, else From."""
    claimed = F.btrim(text("mailfrom"), F.lit("<>"))
    return F.coalesce(
        blank_to_null(F.lower(F.rtrim(F.substring_index(claimed, "@", -1), F.lit(".")))),
        F.col("return_path_domain"), F.col("from_domain"))


def inconsistencies(spf="spf", dkim="dkim", dmarc="dmarc", mailfrom="mailfrom",
                    dkim_domain="dkim_domain") -> Column:
    """Contradictions between claims, in order, as short texts."""
    results, from_dom = F.col("authentication_results"), F.col("from_domain")

    def claims(pattern):
        return F.filter(F.transform(results, lambda a: F.lower(F.regexp_extract(a, pattern, 1))),
                        lambda v: v != "")

    def conflict(name, pattern):
        seen = claims(pattern)
        return F.when((F.size(results) > 1) & (F.size(F.array_distinct(seen)) > 1),
                      F.concat(F.lit(f"conflicting {name}: "), F.array_join(seen, ",")))

    bounce = blank_to_null(F.lower(F.rtrim(
        F.substring_index(F.btrim(text(mailfrom), F.lit("<>")), "@", -1), F.lit("."))))
    off = bounce.isNotNull() & from_dom.isNotNull() & ~ident.aligned(bounce, from_dom)
    s, k, m = (F.lower(text(v)) for v in (spf, dkim, dmarc))
    signer = col(dkim_domain)
    return compact(
        conflict("spf", SPF_CLAIM),
        conflict("dkim", DKIM_CLAIM),
        F.when((s == "pass") & (m == "fail"), F.when(off, F.concat(
            F.lit("spf alignment failure: "), bounce, F.lit(" vs "), from_dom))
            .otherwise(F.lit("dmarc failed although spf passed"))),
        F.when((k == "pass") & from_dom.isNotNull() & signer.isNotNull()
               & ~ident.aligned(signer, from_dom),
               F.concat(F.lit("dkim alignment warning: "), signer, F.lit(" vs "), from_dom)),
        F.when(s.isin(HARD_FAILS) & k.isin("fail", "none") & (m == "fail"),
               F.lit("complete authentication failure")),
    )


def explanation(spf, dkim, dmarc, problems) -> Column:
    """One line a person can read."""
    s, k, m = col(spf), col(dkim), col(dmarc)
    parts = compact(
        F.when(s == "pass", F.lit("SPF passed: the sending host is authorised."))
        .when(s.isin(HARD_FAILS), F.concat(F.lit("SPF "), s, F.lit(": host not authorised.")))
        .when(s == "none", F.lit("SPF: no record published.")),
        F.when(k == "pass", F.lit("DKIM passed: the signature is intact."))
        .when(k == "fail", F.lit("DKIM failed: signature or content changed."))
        .when(k == "none", F.lit("DKIM: message is unsigned.")),
        F.when(m == "pass", F.lit("DMARC passed."))
        .when(m == "fail", F.lit("DMARC failed: no aligned identifier.")),
        F.when(F.size(problems) > 0,
               F.concat(F.lit("Anomalies: "), F.array_join(problems, " | "))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")) \
        .otherwise(F.lit("No authentication results to explain."))


def merged(mechanism: str, header, independent, definitive, attributed_, crypto_fail=None) -> Column:
    """struct<verdict, provenance, note> from a header claim and an independent result.

    First line that applies wins: no usable independent result; a broken signature;
    an attributed header (its own answer stands unless it reported a failure that
    the independent check clears); otherwise the independent result.
    """
    h = F.lower(F.coalesce(col(header), F.lit("not_present")))
    i = F.lower(text(independent))
    usable = col(definitive) & (i != "")
    broken = F.lit(False) if crypto_fail is None else (col(crypto_fail) & (i == "fail"))
    held = col(attributed_) & h.isin(DEFINITIVE)
    disagree = F.concat(F.lit(f"{MISMATCH}: header {mechanism}="), h, F.lit(" independent "), i)

    def out(verdict, provenance, note=None):
        return F.struct(verdict.alias("verdict"), F.lit(provenance).alias("provenance"),
                        (F.lit(None).cast("string") if note is None else note).alias("note"))

    return (
        F.when(~usable, out(h, "header-derived"))
        .when(broken, out(i, "live-verified", F.when(h == "pass", disagree)))
        .when(held & (h == i), out(i, "live-confirmed"))
        .when(held & (i == "pass") & h.isin(HARD_FAILS), out(i, "live-verified"))
        .when(held, out(h, "header-authoritative", disagree))
        .otherwise(out(i, "live-verified",
                       F.when((h == "pass") & i.isin(HARD_FAILS), disagree))))


def auth_signals(spf="spf", dkim="dkim", dmarc="dmarc", problems="auth_inconsistencies") -> Column:
    """Weighted signals for each verdict and each contradiction."""
    def verdict_signal(mechanism, verdict, details):
        v = F.lower(text(verdict))
        chain = None
        for name, (weight, indicator) in fv.AUTH_WEIGHTS[mechanism].items():
            one = signal(indicator, weight, "strong" if name == "fail" else "weak",
                         F.concat(F.lit(f"{mechanism}={name} "), text(details)), FAMILY)
            chain = F.when(v == name, one) if chain is None else chain.when(v == name, one)
        return chain

    verdicts = compact(verdict_signal("spf", spf, F.col("spf_details")),
                       verdict_signal("dkim", dkim, F.col("dkim_details")),
                       verdict_signal("dmarc", dmarc, F.col("dmarc_details")))

    def contradiction(p):
        soft = F.contains(F.lower(p), F.lit(MISMATCH))
        return signal("Authentication Inconsistency", F.when(soft, 8).otherwise(20),
                      F.when(soft, F.lit("weak")).otherwise(F.lit("strong")), p, FAMILY)

    return F.concat(verdicts, F.transform(problems, contradiction))
