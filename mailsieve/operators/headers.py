"""Header rules: one array of findings per message, computed on the message's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import identity as ident
from ..functions.base import among, blank_to_null, compact, string_array, strip, text
from ..functions.mailtime import parse_mail_date
from ..functions.network import received_host
from ..functions.scores import signal

FINDING = "struct<title:string,risk_level:string,evidence:string>"
FAMILY = "header forensics"


def with_identity(messages: DataFrame) -> DataFrame:
    """Addresses, domains and relations that many rules share."""
    roles = ("from", "sender", "reply_to", "return_path")
    d = messages.withColumns({f"{r}_addr": ident.address(f"{r}_raw") for r in roles})
    d = d.withColumns({f"{r}_domain": ident.domain_of(f"{r}_addr") for r in roles})
    return d.withColumns({
        **{f"{role}_relation": ident.relationship("from_domain", f"{role}_domain")
           for role in roles[1:]},
        "display_name": ident.display_name("from_raw"),
        "from_lookalike": ident.lookalike_brand("from_domain"),
        "received_hosts": F.array_sort(F.array_distinct(F.array_compact(
            F.transform("received_chain", received_host)))),
    })


def diverted(messages: DataFrame) -> Column:
    """Reply-To, Sender or Return-Path deceives relative to From."""
    hit = None
    for role in ("reply_to", "sender", "return_path"):
        one = F.col(f"{role}_domain").isNotNull() & (F.col(f"{role}_relation") == "suspicious")
        hit = one if hit is None else hit | one
    return F.coalesce(hit & F.col("from_domain").isNotNull(), F.lit(False))


def _finding(cond, title: str, level, evidence) -> Column:
    level = level if isinstance(level, Column) else F.lit(level)
    title = title if isinstance(title, Column) else F.lit(title)
    return F.when(cond, F.struct(title.alias("title"), level.alias("risk_level"),
                                 evidence.alias("evidence")))


def _pair(a: str, left, b: str, right) -> Column:
    return F.concat(F.lit(f"{a}="), F.coalesce(left, F.lit("")), F.lit(f" {b}="),
                    F.coalesce(right, F.lit("")))


def authserv_id(raw) -> Column:
    """Identity of the verifying host in an Authentication-Results header."""
    found = F.regexp_extract(strip(raw), r"^\s*([A-Za-z0-9_.:\[\]-]+)\s*;", 1)
    return F.btrim(F.lower(found), F.lit("."))


def attributed(authserv, hosts) -> Column:
    """The verifying host is one that received the message, or shares its organisation."""
    return F.exists(hosts, lambda h: (
        (h == authserv) | F.endswith(h, F.concat(F.lit("."), authserv))
        | F.endswith(authserv, F.concat(F.lit("."), h))
        | (ident.registrable(h) == ident.registrable(authserv))))


def _display_name_rules() -> list[Column]:
    embedded = blank_to_null(F.lower(F.regexp_extract("display_name", ident.EMBEDDED_EMAIL, 0)))
    ready = (F.col("display_name") != "") & F.col("from_domain").isNotNull()
    decoy = ready & F.coalesce(embedded != F.col("from_addr"), F.lit(False))
    brand = ident.brand_in_display_name("display_name", "from_domain")
    return [
        _finding(decoy, "Display Name Email Spoofing", "High",
                 _pair("display", F.col("display_name"), "from", F.col("from_addr"))),
        _finding(ready & ~decoy & brand.isNotNull(), "Display Name Brand Impersonation", "High",
                 _pair("display", F.col("display_name"), "domain", F.col("from_domain"))),
    ]


def _relation_rules() -> list[Column]:
    from_addr, from_dom = F.col("from_addr"), F.col("from_domain")
    sender_differs = F.coalesce(from_addr != F.col("sender_addr"), F.lit(False))
    reply_differs = F.coalesce(from_addr != F.col("reply_to_addr"), F.lit(False))
    bounce_differs = F.coalesce(from_dom != F.col("return_path_domain"), F.lit(False))

    s_rel, r_rel, b_rel = (F.col(f"{r}_relation") for r in ("sender", "reply_to", "return_path"))
    delegate = s_rel.isin("same_org", "trusted_esp") \
        | F.coalesce(ident.is_mail_platform("sender_domain"), F.lit(False))
    platform = b_rel.isin("same_org", "trusted_esp") \
        | F.coalesce(ident.is_mail_platform("return_path_domain"), F.lit(False))
    s_ev = _pair("from", from_addr, "sender", F.col("sender_addr"))
    r_ev = _pair("from", from_addr, "reply_to", F.col("reply_to_addr"))
    b_ev = _pair("from", from_dom, "return_path", F.col("return_path_domain"))
    sender = (
        F.when(~sender_differs, None)
        .when(delegate, F.struct(F.lit("From vs. Sender Delegate"), F.lit("Low"), s_ev))
        .when(s_rel == "suspicious",
              F.struct(F.lit("From vs. Sender Mismatch"), F.lit("High"), s_ev))
        .otherwise(F.struct(F.lit("From vs. Sender Domain Difference"), F.lit("Low"), s_ev)))
    reply = (
        F.when(~reply_differs | r_rel.isin("same_org", "trusted_esp"), None)
        .when(r_rel == "suspicious",
              F.struct(F.lit("Suspicious Reply-To Destination"), F.lit("High"), r_ev))
        .otherwise(F.struct(F.lit("From vs. Reply-To Domain Difference"), F.lit("Medium"), r_ev)))
    bounce = (
        F.when(~bounce_differs, None)
        .when(platform,
              F.struct(F.lit("From vs. Return-Path ESP Bounce Domain"), F.lit("Low"), b_ev))
        .when(b_rel == "suspicious",
              F.struct(F.lit("From vs. Return-Path Domain Mismatch"), F.lit("High"), b_ev))
        .otherwise(
            F.struct(F.lit("From vs. Return-Path Domain Difference"), F.lit("Low"), b_ev)))
    return [c.cast(FINDING) for c in (sender, reply, bounce)]


def _message_id_rules() -> list[Column]:
    mid = strip(text("message_id"))
    inner = F.btrim(mid, F.lit("<>"))
    host = F.lower(F.substring(inner, F.instr(inner, "@") + 1, F.length(inner)))
    has_at = F.contains(inner, F.lit("@"))
    local = among(host, fv.LOCAL_MESSAGE_ID_HOSTS) | F.startswith(host, F.lit("192.168."))
    reasons = compact(
        F.when(~(F.startswith(mid, F.lit("<")) & F.endswith(mid, F.lit(">"))), F.lit("brackets")),
        F.when(~has_at, F.lit("no-at")),
        F.when(has_at & local, F.concat(F.lit("local-host:"), host)),
        F.when(has_at & ~local & ~F.contains(host, F.lit(".")), F.concat(F.lit("not-fqdn:"), host)))
    copies = F.filter("headers", lambda h: F.lower(h["name"]) == "message-id")
    return [
        _finding(mid == "", "Missing Message-ID Header", "Medium", F.lit("absent")),
        _finding((mid != "") & (F.size(reasons) > 0), "Suspicious Message-ID Format", "Medium",
                 F.concat(mid, F.lit(" "), F.array_join(reasons, "; "))),
        _finding(F.size(copies) > 1, "Duplicate Message-ID Headers Detected", "High",
                 F.array_join(F.transform(copies, lambda h: h["value"]), "; ")),
    ]


def _x_header_rule() -> Column:
    def odd(h):
        name, value = F.lower(h["name"]), F.lower(h["value"])
        mailer = F.exists(string_array(fv.SUSPICIOUS_MAILERS), lambda m: F.contains(value, m))
        return (name.isin("x-php-originating-script", "x-php-script")
                | (name.isin("x-spam-flag", "x-spam-status") & F.contains(value, F.lit("yes")))
                | (name.isin("x-mailer", "user-agent", "x-user-agent") & mailer))

    flagged = F.transform(F.filter("headers", odd),
                          lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return _finding(F.size(flagged) > 0, "Suspicious X-Headers Detected", "Medium",
                    F.array_join(flagged, "; "))


def _auth_header_rules() -> list[Column]:
    results, hosts = F.col("authentication_results"), F.col("received_hosts")
    claims = F.filter(results, lambda a: F.contains(F.lower(a), F.lit("pass")))

    def judged(a):
        who = authserv_id(a)
        status = (F.when((who == "") | ~F.contains(who, F.lit(".")), F.lit("anonymous"))
                  .when(F.size(hosts) == 0, F.lit("stop"))
                  .when(~attributed(who, hosts), F.lit("unattributed"))
                  .otherwise(F.lit("ok")))
        return F.struct(status.alias("status"), who.alias("who"), strip(a).alias("raw"))

    first = F.get(F.filter(F.transform(claims, judged), lambda j: j["status"] != "ok"), F.lit(0))
    return [
        _finding(F.size(results) > 2, "Multiple Authentication-Results Headers", "Medium",
                 F.concat(F.lit("count="), F.size(results))),
        _finding(first["status"] == "anonymous", "Authentication-Results Missing Authserv-ID",
                 "Medium", first["raw"]),
        _finding(first["status"] == "unattributed", "Unattributed Authentication-Results Header",
                 "Medium", F.concat(first["who"], F.lit(" not in "), F.array_join(hosts, ","))),
    ]


def _structure_rules() -> list[Column]:
    def copies(name):
        return F.size(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()))

    bad_name = F.exists("headers",
                        lambda h: h["name"].rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    dated = text("date") != ""
    anomalies = compact(
        *[F.when(copies(n) > 1, F.concat(F.lit(f"repeated {n} x"), copies(n)))
          for n in ("From", "Subject", "Date")],
        F.when(bad_name, F.lit("control character in header name")),
        F.when(dated & parse_mail_date("date").isNull(),
               F.concat(F.lit("unreadable date: "), F.col("date"))))
    no_recipient = (text("to_raw") == "") & (text("cc_raw") == "") & (text("bcc_raw") == "")
    missing = compact(
        F.when(~dated, F.lit("Date")),
        F.when(text("from_raw") == "", F.lit("From")),
        F.when(text("subject") == "", F.lit("Subject")),
        F.when(no_recipient, F.lit("Recipient")))
    return [
        _finding(F.size(anomalies) > 0, "Header Structural Anomalies Detected", "High",
                 F.array_join(anomalies, "; ")),
        _finding(F.size(missing) > 0, "Missing Mandatory Email Headers", "Medium",
                 F.array_join(missing, ", ")),
    ]


def _sender_domain_rules() -> list[Column]:
    dom = F.col("from_domain")
    known = dom.isNotNull()
    raw_ip = known & ident.is_ipv4_host(dom)
    return [
        _finding(raw_ip, "Raw IP Address Sender Domain", "High", dom),
        _finding(known & ~raw_ip & among(ident.tld(dom), fv.HIGH_RISK_TLDS),
                 "High-Risk Top-Level Domain (TLD)", "Medium",
                 F.concat(dom, F.lit(" ."), ident.tld(dom))),
        _finding(known & ~raw_ip & F.col("from_lookalike").isNotNull(),
                 "Lookalike Brand Domain (Typosquatting)", "High",
                 F.concat(dom, F.lit(" ~ "), F.col("from_lookalike"))),
    ]


def header_findings(messages: DataFrame) -> DataFrame:
    """Add ``header_findings`` in rule order.  Expects :func:`with_identity` columns."""
    rules = (_display_name_rules() + _relation_rules() + _message_id_rules()
             + [_x_header_rule()] + _auth_header_rules() + _structure_rules()
             + _sender_domain_rules())
    return messages.withColumn("header_findings", compact(*[r.cast(FINDING) for r in rules]))


def finding_weight(title, level, from_domain) -> tuple[Column, Column]:
    """(weight, strength) of one header finding."""
    t = F.lower(title)

    def says(*words):
        hit = F.contains(t, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(t, F.lit(w))
        return hit

    core = F.exists(string_array(fv.CORE_ABUSE_TLDS),
                    lambda x: F.contains(F.coalesce(from_domain, F.lit("")),
                                         F.concat(F.lit("."), x)))
    weight = (
        F.when(says("missing"), 8)
        .when(level == "Critical", 35)
        .when(level == "High", 25)
        .when(level == "Low", 5)
        .when(says("lookalike", "typosquat", "impersonation", "spoofing"), 25)
        .when(says("raw ip"), 20)
        .when(says("high-risk top-level") & core, 20)
        .when(says("high-risk top-level"), 10)
        .when(says("reply-to", "return-path", "sender domain difference"), 8)
        .otherwise(10))
    return weight, F.when(weight >= 20, F.lit("strong")).otherwise(F.lit("weak"))


def header_signals(findings: str = "header_findings") -> Column:
    def one(f):
        weight, strength = finding_weight(f["title"], f["risk_level"], F.col("from_domain"))
        return signal(F.concat(F.lit("Header Forensics: "), f["title"]), weight, strength,
                      F.concat(F.lit("["), f["risk_level"], F.lit("] "), f["evidence"]), FAMILY)
    return F.transform(findings, one)


def standalone_identity_signals() -> Column:
    """Sender-identity signals for callers that run no header rules."""
    family = "sender identity"
    dom, name = F.col("from_domain"), F.col("display_name")
    brand = ident.brand_in_display_name(name, dom)
    top = ident.tld(dom)
    roles = (("Sender", "sender"), ("Reply-To", "reply_to"), ("Return-Path", "return_path"))

    def differing(kind):
        return compact(*[
            F.when((F.col(f"{r}_domain") != dom) & (F.col(f"{r}_relation") == kind),
                   F.concat(F.lit(f"{label}="), F.col(f"{r}_domain"))) for label, r in roles])

    bad, odd = differing("suspicious"), differing("unrelated")
    return compact(
        F.when((name != "") & brand.isNotNull(), signal(
            "Display Name Impersonation", 25, "strong",
            _pair("display", name, "domain", dom), family)),
        F.when(F.col("from_lookalike").isNotNull(), signal(
            "Lookalike / Typosquatted Domain", 25, "strong",
            _pair("domain", dom, "brand", F.col("from_lookalike")), family)),
        F.when(among(top, fv.CORE_ABUSE_TLDS), signal(
            "High-Risk Top-Level Domain (TLD)", 20, "strong", dom, family))
        .when(among(top, fv.HIGH_RISK_TLDS), signal(
            "High-Risk Top-Level Domain (TLD)", 10, "weak", dom, family)),
        F.when(ident.idn_reason(dom).isNotNull(), idn_signal()),
        F.when(dom.isNotNull() & (F.size(bad) > 0), signal(
            "Suspicious Reply / Sender Diversion", 25, "strong", F.array_join(bad, ", "), family))
        .when(dom.isNotNull() & (F.size(odd) > 0), signal(
            "Different Sender Header Domains", 8, "weak", F.array_join(odd, ", "), family)),
    )


def idn_signal() -> Column:
    return signal("Punycode / Unicode Domain", 20, "strong",
                  ident.idn_reason("from_domain"), "sender identity")


def identity_signals() -> Column:
    """The identity signal that header rules do not cover."""
    return compact(F.when(ident.idn_reason("from_domain").isNotNull(), idn_signal()))
