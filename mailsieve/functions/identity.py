"""Addresses, domains, organisations and brand lookalikes as Column expressions.

Everything here is JVM-side and row-local.  The brand and domain lists are fixed
and short, so they travel inside the plan as literals: no join, no shuffle and
no hot key when one provider sends a third of all mail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import among, blank_to_null, col, let, string_array, strip, text
from . import fixed_values as fv

EMBEDDED_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
IPV4_HOST = r"^\d{1,3}(\.\d{1,3}){3}$"


def address(header) -> Column:
    """Bare lower-case address; the bracketed one beats a decoy in the display name."""
    raw = text(header)
    return F.lower(F.coalesce(
        blank_to_null(strip(F.regexp_extract(raw, r"<([^<>]*@[^<>]*)>\s*$", 1))),
        blank_to_null(strip(F.regexp_extract(raw, r"<([^>]*@[^>]*)>", 1))),
        blank_to_null(F.regexp_extract(raw, r'[^\s<>,;:"()]+@[^\s<>,;:"()]+', 0)),
    ))


def domain_of(addr) -> Column:
    """Domain part of a bare address."""
    a = col(addr)
    tail = F.btrim(F.substring_index(a, "@", -1), F.lit("<>[] "))
    return F.when(F.contains(a, F.lit("@")), blank_to_null(F.lower(F.rtrim(tail, F.lit(".")))))


def display_name(header) -> Column:
    raw = text(header)
    return F.when(
        F.contains(raw, F.lit("<")),
        strip(F.regexp_extract(raw, r'^\s*"?([^"<]*)"?\s*<', 1)),
    ).otherwise(strip(F.regexp_extract(raw, r"\(([^()]*)\)\s*$", 1)))


def clean_host(host) -> Column:
    h = F.btrim(F.lower(text(host)), F.lit("."))
    return F.when(F.contains(h, F.lit("..")), F.regexp_replace(h, r"\.{2,}", ".")).otherwise(h)


def registrable(host) -> Column:
    """Organisation-level domain: two labels, or three under a listed suffix."""
    h = clean_host(host)
    two = F.substring_index(h, ".", -2)
    return F.when(among(two, fv.MULTI_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(two)


def tld(host) -> Column:
    return F.lower(F.substring_index(col(host), ".", -1))


def is_ipv4_host(host) -> Column:
    return text(host).rlike(IPV4_HOST)


def plausible_host(candidate) -> Column:
    h = F.btrim(F.lower(text(candidate)), F.lit("."))
    return (
        (F.length(h) <= 253)
        & h.rlike(r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$")
        & among(F.substring_index(h, ".", -1), fv.COMMON_TLDS)
    )


def _same_organisation(v) -> Column:
    a, b, reg_a, reg_b = v["a"], v["b"], v["reg_a"], v["reg_b"]
    return (a != "") & (b != "") & (
        (a == b) | (reg_a == reg_b)
        | F.endswith(a, F.concat(F.lit("."), reg_b))
        | F.endswith(b, F.concat(F.lit("."), reg_a)))


def _pair(a, b, body) -> Column:
    return let(lambda u: let(body, a=u["a"], b=u["b"], reg_a=registrable(u["a"]),
                             reg_b=registrable(u["b"])),
               a=clean_host(a), b=clean_host(b))


def same_organisation(a, b) -> Column:
    return _pair(a, b, _same_organisation)


def aligned(child, parent, strict=None) -> Column:
    """DMARC alignment; relaxed unless ``strict`` says otherwise."""
    c = F.lower(F.rtrim(strip(text(child)), F.lit(".")))
    p = F.lower(F.rtrim(strip(text(parent)), F.lit(".")))
    relaxed = registrable(c) == registrable(p)
    if strict is not None:
        relaxed = relaxed & ~strict
    return (c != "") & (p != "") & ((c == p) | relaxed)


def is_free_mail(host) -> Column:
    return among(registrable(host), fv.FREE_MAIL_DOMAINS)


def is_mail_platform(host) -> Column:
    """Known bulk-mail/helpdesk platform, by host, organisation or parent domain."""
    h = clean_host(host)
    return ~is_free_mail(h) & (
        among(h, fv.ESP_DOMAINS)
        | among(F.substring_index(h, ".", -2), fv.ESP_DOMAINS)
        | among(F.substring_index(h, ".", -3), fv.ESP_DOMAINS)
    )


def fold_homoglyphs(value) -> Column:
    return F.translate(col(value), "01358@-", "olesba")


def lookalike_brand(host) -> Column:
    """Brand that a host imitates, or NULL.

    Typo and homoglyph matches on the leading label come first, then a brand used
    as a whole token; within each the first brand in list order wins.
    """
    token_brands = [b for b in fv.BRANDS
                    if len(b) >= fv.BRAND_TOKEN_MIN_LENGTH and b not in fv.BRAND_TOKEN_EXEMPT]

    def decide(v):
        def imitates(brand):
            def near(word):
                return F.levenshtein(word, brand, 2).between(1, 2)
            typo = (F.length(brand) >= fv.BRAND_TYPO_MIN_LENGTH) \
                & (near(v["label"]) | near(v["folded"]))
            return (v["label"] != brand) & ((v["folded"] == brand) | typo)

        near_miss = F.get(F.filter(string_array(fv.BRANDS), imitates), F.lit(0))
        as_token = F.get(F.filter(
            string_array(token_brands), lambda b: F.array_contains(v["tokens"], b)), F.lit(0))
        genuine = (v["h"] == "") | among(v["reg"], fv.BRAND_OWNED_DOMAINS) \
            | among(F.substring_index(v["reg"], ".", 1), fv.BRANDS)
        return F.when(~genuine, F.coalesce(near_miss, as_token))

    def parts(u):
        label = F.substring_index(u["h"], ".", 1)
        words = F.split(u["h"], r"[.\-_]+")
        return let(decide, h=u["h"], reg=registrable(u["h"]), label=label,
                   folded=fold_homoglyphs(label),
                   tokens=F.concat(words, F.transform(words, lambda t: fold_homoglyphs(t))))

    return let(parts, h=clean_host(host))


def brand_in_display_name(name, from_domain) -> Column:
    """First brand named as a whole word in the display name of an unrelated sender."""
    brands = [b for b in fv.BRANDS
              if len(b) >= fv.BRAND_TOKEN_MIN_LENGTH and b not in fv.BRAND_TOKEN_EXEMPT]

    def decide(v):
        claimed = F.get(F.filter(
            string_array(brands),
            lambda b: F.array_contains(v["words"], b) & ~F.contains(v["dom"], b)), F.lit(0))
        return F.when((v["dom"] != "")
                      & ~among(registrable(v["dom"]), fv.BRAND_OWNED_DOMAINS), claimed)

    return let(decide, dom=F.lower(text(from_domain)),
               words=F.split(F.lower(text(name)), r"(?U)\W+"))


def relationship(from_domain, other_domain) -> Column:
    """same_org / suspicious / trusted_esp / unrelated, tested in that order."""
    def decide(v):
        b, reg_b = v["b"], v["reg_b"]
        free = among(reg_b, fv.FREE_MAIL_DOMAINS)
        platform = ~free & (among(b, fv.ESP_DOMAINS) | among(reg_b, fv.ESP_DOMAINS)
                            | among(F.substring_index(b, ".", -3), fv.ESP_DOMAINS))
        return (
            F.when((v["a"] == "") | (b == ""), F.lit("unrelated"))
            .when(_same_organisation(v), F.lit("same_org"))
            .when(free & ~among(v["reg_a"], fv.FREE_MAIL_DOMAINS), F.lit("suspicious"))
            .when((F.contains(b, F.lit(".")) & among(tld(b), fv.HIGH_RISK_TLDS))
                  | lookalike_brand(b).isNotNull(), F.lit("suspicious"))
            .when(platform, F.lit("trusted_esp"))
            .otherwise(F.lit("unrelated")))

    return _pair(from_domain, other_domain, decide)


def idn_reason(host) -> Column:
    h = text(host)
    return (F.when(F.contains(F.lower(h), F.lit("xn--")), F.concat(F.lit("punycode:"), h))
            .when(h.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("unicode:"), h)))


def is_exempt_from_ageing(host) -> Column:
    reg = registrable(host)
    return (reg != "") & (among(reg, fv.BRAND_OWNED_DOMAINS)
                          | among(F.substring_index(reg, ".", 1), fv.BRANDS))


def trusted_sender(from_domain, spf, dkim, dmarc) -> Column:
    s, k, m = (F.lower(text(v)) for v in (spf, dkim, dmarc))
    return (
        (s != "fail") & (k != "fail") & (m != "fail")
        & ((s == "pass") | (k == "pass"))
        & among(registrable(from_domain), fv.TRUSTED_SENDER_DOMAINS)
    )
