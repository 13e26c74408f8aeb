"""URL parts and link predicates as Column expressions.

A regular expression is used instead of ``parse_url`` because links in mail hold
non-ASCII hosts, which ``parse_url`` rejects, and mixed case, which it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import among, blank_to_null, col, strip, text
from . import fixed_values as fv
from .identity import address, domain_of, is_ipv4_host, plausible_host, registrable

URL_SHAPE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
ANCHOR_ELEMENT = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
ANCHOR_END = "(?i)</a>"
OPEN_ANCHOR = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*)$"""
PLAIN_URL = r"""(?i)https?://[^\s<>"']+"""
HOST_TOKEN = (r"\b([a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
              r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)+)\b")
OPEN_REDIRECT = (r"(?i)[?&](?:" + "|".join(fv.REDIRECT_PARAMETERS) + r")="
                 r"(?:https?%3A%2F%2F|https?://)")


def scheme(url) -> Column:
    found = F.lower(F.regexp_extract(text(url), URL_SHAPE, 1))
    return F.when(found == "", F.lit("http")).otherwise(found)


def host(url) -> Column:
    netloc = F.regexp_replace(F.regexp_extract(text(url), URL_SHAPE, 2), r"^.*@", "")
    return F.lower(F.when(F.startswith(netloc, F.lit("[")),
                          F.regexp_extract(netloc, r"^\[([^\]]*)", 1))
                   .otherwise(F.substring_index(netloc, ":", 1)))


def path(url) -> Column:
    return F.regexp_replace(F.regexp_extract(text(url), URL_SHAPE, 3), r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(text(url), URL_SHAPE, 4)


def normalised(url, host_) -> Column:
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), col(host_),
                    F.rtrim(path(url), F.lit("/")),
                    F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def is_skipped(raw) -> Column:
    r = text(raw)
    return (r == "") | F.startswith(r, F.lit("javascript:")) | F.startswith(r, F.lit("mailto:"))


def is_shortener(host_) -> Column:
    return among(col(host_), fv.SHORTENER_HOSTS)


def open_redirect(url) -> Column:
    """The matched redirect parameter, or NULL."""
    return blank_to_null(F.regexp_extract(text(url), OPEN_REDIRECT, 0))


def redirects_elsewhere(url) -> Column:
    """A redirect parameter leads to another organisation than the link's own host."""
    u = text(url)
    own = host(u)
    own_org = registrable(own)

    def unquoted(value):
        return F.coalesce(F.try_url_decode(value), value)

    def leaves(pair):
        key = F.lower(unquoted(F.substring_index(pair, "=", 1)))
        raw_value = F.when(F.contains(pair, F.lit("=")),
                           F.substring(pair, F.instr(pair, "=") + 1, F.length(pair)))
        target = unquoted(unquoted(F.coalesce(raw_value, F.lit(""))))
        there = host(target)
        return (among(key, fv.REDIRECT_KEYS)
                & target.rlike(r"^(?:https?:)?//")
                & (there != "") & (there != own) & (registrable(there) != own_org))

    return (open_redirect(u).isNotNull() & (own != "")
            & F.exists(F.split(query(u), "&"), leaves))


def claimed_host(anchor) -> Column:
    """Host that a link's visible text claims to lead to, or NULL."""
    shown = strip(text(anchor))
    as_url = F.when(F.contains(shown, F.lit("://")), host(shown))
    as_url = F.when(plausible_host(as_url) | is_ipv4_host(as_url), as_url)
    mail = domain_of(address(shown))
    mail = F.when(plausible_host(mail), mail)
    token = F.get(F.filter(
        F.transform(F.regexp_extract_all(shown, F.lit(HOST_TOKEN), F.lit(1)), F.lower),
        plausible_host), F.lit(0))
    return F.coalesce(as_url, mail, token)


def defanged(url) -> Column:
    return F.regexp_replace(
        F.regexp_replace(text(url), r"^[hH][tT][tT][pP]([sS]?)://", r"hxxp$1://"),
        r"^(hxxps?)://", r"$1[://]")


def risk_reason(url) -> Column:
    """One reason a URL looks risky: raw IP, shortener, redirect, in that order."""
    h = host(url)
    return F.coalesce(
        F.when(is_ipv4_host(h), F.concat(F.lit("ip:"), h)),
        F.when(is_shortener(h), F.concat(F.lit("shortener:"), h)),
        F.when(h != "", F.concat(F.lit("redirect:"), open_redirect(url))))
