"""The whole analysis: one pass per message, then lookups, then verdicts.

Stage one is map-only: every rule that needs nothing but the message runs on its row
and leaves a narrow result (signals, domains, a few facts).  That result is written
once; registration ages, sender history and independent authentication join it by
message id without touching a body again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions.base import explode_rows
from ..functions.scores import SIGNALS
from ..operators import (attachments, auth, baseline, content, dnsauth, headers, html, links, reputation,
                         routing, scoring, wording)
from ..operators.scale import durable


def inspected(messages: DataFrame, as_of) -> DataFrame:
    """All row-local rules; keeps the child lists next to each message."""
    d = headers.with_identity(messages)
    d = auth.with_header_auth(d)
    d = d.withColumn("auth_inconsistencies", auth.inconsistencies())
    d = headers.header_findings(d)
    d = links.with_links(d)
    d = content.with_match_text(d)
    d = html.with_html_findings(html.with_html_counts(html.with_tokens(d))).drop("html_tokens")
    d = routing.with_routing_flags(routing.with_hops(d), as_of)
    d = attachments.with_attachments(d)
    return scoring.with_trust(d)


def message_signals(d: DataFrame, keep: tuple[str, ...] = (), families=None, keywords=None) -> DataFrame:
    """Narrow result of stage one: signal groups, domains and facts per message.  ``families`` and
    ``keywords`` may replace the built-in wording rules."""
    return d.select(
        "msg_id", "user_id", "created_at", "from_addr", "from_domain", "trusted_sender",
        headers.diverted(d).alias("diverted"),
        "spf", "dkim", "dmarc", "spf_details", "dkim_details", "dmarc_details", "hop_count",
        ((F.col("body_plain") != "") | (F.col("body_html") != "")).alias("has_body"),
        (F.col("body_html") != "").alias("has_html"),
        links.link_signals().alias("s_links"),
        headers.identity_signals().alias("s_identity"),
        content.content_signals(families, keywords).alias("s_content"),
        auth.auth_signals().alias("s_auth"),
        headers.header_signals().alias("s_header"),
        routing.routing_signals().alias("s_routing"),
        html.html_signals().alias("s_html"),
        attachments.attachment_signals().alias("s_attachment"),
        reputation.message_domains(d).alias("domains"), *keep)


def with_verified_auth(narrow: DataFrame, checked: DataFrame) -> DataFrame:
    """Header claims give way to the merged verdicts, and with them the authentication signals,
    the contradictions and the trust in the sender."""
    final = checked.select(
        "msg_id", F.col("final_spf").alias("_spf"), F.col("final_dkim").alias("_dkim"),
        F.col("final_dmarc").alias("_dmarc"), "auth_inconsistencies", "source", "note")
    d = narrow.join(final, "msg_id", "left").withColumns({
        m: F.coalesce(f"_{m}", m) for m in ("spf", "dkim", "dmarc")}).drop("_spf", "_dkim", "_dmarc")
    return d.withColumns({
        "s_auth": auth.auth_signals(),
        "trusted_sender": F.coalesce(
            ident.trusted_sender("from_domain", "spf", "dkim", "dmarc") & ~F.col("diverted"), F.lit(False))})


def analyse(messages: DataFrame, as_of, whois: DataFrame | None = None,
            history: DataFrame | None = None, dns: DataFrame | None = None,
            dkim_results: DataFrame | None = None, keep: tuple[str, ...] = (),
            rules: DataFrame | None = None, keywords: list[str] | None = None,
            narrow: DataFrame | None = None) -> DataFrame:
    """Verdict per message.

    ``whois``: registration snapshot, or a log of answers with ``fetched`` (each message then sees the last
    answer before its ``created_at``).  ``history``: past mail (id, user_id, ts,
    from_addr), which must include the analysed messages themselves under their id.
    ``dns`` and ``dkim_results``: record and signature snapshots; with both, SPF, DKIM and DMARC
    are evaluated independently and merged with the header claims.  ``keep``: further columns of
    the messages to carry into the verdict rows.  ``rules``: wording rules of a caller's own
    (``operators.wording.RULES``) in place of the built-in phrases, found in a pass of their own over subjects
    and bodies; ``keywords`` likewise replace the built-in keywords, and an empty list turns them off.
    ``narrow``: the written result of stage one (:func:`message_signals`), where a caller has it already.
    """
    verify = dns is not None and dkim_results is not None
    if narrow is None:
        narrow = message_signals(inspected(messages, as_of), keep, None if rules is None else [], keywords)
        if whois is not None or history is not None or verify or rules is not None:
            narrow = durable(narrow)
    d = narrow
    if rules is not None:
        texts = content.with_match_text(messages.select("msg_id", "subject", "body_plain", "body_html"))
        hits = durable(wording.with_wording_hits(texts, rules).select("msg_id", wording.wording_signals().alias("_wording")))
        d = d.join(hits, "msg_id", "left").withColumn("s_content", F.concat(
            "s_content", F.coalesce("_wording", F.expr(f"cast(array() as {SIGNALS})")))).drop("_wording")
    if verify:
        claims = auth.with_header_auth(headers.with_identity(messages))
        d = with_verified_auth(d, dnsauth.verified_auth(claims, dns, dkim_results))
    factors = {}
    if whois is not None:
        asked = explode_rows(narrow, "domains", "msg_id", "created_at", pos="pos")
        ages = durable(reputation.domain_ages_then(asked, whois) if "fetched" in whois.columns
                       else reputation.domain_ages(asked, whois, as_of))
        known = ages.groupBy("msg_id").agg(
            F.bool_or(F.col("age_days").isNotNull()).alias("age_known"))
        d = d.join(reputation.age_signals(ages), "msg_id", "left").join(known, "msg_id", "left")
        factors["domain registration age"] = (F.col("age_known").isNotNull(), F.col("age_known"))
    else:
        d = d.withColumn("age_signals", F.lit(None).cast(SIGNALS))
    factors["structure of the HTML body"] = (F.col("has_html"), F.lit(True))
    if history is not None:
        facts = baseline.sender_baseline(history).withColumnRenamed("id", "msg_id").drop("user_id")
        d = d.join(facts, "msg_id", "left")
        factors["prior correspondence"] = (F.col("available"), F.lit(True))
    empty = F.expr(f"cast(array() as {SIGNALS})")
    d = d.withColumn("signals", F.concat(
        "s_links", "s_identity", "s_content", "s_auth", "s_header", "s_routing",
        F.coalesce("age_signals", empty), "s_html", "s_attachment"))
    if history is not None:
        d = d.withColumn("signals", F.concat("signals", baseline.first_contact_signals()))
    return scoring.verdicts(d, optional=factors, keep=(*keep, "spf", "dkim", "dmarc"))
