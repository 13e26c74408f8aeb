"""Queries over parsed raw mail, whole verdicts, stored results and accuracy."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scores
from ..functions.base import explode_rows
from ..operators import evaluation, records, report, scoring, search, store
from ..operators.scale import durable, ensure_checkpoint_dir
from ..sources import mime
from . import oracle as o
from .analysis import analyse, inspected, message_signals
from .body_queries import ATTACH_CTES, HTML_CTES, LINK_CTES
from .identity_queries import HEADER_CTES, HEADER_SIGNALS
from .lookup_queries import AGE_CTES, baseline_sql
from .message_queries import _MAIL_SCORED, AUTH_CTES, ROUTE_CTES, scored_mail
from .registry import query
from .tables import letters, table, view
from .views import AS_OF


# --- raw mail ------------------------------------------------------------------

def raw_files(spark, sf):
    return view(spark, sf, "raw_mail").select(
        "msg_id", "path", F.encode("raw_text", "UTF-8").alias("content"))


_GOOD = "msg_id % 50 NOT IN (7, 9)"


@query("rejected_files", "S1 S2 S3 P65", oracle="""
    SELECT msg_id, path, CASE WHEN msg_id % 50 = 7 THEN 'unsupported type' ELSE 'empty message' END AS reject_reason
    FROM raw_mail WHERE msg_id % 50 IN (7, 9)""")
def rejected_files(spark, sf):
    return mime.parse(raw_files(spark, sf))[1].select("msg_id", "path", "reject_reason")


@query("parsed_headers", "S4", oracle=f"SELECT msg_id, pos, name, value FROM raw_headers",
       ctes={"raw_headers": f"""
        SELECT h.msg_id, h.pos, h.name, h.value FROM header_rows h WHERE {_GOOD}
        UNION ALL SELECT l.msg_id, CAST(n.n + x.i AS INT), x.name, x.value FROM letters l
          JOIN (SELECT msg_id, count(*) AS n FROM header_rows GROUP BY msg_id) n ON n.msg_id = l.msg_id
          JOIN (VALUES (1, 0, 'MIME-Version', '1.0'), (1, 1, 'Content-Type', 'text/html; charset="utf-8"'),
                (2, 0, 'MIME-Version', '1.0'), (2, 1, 'Content-Type', 'multipart/mixed; boundary="b1+x"'),
                (3, 0, 'MIME-Version', '1.0'), (3, 1, 'Content-Type', 'multipart/mixed; boundary="b1+x"'))
            AS x(shape, i, name, value) ON x.shape = l.shape WHERE {_GOOD.replace("msg_id", "l.msg_id")}"""})
def parsed_headers(spark, sf):
    return explode_rows(mime.parse(raw_files(spark, sf))[0], "headers", "msg_id")


@query("parsed_messages", "S5", oracle=f"""
    SELECT l.msg_id, from_raw, to_raw, sender_raw, '' AS cc_raw, '' AS bcc_raw,
           CASE WHEN subject = '' AND l.msg_id % 8 = 5 THEN 'again' ELSE subject END AS subject,
           reply_to_raw, return_path_raw,
           CASE WHEN message_id = '' AND l.msg_id % 8 = 4 THEN '<second@harbor.com>' ELSE message_id END AS message_id, date,
           coalesce(r.n, 0) AS received, coalesce(a.n, 0) AS authentication_results
    FROM letters l LEFT JOIN (SELECT msg_id, count(*) AS n FROM received GROUP BY msg_id) r ON r.msg_id = l.msg_id
    LEFT JOIN (SELECT msg_id, count(*) AS n FROM auth_results GROUP BY msg_id) a ON a.msg_id = l.msg_id
    WHERE {_GOOD.replace("msg_id", "l.msg_id")}""")
def parsed_messages(spark, sf):
    return mime.parse(raw_files(spark, sf))[0].select(
        "msg_id", *mime.NAMED_HEADERS, F.size("received_chain").alias("received"),
        F.size("authentication_results").alias("authentication_results"))


@query("parsed_bodies", "S6 S7", oracle=f"""
    SELECT msg_id, md5(body_plain) AS plain, md5(body_html) AS html, length(body_plain) AS plain_chars,
           length(body_html) AS html_chars FROM letters WHERE {_GOOD}""")
def parsed_bodies(spark, sf):
    d = mime.parse(raw_files(spark, sf))[0]
    return d.select("msg_id", F.md5(F.encode("body_plain", "UTF-8")).alias("plain"),
                    F.md5(F.encode("body_html", "UTF-8")).alias("html"),
                    F.length("body_plain").alias("plain_chars"),
                    F.length("body_html").alias("html_chars"))


@query("parsed_attachments", "S8", oracle=f"""
    SELECT msg_id, filename, sha256(content) AS sha256, octet_length(content) AS size_bytes FROM attachments WHERE {_GOOD}""")
def parsed_attachments(spark, sf):
    d = mime.parse(raw_files(spark, sf))[0]
    return explode_rows(d, "attachments", "msg_id").select(
        "msg_id", "filename", F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").alias("size_bytes"))


@query("mime_outlines", "S9", oracle=f"""
    SELECT l.msg_id, CASE shape WHEN 0 THEN '- text/plain' WHEN 1 THEN '- text/html' ELSE concat('- multipart/mixed', chr(10),
        CASE shape WHEN 3 THEN concat('  - multipart/alternative', chr(10), '    - text/plain',
             CASE WHEN body_html <> '' THEN concat(chr(10), '    - text/html') ELSE '' END)
             ELSE concat('  - text/plain', CASE WHEN body_html <> '' THEN concat(chr(10), '  - text/html') ELSE '' END) END,
        chr(10), '  - ', a.mime) END AS mime_structure
    FROM letters l LEFT JOIN attachments a ON a.msg_id = l.msg_id WHERE {_GOOD.replace("msg_id", "l.msg_id")}""")
def mime_outlines(spark, sf):
    return mime.parse(raw_files(spark, sf))[0].select("msg_id", "mime_structure")


# --- whole verdicts ------------------------------------------------------------

def _over_letters(ctes, source):
    return {k: v.replace(f"FROM {source}", "FROM letters") for k, v in ctes.items()}


def _renamed(ctes: dict[str, str], prefix: str, names) -> dict[str, str]:
    """Give CTEs of one group their own prefix, so groups can be combined."""
    import re
    out = {}
    for k, v in ctes.items():
        for n in names:
            v = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {prefix}{n}", v)
        out[f"{prefix}{k}" if k in names else k] = v
    return out


_SAFE_LINKS = _over_letters(LINK_CTES, "linked")
_SAFE_LINKS = _renamed(_SAFE_LINKS, "k_", [k for k in _SAFE_LINKS])
_SAFE_HTML = _over_letters(HTML_CTES, "markup")
_SAFE_HTML = {k: v.replace("FROM letters m LEFT", "FROM letters m LEFT") for k, v in _SAFE_HTML.items()}
_SAFE_HTML["html_hits"] = _SAFE_HTML["html_hits"].replace(
    "images >= 1 AND visible_chars < 80", "images >= 1 AND visible_chars < 80 AND plain_chars < 200")
_SAFE_HTML["counts"] = _SAFE_HTML["counts"].replace(
    "SELECT m.msg_id,", "SELECT m.msg_id, length(regexp_replace(m.body_plain, '\\s+', '', 'g')) AS plain_chars,", 1)
_SAFE_HTML["html_hits"] = "SELECT * FROM (" + _SAFE_HTML["html_hits"] + \
    ") hh WHERE msg_id IN (SELECT msg_id FROM letters WHERE body_html <> '')"
_SAFE_HTML = _renamed(_SAFE_HTML, "h_", [k for k in _SAFE_HTML])
_SAFE_ATT = _renamed(ATTACH_CTES, "a_", list(ATTACH_CTES))
_SAFE_ROUTE = _renamed(ROUTE_CTES, "r_", list(ROUTE_CTES))
_SAFE_AGE = {k: v.replace("FROM aged_mail", "FROM letters") for k, v in AGE_CTES.items()}
_SAFE_AGE = _renamed(_SAFE_AGE, "g_", list(_SAFE_AGE))
_SAFE_AUTH = _renamed(AUTH_CTES, "u_", list(AUTH_CTES))
_LOG = {k: v for k, v in baseline_sql(500).items()}
_LOG["numbered"] = f"""SELECT msg_id AS id, user_id, addr AS from_addr, {o.reg("split_part(addr, '@', -1)")} AS org,
    row_number() OVER (PARTITION BY user_id ORDER BY created_at, msg_id) AS rn
    FROM (SELECT *, {o.addr("from_raw")} AS addr FROM letters) z"""
_SAFE_LOG = _renamed(_LOG, "b_", list(_LOG))

_TEXT = {"t_texts": f"""
    SELECT msg_id, concat_ws(chr(10), nullif(regexp_replace(body_plain, '[ \\t\\r\\f\\v\\x{{a0}}]+', ' ', 'g'), ''),
      nullif(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(body_html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '[ \\t\\r\\f\\v]+', ' ', 'g'), ''),
      nullif(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(body_html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', '', 'g'), '&amp;', '&'), '[ \\t\\r\\f\\v]+', ' ', 'g'), '')) AS body, subject FROM letters"""}

FULL_CTES = {
    **HEADER_CTES, **_SAFE_LINKS, **_SAFE_HTML, **_SAFE_ATT, **_SAFE_ROUTE, **_SAFE_AGE, **_SAFE_AUTH,
    **_SAFE_LOG, **_TEXT,
    "t_sig": o.phrase_signals("t_texts"),
    "u_sig": o.auth_signals("u_claims"),
    "before_history": f"""
        SELECT msg_id, seq, indicator, strength, weight FROM k_link_sig
        UNION ALL SELECT msg_id, 100000, 'Punycode / Unicode Domain', 'strong', 20 FROM facts
          WHERE contains(from_domain, 'xn--')
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM t_sig
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM u_sig
        UNION ALL SELECT msg_id, 100350 + ord, 'Authentication Inconsistency', 'strong', 20 FROM u_problems
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM ({HEADER_SIGNALS}) hs
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM r_route_sig
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM g_age_sig
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM h_html_sig
        UNION ALL SELECT msg_id, 100000 + seq, indicator, strength, weight FROM a_att_sig""",
    "all_sig": f"""
        SELECT * FROM before_history
        UNION ALL SELECT c.id, 100900, CASE WHEN c.first_time_domain AND x.msg_id IS NOT NULL
             THEN 'Sender History: First Contact Requesting Payment or Credentials'
             WHEN c.first_time_domain THEN 'Sender History: First Contact from Unfamiliar Domain'
             ELSE 'Sender History: First Contact from New Address at a Known Domain' END,
          CASE WHEN c.first_time_domain AND x.msg_id IS NOT NULL THEN 'strong' ELSE 'weak' END,
          CASE WHEN c.first_time_domain AND x.msg_id IS NOT NULL THEN 15 WHEN c.first_time_domain THEN 5 ELSE 3 END
        FROM b_contacts c LEFT JOIN (SELECT DISTINCT msg_id FROM before_history
             WHERE indicator IN ({o.quoted(fv.PAYMENT_INDICATORS)})) x ON x.msg_id = c.id
        WHERE c.first_time_domain OR c.first_time_address""",
    **o.scored("SELECT msg_id, seq, indicator, strength, weight FROM all_sig", f"""
        SELECT f.msg_id, (c.spf <> 'fail' AND c.dkim <> 'fail' AND c.dmarc <> 'fail' AND (c.spf = 'pass' OR c.dkim = 'pass')
            AND coalesce({o.reg("f.from_domain")} IN ({o.quoted(fv.TRUSTED_SENDER_DOMAINS)}), FALSE)
            AND f.reply_rel <> 'suspicious' AND f.sender_rel <> 'suspicious' AND f.bounce_rel <> 'suspicious') AS trusted,
          (c.spf <> 'not_present' OR c.dkim <> 'not_present' OR c.dmarc <> 'not_present') AS claimed,
          (SELECT count(*) FROM received r WHERE r.msg_id = f.msg_id) AS hop_count,
          f.body_plain <> '' OR f.body_html <> '' AS has_body
        FROM facts f JOIN u_claims c ON c.msg_id = f.msg_id"""),
}


def full_analysis(spark, sf, narrow=None):
    d = letters(spark, sf)
    log = view(spark, sf, "letters").select(
        F.col("msg_id").alias("id"), "user_id", F.col("created_at").alias("ts"),
        _address("from_raw").alias("from_addr"))
    return analyse(d, AS_OF, whois=view(spark, sf, "whois"), history=log, narrow=narrow)


def _address(column):
    from ..functions.identity import address
    return address(column)


@query("all_signals", "U1", ctes=FULL_CTES, oracle="""
    SELECT c.msg_id, c.indicator, coalesce(h.full_weight, c.original_weight) AS original_weight,
           CAST(c.weight AS INT) AS weight, c.strength, c.family
    FROM sig_capped c LEFT JOIN h_html_sig h ON h.msg_id = c.msg_id AND h.indicator = c.indicator""")
def all_signals(spark, sf):
    return explode_rows(full_analysis(spark, sf), "signals", "msg_id").select(
        "msg_id", "indicator", "original_weight", "weight", "strength", "family")


@query("full_verdicts", "U1 A1 A2 A3 F23", ctes=FULL_CTES, oracle="""
    SELECT msg_id, raw_score, score, risk_level, reason, strong_signals, weak_signals, strong_families, trusted AS trusted_sender
    FROM msg_verdicts""")
def full_verdicts(spark, sf):
    return full_analysis(spark, sf).withColumn(
        "strong_families", F.array_join("strong_families", ",")).select(
        "msg_id", "raw_score", "score", "risk_level", "reason", "strong_signals", "weak_signals",
        "strong_families", "trusted_sender")


@query("evidence_log", "U2", ctes=FULL_CTES, oracle="""
    SELECT msg_id, 'header' AS category, title FROM header_hits
    UNION ALL SELECT h.msg_id, 'html', w.indicator FROM h_html_ranked h JOIN h_html_weights w
      ON w.category = h.category AND w.severity = h.severity
    UNION ALL SELECT msg_id, 'url', host FROM k_link_findings WHERE len(findings) > 0
    UNION ALL SELECT DISTINCT msg_id, 'attachment', filename FROM a_reasons""")
def evidence_log(spark, sf):
    d = inspected(letters(spark, sf), AS_OF).withColumn("signals", scores.no_signals())
    return report.evidence_log(d).select("msg_id", "category", "title")


@query("nested_findings", "S10 S11", ctes=FULL_CTES, oracle="""
    SELECT l.msg_id, l.from_raw,
      (SELECT count(*) FROM header_hits h WHERE h.msg_id = l.msg_id) AS header_findings,
      (SELECT count(*) FROM k_link_findings h WHERE h.msg_id = l.msg_id) AS links,
      (SELECT count(*) FROM h_html_hits h WHERE h.msg_id = l.msg_id) AS html_findings,
      (SELECT count(*) FROM a_att h WHERE h.msg_id = l.msg_id) AS attachments,
      (SELECT count(*) FROM received h WHERE h.msg_id = l.msg_id) AS hops
    FROM letters l""")
def nested_findings(spark, sf):
    d = inspected(letters(spark, sf), AS_OF)
    packed = report.findings(d, "from_raw")
    text = packed.select("msg_id", "from_raw", F.to_json(F.struct(
        "header_findings", "links", "html_findings", "attachments", "hops")).alias("finding"))
    return text.select("msg_id", "from_raw", *[
        F.json_array_length(F.get_json_object("finding", f"$.{c}")).cast("bigint").alias(c)
        for c in ("header_findings", "links", "html_findings", "attachments", "hops")])


@query("recommended_actions", "P68", ctes={**_MAIL_SCORED, **ATTACH_CTES}, oracle="""
    SELECT v.msg_id, CASE WHEN v.risk_level IN ('High', 'Critical') THEN
        2 + CASE WHEN v.msg_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN n.msg_id IS NOT NULL THEN 1 ELSE 0 END + 1 ELSE 1 END AS steps
    FROM msg_verdicts v LEFT JOIN (SELECT DISTINCT msg_id FROM named WHERE is_executable OR is_double_extension) n
      ON n.msg_id = v.msg_id""")
def recommended_actions(spark, sf):
    from .body_queries import attached
    risky = attached(spark, sf).select("msg_id", F.exists(
        "attachments", lambda a: a["is_executable"] | a["is_double_extension"]).alias("risky"))
    d = scored_mail(spark, sf).join(risky, "msg_id", "left")
    urls = F.when(F.col("msg_id") % 3 == 0, 1).otherwise(0)
    return d.select("msg_id", F.size(report.recommendations(
        "risk_level", urls, F.coalesce("risky", F.lit(False)))).alias("steps"))


@query("recommended_steps", "P68", ctes={**_MAIL_SCORED, **ATTACH_CTES}, oracle="""
    SELECT v.msg_id, CASE WHEN v.risk_level IN ('High', 'Critical') THEN concat(
        'contain: remove the message from mailboxes | block: sender at the gateway',
        CASE WHEN v.msg_id % 3 = 0 THEN ' | network: block the linked hosts' ELSE '' END,
        CASE WHEN n.msg_id IS NOT NULL THEN ' | endpoint: block the attachment hashes' ELSE '' END,
        ' | accounts: reset credentials of readers') ELSE 'none required' END AS steps
    FROM msg_verdicts v LEFT JOIN (SELECT DISTINCT msg_id FROM named WHERE is_executable OR is_double_extension) n
      ON n.msg_id = v.msg_id""")
def recommended_steps(spark, sf):
    from .body_queries import attached
    risky = attached(spark, sf).select("msg_id", F.exists(
        "attachments", lambda a: a["is_executable"] | a["is_double_extension"]).alias("risky"))
    d = scored_mail(spark, sf).join(risky, "msg_id", "left")
    return d.select("msg_id", F.array_join(report.recommendations(
        "risk_level", F.when(F.col("msg_id") % 3 == 0, 1).otherwise(0), F.coalesce("risky", F.lit(False))), " | ").alias("steps"))


@query("evidence_with_signals", "U2", ctes=FULL_CTES, oracle="""
    SELECT msg_id, 'signal' AS category, indicator AS title FROM sig_capped
    UNION ALL SELECT msg_id, 'header', title FROM header_hits
    UNION ALL SELECT h.msg_id, 'html', w.indicator FROM h_html_ranked h JOIN h_html_weights w
      ON w.category = h.category AND w.severity = h.severity
    UNION ALL SELECT msg_id, 'url', host FROM k_link_findings WHERE len(findings) > 0
    UNION ALL SELECT DISTINCT msg_id, 'attachment', filename FROM a_reasons""")
def evidence_with_signals(spark, sf):
    """The whole log, the scored signals included.  Messages are inspected once, for their findings and their score."""
    found = ("header_findings", "html_findings", "links", "attachments")
    seen = durable(message_signals(inspected(letters(spark, sf), AS_OF), found))
    scored = full_analysis(spark, sf, seen.drop(*found)).select("msg_id", "signals")
    return report.evidence_log(seen.select("msg_id", *found).join(scored, "msg_id")) \
        .select("msg_id", "category", "title")


@query("batch_summary", "S12", ctes=FULL_CTES, oracle="""
    SELECT v.msg_id, l.subject, l.from_raw, v.score, v.risk_level FROM msg_verdicts v JOIN letters l ON l.msg_id = v.msg_id""")
def batch_summary(spark, sf):
    """What a batch report lists, carried through the analysis."""
    log = view(spark, sf, "letters").select(
        F.col("msg_id").alias("id"), "user_id", F.col("created_at").alias("ts"), _address("from_raw").alias("from_addr"))
    d = analyse(letters(spark, sf), AS_OF, whois=view(spark, sf, "whois"), history=log, keep=("subject", "from_raw"))
    return d.select("msg_id", "subject", "from_raw", "score", "risk_level")


# --- accuracy ------------------------------------------------------------------

_CASES = """SELECT v.msg_id, v.risk_level IN ('High', 'Critical') AS flagged, v.msg_id % 16 BETWEEN 9 AND 14 AS malicious,
    l.quality FROM msg_verdicts v JOIN labels l ON l.doc_id = v.msg_id"""


def labelled(spark, sf):
    """Verdicts of labelled documents; the sender they were given decides the label."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("msg_id"))
    return scored_mail(spark, sf).join(known, "msg_id") \
        .withColumn("malicious", (F.col("msg_id") % 16).between(9, 14))


@query("confusion_matrix", "A9 A10", ctes={**_MAIL_SCORED, "cases": _CASES}, oracle="""
    SELECT tp, fp, tn, fn, round_even(p, 4) AS precision, round_even(r, 4) AS recall,
      round_even((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
      round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
      SELECT count(*) FILTER (flagged AND malicious) AS tp, count(*) FILTER (flagged AND NOT malicious) AS fp,
             count(*) FILTER (NOT flagged AND NOT malicious) AS tn, count(*) FILTER (NOT flagged AND malicious) AS fn FROM cases) a) b""")
def confusion_matrix(spark, sf):
    return evaluation.accuracy(evaluation.confusion(labelled(spark, sf)))


@query("toxic_confusion_matrix", "A9 A10", ctes={**_MAIL_SCORED, "cases": """SELECT v.msg_id,
    v.risk_level IN ('High', 'Critical') AS flagged, l.toxic = 1 AS malicious FROM msg_verdicts v JOIN labels l ON l.doc_id = v.msg_id
    WHERE l.toxic IS NOT NULL"""}, oracle="""
    SELECT count(*) FILTER (flagged AND malicious) AS tp, count(*) FILTER (flagged AND NOT malicious) AS fp,
           count(*) FILTER (NOT flagged AND NOT malicious) AS tn, count(*) FILTER (NOT flagged AND malicious) AS fn FROM cases""")
def toxic_confusion_matrix(spark, sf):
    """The labels' own judgement as truth."""
    truth = table(spark, sf, "labels").where("toxic is not null").select(
        F.col("doc_id").alias("msg_id"), (F.col("toxic") == 1).alias("malicious"))
    return evaluation.confusion(scored_mail(spark, sf).join(truth, "msg_id")).select("tp", "fp", "tn", "fn")


@query("top_signals_per_case", "O6", ctes=_MAIL_SCORED, oracle="""
    SELECT msg_id, rn AS place, indicator, CAST(weight AS INT) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY weight DESC, seq) AS rn FROM sig_capped) z
    WHERE rn <= 2 AND weight > 0""")
def top_signals_per_case(spark, sf):
    d = scored_mail(spark, sf).select("msg_id", evaluation.top_signals(2).alias("s"))
    return explode_rows(d, "s", "msg_id", pos="p").select(
        "msg_id", (F.col("p") + 1).alias("place"), "indicator", "weight")


@query("top_eight_signals", "O6", ctes=_MAIL_SCORED, oracle="""
    SELECT msg_id, rn AS place, indicator, CAST(weight AS INT) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY weight DESC, seq) AS rn FROM sig_capped) z
    WHERE rn <= 8 AND weight > 0""")
def top_eight_signals(spark, sf):
    d = scored_mail(spark, sf).select("msg_id", evaluation.top_signals(8).alias("s"))
    return explode_rows(d, "s", "msg_id", pos="p").select(
        "msg_id", (F.col("p") + 1).alias("place"), "indicator", "weight")


# --- stored results ------------------------------------------------------------

REC = {"cur": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn
                 FROM records_log) z WHERE rn = 1""",
       "shown": f"""
        SELECT id, user_id, filename, coalesce(nullif(json_extract_string(finding_json, '$.subject'), ''), '(No Subject)') AS subject,
          coalesce(nullif(json_extract_string(finding_json, '$.from_addr'), ''), '-') AS from_addr,
          CASE WHEN json_extract(finding_json, '$.raw_score') IS NULL AND risk_score > 100 THEN {o.display_score("risk_score")}
               ELSE risk_score END AS score, verdict AS risk_level, CAST(created_at AS DATE) AS date, created_at, risk_score FROM cur"""}


def _current(spark, sf):
    return records.current(view(spark, sf, "records_log"))


@query("current_records", "S13", ctes=REC, oracle="SELECT id, version, verdict, risk_score FROM cur")
def current_records(spark, sf):
    return _current(spark, sf).select("id", "version", "verdict", "risk_score")


@query("history_listing", "P72 F37", ctes=REC, oracle="SELECT * EXCLUDE (created_at, risk_score) FROM shown")
def history_listing(spark, sf):
    return records.listing(_current(spark, sf)).drop("created_at", "risk_score")


@query("history_search", "P66", ctes=REC, oracle="""
    SELECT id, verdict, 'safe' AS kind FROM cur WHERE verdict = 'Low'
    UNION ALL SELECT id, verdict, 'search' FROM cur WHERE verdict = 'High' AND (filename ILIKE '%1 (%'
      OR json_extract_string(finding_json, '$.subject') ILIKE '%account%' OR json_extract_string(finding_json, '$.from_addr') ILIKE '%account%'
      OR filename ILIKE '%account%')
    UNION ALL SELECT id, verdict, 'owner' FROM cur WHERE user_id = 8""")
def history_search(spark, sf):
    cur = _current(spark, sf)
    safe = records.history(cur, risk_level="Safe").withColumn("kind", F.lit("safe"))
    found = records.history(cur, risk_level="High", search=" ACCOUNT ") \
        .union(records.history(cur, risk_level="High", search="1 (")).distinct() \
        .withColumn("kind", F.lit("search"))
    mine = records.history(cur, user_id=8).withColumn("kind", F.lit("owner"))
    return safe.unionByName(found).unionByName(mine).select("id", "verdict", "kind")


def _paged(name, sort, order, limit, offset, covers):
    @query(name, covers, ctes=REC, oracle=f"SELECT id, score FROM shown ORDER BY {order} LIMIT {min(limit, 100)} OFFSET {offset}")
    def run(spark, sf):
        return records.page(records.listing(_current(spark, sf)), sort, limit, offset) \
            .select("id", "score")
    return run


_paged("history_newest_first", "date_desc", "created_at DESC, id", 50, 0, "O2 O3")
_paged("history_oldest_first", "date_asc", "created_at, id", 20, 40, "O2 O3")
_paged("history_highest_score", "score_desc", "risk_score DESC, id", 500, 10, "O2 O3")
_paged("history_lowest_score", "score_asc", "risk_score, id", 25, 5, "O2 O3")
_paged("history_by_filename", "filename", "filename, id", 30, 0, "O2 O3")


@query("newest_investigations", "O5", ctes=REC, oracle="SELECT id FROM cur ORDER BY created_at DESC, id LIMIT 6")
def newest_investigations(spark, sf):
    return records.newest(_current(spark, sf)).select("id")


@query("dashboard_counts", "A11 A12", ctes=REC, oracle="""
    SELECT user_id, count(*) AS total, count(*) FILTER (verdict IN ('High', 'Critical')) AS high,
           count(*) FILTER (verdict = 'Medium') AS medium, count(*) FILTER (verdict IN ('Low', 'Safe')) AS safe
    FROM cur GROUP BY user_id""")
def dashboard_counts(spark, sf):
    return records.dashboard(_current(spark, sf), "user_id")


@query("record_lookup", "J14", ctes=REC, oracle="""
    SELECT c.id, c.verdict FROM cur c JOIN events e ON concat('r', CAST(e.event_id AS STRING)) = c.id
      AND e.user_id = c.user_id WHERE e.event_type = 'view'""")
def record_lookup(spark, sf):
    asked = table(spark, sf, "events").where("event_type = 'view'").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), "user_id")
    return records.owned(_current(spark, sf), asked).select("id", "verdict")


_LEFT = """
    SELECT id, version, verdict FROM cur c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
      AND concat('r', CAST(e.event_id AS STRING)) = c.id AND e.user_id - e.event_id % 2 = c.user_id)"""


@query("compacted_records", "S13 J15", ctes=REC, oracle=_LEFT)
def compacted_records(spark, sf):
    """The log and the deletions arrive in three increments each, in no order of versions."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    log = view(spark, sf, "records_log")
    gone = table(spark, sf, "events").where("event_type = 'error'").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
        (F.col("user_id") - F.col("event_id") % 2).alias("user_id"))
    for name, rows, keys, version in (("log", log, ["id"], "version"), ("gone", gone, ["id", "user_id"], None)):
        store.create(spark, f"{folder}/{name}")
        for part in range(3):
            store.upsert(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == part), f"{folder}/{name}", keys, version)
    return records.without_deleted(store.read(spark, f"{folder}/log", log.schema),
                                   store.read(spark, f"{folder}/gone", gone.schema)).select("id", "version", "verdict")


_TERMS = ["account", "1 (", "(SRC3", "harbor.com", "stripe%com", "z", "no such words"]


@query("indexed_search", "P66", ctes=REC, oracle=" UNION ALL ".join(f"""
    SELECT '{term}' AS term, id, verdict FROM cur WHERE filename ILIKE '%{term}%'
      OR json_extract_string(finding_json, '$.subject') ILIKE '%{term}%'
      OR json_extract_string(finding_json, '$.from_addr') ILIKE '%{term}%'""" for term in _TERMS))
def indexed_search(spark, sf):
    """All stored records are indexed once; each term then reads its own postings and the rows they name."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    current = durable(_current(spark, sf))
    search.build(current, folder)
    found = [search.search(spark, folder, current.schema, term).select(F.lit(term).alias("term"), "id", "verdict") for term in _TERMS]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("record_deletion", "J15", ctes=REC, oracle="""
    SELECT id, verdict FROM cur c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
      AND concat('r', CAST(e.event_id AS STRING)) = c.id AND e.user_id - e.event_id % 2 = c.user_id)""")
def record_deletion(spark, sf):
    gone = table(spark, sf, "events").where("event_type = 'error'").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
        (F.col("user_id") - F.col("event_id") % 2).alias("user_id"))
    return records.without_deleted(_current(spark, sf), gone).select("id", "verdict")
