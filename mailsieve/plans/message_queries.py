"""Queries over wording, authentication claims and delivery routes, and the verdicts
that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scores
from ..functions.base import explode_rows
from ..functions.text import decode_entities, normalise
from ..operators import auth, content, headers, routing, scoring, wording
from . import oracle as o
from .registry import query
from .tables import letters, table, view
from .views import AS_OF


def mail_messages(spark, sf):
    """The plain mail view in the engine's row shape; claims come ready-made."""
    empty = F.expr("cast(array() as array<string>)")
    return view(spark, sf, "mail").withColumnsRenamed(
        {"reply_to": "reply_to_raw", "return_path": "return_path_raw"}).drop(
        "from_addr", "from_domain").withColumns({
            "sender_raw": F.lit(""), "body_html": F.lit(""), "received_chain": empty,
            "authentication_results": empty, "spf_details": F.lit(""), "dkim_details": F.lit(""),
            "dmarc_details": F.lit("")})


def scored_mail(spark, sf):
    """Verdicts over the mail view: identity-free flagship, wording plus claims."""
    d = headers.with_identity(mail_messages(spark, sf))
    d = scoring.with_trust(content.with_match_text(d))
    d = d.withColumn("auth_inconsistencies", F.expr("cast(array() as array<string>)"))
    d = d.select("msg_id", "subject", "from_raw", "trusted_sender", "spf", "dkim", "dmarc",
                 F.lit(0).alias("hop_count"), (F.col("body_plain") != "").alias("has_body"),
                 F.concat(content.content_signals(), auth.auth_signals()).alias("signals"))
    return scoring.verdicts(d, keep=("subject", "from_raw"))


_MAIL = {
    "who": f"""SELECT m.msg_id, m.subject, m.from_raw, m.body_plain, m.spf, m.dkim, m.dmarc,
                      m.from_domain, {o.dom(o.addr("m.reply_to"))} AS reply_domain,
                      {o.dom(o.addr("m.return_path"))} AS bounce_domain FROM mail m""",
    **o.lookalike("SELECT DISTINCT unnest([reply_domain, bounce_domain]) AS domain FROM who"),
    "trusted": f"""
        SELECT w.msg_id, (w.spf <> 'fail' AND w.dkim <> 'fail' AND w.dmarc <> 'fail'
          AND (w.spf = 'pass' OR w.dkim = 'pass')
          AND {o.reg("w.from_domain")} IN ({o.quoted(fv.TRUSTED_SENDER_DOMAINS)})
          AND {o.relation("w.from_domain", "w.reply_domain", "lr.brand")} <> 'suspicious'
          AND {o.relation("w.from_domain", "w.bounce_domain", "lb.brand")} <> 'suspicious') AS trusted
        FROM who w LEFT JOIN look lr ON lr.domain = w.reply_domain
        LEFT JOIN look lb ON lb.domain = w.bounce_domain""",
    "texts": "SELECT msg_id, body_plain AS body, subject FROM mail",
    "phrase_sig": o.phrase_signals("texts"),
    "auth_sig": o.auth_signals("mail"),
}
_MAIL_SCORED = {**_MAIL, **o.scored(
    "SELECT msg_id, seq, indicator, strength, weight FROM phrase_sig UNION ALL SELECT * FROM auth_sig",
    """SELECT w.msg_id, t.trusted, (w.spf <> 'not_present' OR w.dkim <> 'not_present'
         OR w.dmarc <> 'not_present') AS claimed, 0 AS hop_count, TRUE AS has_body
       FROM who w JOIN trusted t ON t.msg_id = w.msg_id""")}


@query("ranked_verdicts", "O1 S12 F21 F22 F23 A1 A2 A3", oracle="""
    SELECT v.msg_id, w.subject, w.from_raw, v.raw_score, v.score, v.risk_level, v.reason,
           v.strong_signals, v.weak_signals, v.strong_families, v.strong_weight
    FROM msg_verdicts v JOIN who w ON w.msg_id = v.msg_id""", ctes=_MAIL_SCORED)
def ranked_verdicts(spark, sf):
    d = scored_mail(spark, sf).withColumn(
        "strong_families", F.array_join("strong_families", ","))
    return scoring.ranked(d.select(
        "msg_id", "subject", "from_raw", "raw_score", "score", "risk_level", "reason",
        "strong_signals", "weak_signals", "strong_families", "strong_weight"))


_score, _label = o.confidence()


@query("evidence_confidence", "A7", ctes=_MAIL_SCORED, oracle=f"""
    SELECT msg_id, {_score} AS confidence, {_label} AS confidence_label,
           concat(coalesce(concat({_score}, '%'), 'N/A'), ' (', {_label}, ')') AS shown,
           100 - score AS trust_level FROM msg_verdicts""")
def evidence_confidence(spark, sf):
    d = scored_mail(spark, sf)
    return d.select("msg_id", "confidence", "confidence_label",
                    scores.confidence_label("confidence", "confidence_label").alias("shown"),
                    scores.trust_level("score").alias("trust_level"))


@query("family_saturation", "W5 F24 F25 J13", ctes=_MAIL_SCORED, oracle=f"""
    SELECT msg_id, indicator, family, original_weight, CAST(weight AS INT) AS weight, strength,
           {o.severity("original_weight")} AS severity,
           family AS family_by_name FROM sig_capped""")
def family_saturation(spark, sf):
    return explode_rows(scored_mail(spark, sf), "signals", "msg_id").select(
        "msg_id", "indicator", "family", "original_weight", "weight", "strength", "severity",
        scores.family_of("indicator").alias("family_by_name"))


@query("signal_contributions", "W11 F43", ctes=_MAIL_SCORED, oracle="""
    SELECT c.msg_id, c.indicator,
           CASE WHEN t.raw_score > 0 AND c.weight > 0
                THEN round_even(100.0 * c.weight / t.raw_score, 1) ELSE 0 END AS contribution_pct,
           CASE WHEN c.weight <= 0 THEN 'CAPPED' ELSE concat('+', CAST(c.weight AS INT)) END AS shown
    FROM sig_capped c JOIN msg_totals t ON t.msg_id = c.msg_id""")
def signal_contributions(spark, sf):
    return explode_rows(scored_mail(spark, sf), "signals", "msg_id").select(
        "msg_id", "indicator", "contribution_pct",
        scores.contribution_label("weight").alias("shown"))


@query("verdict_rationale", "A16 P69 F44", ctes=_MAIL_SCORED, oracle="""
    SELECT v.msg_id, concat('score=', v.score, ' strong=', v.strong_signals,
        ' families=', CASE WHEN v.strong_families = '' THEN 0 ELSE len(string_split(v.strong_families, ',')) END,
        ' weak=', v.weak_signals, ' | strong: ', coalesce(s.names, 'none'),
        ' | weak: ', coalesce(k.names, 'none')) AS rationale,
      CASE WHEN v.risk_level IN ('High', 'Critical') THEN 'MALICIOUS'
           WHEN v.risk_level = 'Medium' THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS headline,
      100 - least(greatest(v.score, 0), 100) AS trust_level
    FROM msg_verdicts v
    LEFT JOIN (SELECT msg_id, string_agg(indicator, ', ' ORDER BY rn) AS names FROM (
      SELECT msg_id, indicator, row_number() OVER (PARTITION BY msg_id ORDER BY weight DESC, seq) AS rn
      FROM sig_capped WHERE weight > 0 AND strength = 'strong') z WHERE rn <= 5 GROUP BY msg_id) s
      ON s.msg_id = v.msg_id
    LEFT JOIN (SELECT msg_id, string_agg(indicator, ', ' ORDER BY rn) AS names FROM (
      SELECT msg_id, indicator, row_number() OVER (PARTITION BY msg_id ORDER BY weight DESC, seq) AS rn
      FROM sig_capped WHERE weight > 0 AND strength = 'weak') z WHERE rn <= 5 GROUP BY msg_id) k
      ON k.msg_id = v.msg_id""")
def verdict_rationale(spark, sf):
    return scored_mail(spark, sf).select(
        "msg_id", "rationale", scores.verdict_headline("risk_level").alias("headline"),
        scores.trust_level("score").alias("trust_level"))


@query("phrase_families", "P52 P53 X2", ctes=_MAIL,
       oracle="SELECT msg_id, indicator, weight, strength, evidence FROM phrase_sig")
def phrase_families(spark, sf):
    d = content.with_match_text(mail_messages(spark, sf))
    return explode_rows(d.select("msg_id", content.content_signals().alias("s")), "s", "msg_id") \
        .select("msg_id", "indicator", "weight", "strength", "evidence")


_FIXED_RULES = ", ".join(
    f"('{family}', '{indicator}', {weight}, '{strength}', {100 * n + i}, '{pattern}')"
    for n, (family, indicator, weight, strength, patterns) in enumerate(fv.PHRASE_FAMILIES)
    for i, (_, pattern) in enumerate(patterns))


@query("phrase_rules", "P52 X2", ctes={
    "sentences": """
        SELECT item_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS sentence FROM (
          SELECT item_id, string_split(text, '.') AS parts FROM benchmark) z""",
    "rule_rows": f"""
        SELECT * FROM (VALUES {_FIXED_RULES}) AS f(family, indicator, weight, strength, pos, pattern)
        UNION ALL SELECT concat('item ', CAST(item_id AS VARCHAR)), 'Known passage', 5, 'weak', 100000 + place - 1,
          regexp_replace(trim(sentence, concat(' ', chr(10))), '\\s+', '\\\\s+', 'g') FROM sentences
        WHERE length(trim(sentence, concat(' ', chr(10)))) >= 12""",
    "hits": """
        SELECT m.msg_id, r.*, coalesce(nullif(regexp_extract(m.body_plain, concat('(?i)', r.pattern), 0), ''),
          nullif(regexp_extract(m.subject, concat('(?i)', r.pattern), 0), '')) AS evidence
        FROM mail m CROSS JOIN rule_rows r"""}, oracle="""
    SELECT msg_id, family, indicator, weight, strength, evidence FROM (
      SELECT *, row_number() OVER (PARTITION BY msg_id, family ORDER BY pos) AS rn FROM hits WHERE evidence IS NOT NULL) z
    WHERE rn = 1""")
def phrase_rules(spark, sf):
    """Every message against rules of a table: the built-in ones and each sentence of the known passages."""
    sentences = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("place", "sentence")) \
        .withColumn("sentence", F.btrim("sentence", F.lit(" \n"))).where(F.length("sentence") >= 12)
    known = sentences.select(
        F.concat(F.lit("item "), "item_id").alias("family"), F.lit("Known passage").alias("indicator"),
        F.lit(5).alias("weight"), F.lit("weak").alias("strength"), (F.lit(100000) + F.col("place")).alias("pos"),
        F.regexp_extract_all("sentence", F.lit(r"(?U)\w+"), F.lit(0)).alias("words"),
        F.regexp_replace("sentence", r"\s+", r"\\s+").alias("pattern"))
    d = content.with_match_text(mail_messages(spark, sf))
    hits = wording.with_wording_hits(d, wording.fixed_rules(spark).unionByName(known)).select("msg_id", "wording_hits")
    return explode_rows(hits, "wording_hits", "msg_id")


@query("trusted_senders", "P56", ctes=_MAIL, oracle="SELECT msg_id, trusted FROM trusted")
def trusted_senders(spark, sf):
    d = scoring.with_trust(headers.with_identity(mail_messages(spark, sf)))
    return d.select("msg_id", F.col("trusted_sender").alias("trusted"))


@query("score_mapping", "F21 X3", oracle=f"""
    SELECT event_id, raw, {o.display_score("raw")} AS score, {o.bucket(o.display_score("raw"))} AS bucket
    FROM (SELECT event_id, CAST(abs(hash_source) % 2001 AS INT) AS raw FROM (
      SELECT event_id, event_id * 7919 + user_id AS hash_source FROM events) y) z""")
def score_mapping(spark, sf):
    from ..functions.sql_names import register
    register(spark)
    return table(spark, sf, "events").select(
        "event_id", F.expr("cast(abs(event_id * 7919 + user_id) % 2001 as int)").alias("raw")) \
        .select("event_id", "raw", F.expr("display_score(raw)").alias("score"),
                F.expr("risk_bucket(display_score(raw))").alias("bucket"))


# --- text ----------------------------------------------------------------------

_ENTITY_TEXT = ("concat('&lt;b&gt; caf&eacute; &#112;&#x61;ss&amp;', 'x', chr(173), 'y', chr(160), "
                "chr(9), ' z ', {t})")


def _decode_chain(x: str) -> str:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&eacute;", "é"), ("&#112;", "p"),
                     ("&#x61;", "a"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


@query("normalised_text", "F14", oracle=f"""
    SELECT doc_id, md5(regexp_replace(regexp_replace({_decode_chain(_ENTITY_TEXT.format(t="text"))},
        '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}\\x{{feff}}]', '', 'g'),
        '[ \\t\\r\\f\\v\\x{{a0}}]+', ' ', 'g')) AS digest
    FROM documents""")
def normalised_text(spark, sf):
    marked = F.concat(F.lit("&lt;b&gt; caf&eacute; &#112;&#x61;ss&amp;x­y \t z "), "text")
    return table(spark, sf, "documents").select("doc_id", F.md5(
        F.encode(normalise(marked), "UTF-8")).alias("digest"))


def _stripped(x: str, r: str) -> str:
    no_script = (f"regexp_replace(regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), "
                 "'(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')")
    return f"regexp_replace(regexp_replace({no_script}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', '{r}', 'g')"


@query("markup_stripping", "F13 U4", oracle=f"""
    SELECT msg_id, length(spaced) AS spaced_chars, md5(spaced) AS spaced, md5(glued) AS glued
    FROM (SELECT msg_id, {_stripped("body_html", " ")} AS spaced, {_stripped("body_html", "")} AS glued
          FROM mail_html) z""")
def markup_stripping(spark, sf):
    from ..functions.text import strip_markup
    d = view(spark, sf, "mail_html").select(
        "msg_id", strip_markup("body_html", " ").alias("spaced"),
        strip_markup("body_html", "").alias("glued"))
    return d.select("msg_id", F.length("spaced").alias("spaced_chars"),
                    F.md5(F.encode("spaced", "UTF-8")).alias("spaced"),
                    F.md5(F.encode("glued", "UTF-8")).alias("glued"))


# --- authentication claims -----------------------------------------------------

def _claim(pattern):
    return f"coalesce(nullif(lower(regexp_extract(raw, '{pattern}', 1)), ''), 'not_present')"


AUTH_CTES = {
    "ar_joined": "SELECT msg_id, string_agg(raw, ' ' ORDER BY pos) AS raw, count(*) AS n FROM auth_results GROUP BY msg_id",
    "claims": f"""
        SELECT l.msg_id, {o.dom(o.addr("l.from_raw"))} AS from_domain, a.n, a.raw,
               {_claim(auth.SPF_CLAIM)} AS spf, {_claim(auth.DKIM_CLAIM)} AS dkim,
               {_claim(auth.DMARC_CLAIM)} AS dmarc,
               nullif(regexp_extract(raw, '(?i)smtp\\.mailfrom=([^\\s;]+)', 1), '') AS mailfrom,
               coalesce(nullif(lower(rtrim(regexp_extract(raw, '(?i)header\\.d=([^\\s;]+)', 1), '.')), ''),
                 nullif(lower(split_part(rtrim(regexp_extract(raw, '(?i)header\\.i=([^\\s;]+)', 1), '.'), '@', -1)), '')) AS signer,
               nullif(regexp_extract(raw, '{auth.POLICY_CLAIM}', 1), '') AS policy
        FROM letters l LEFT JOIN ar_joined a ON a.msg_id = l.msg_id""",
    "conflicts": f"""
        SELECT msg_id, count(DISTINCT s) AS n_spf, count(DISTINCT k) AS n_dkim,
               string_agg(s, ',' ORDER BY pos) AS spfs, string_agg(k, ',' ORDER BY pos) AS dkims
        FROM (SELECT msg_id, pos, nullif(lower(regexp_extract(raw, '{auth.SPF_CLAIM}', 1)), '') AS s,
                     nullif(lower(regexp_extract(raw, '{auth.DKIM_CLAIM}', 1)), '') AS k
              FROM auth_results) z GROUP BY msg_id HAVING count(*) > 1""",
    "problems": f"""
        SELECT msg_id, 0 AS ord, concat('conflicting spf: ', spfs) AS problem FROM conflicts WHERE n_spf > 1
        UNION ALL SELECT msg_id, 1, concat('conflicting dkim: ', dkims) FROM conflicts WHERE n_dkim > 1
        UNION ALL SELECT msg_id, 2, CASE WHEN bounce IS NOT NULL AND from_domain IS NOT NULL
               AND bounce <> from_domain AND {o.reg("bounce")} <> {o.reg("from_domain")}
             THEN concat('spf alignment failure: ', bounce, ' vs ', from_domain)
             ELSE 'dmarc failed although spf passed' END
           FROM (SELECT *, lower(split_part(mailfrom, '@', -1)) AS bounce FROM claims) c
           WHERE spf = 'pass' AND dmarc = 'fail'
        UNION ALL SELECT msg_id, 3, concat('dkim alignment warning: ', signer, ' vs ', from_domain) FROM claims
           WHERE dkim = 'pass' AND signer <> from_domain AND {o.reg("signer")} <> {o.reg("from_domain")}
        UNION ALL SELECT msg_id, 4, 'complete authentication failure' FROM claims
           WHERE spf IN ('fail', 'softfail') AND dkim IN ('fail', 'none') AND dmarc = 'fail'""",
}


def claimed_auth(spark, sf):
    d = auth.with_header_auth(headers.with_identity(letters(spark, sf, attachments=False)))
    return d.withColumn("auth_inconsistencies", auth.inconsistencies())


@query("auth_claims", "P57", ctes=AUTH_CTES, oracle="""
    SELECT msg_id, spf, dkim, dmarc, mailfrom, signer, policy FROM claims""")
def auth_claims(spark, sf):
    return claimed_auth(spark, sf).select(
        "msg_id", "spf", "dkim", "dmarc", "mailfrom", F.col("dkim_domain").alias("signer"),
        F.col("dmarc_policy").alias("policy"))


@query("auth_inconsistencies", "P58 P59 P60 P61 A14", ctes=AUTH_CTES, oracle="""
    SELECT msg_id, string_agg(problem, ' | ' ORDER BY ord) AS problems FROM problems GROUP BY msg_id""")
def auth_inconsistencies(spark, sf):
    return claimed_auth(spark, sf).where(F.size("auth_inconsistencies") > 0).select(
        "msg_id", F.array_join(F.array_distinct("auth_inconsistencies"), " | ").alias("problems"))


@query("auth_explanations", "P62", ctes=AUTH_CTES, oracle="""
    SELECT c.msg_id, CASE WHEN t.txt = '' THEN 'No authentication results to explain.' ELSE t.txt END AS explanation
    FROM claims c LEFT JOIN (SELECT msg_id, string_agg(problem, ' | ' ORDER BY ord) AS ps FROM problems GROUP BY msg_id) p
      ON p.msg_id = c.msg_id,
    LATERAL (SELECT array_to_string(list_filter([
      CASE WHEN c.spf = 'pass' THEN 'SPF passed: the sending host is authorised.'
           WHEN c.spf IN ('fail', 'softfail') THEN concat('SPF ', c.spf, ': host not authorised.')
           WHEN c.spf = 'none' THEN 'SPF: no record published.' END,
      CASE c.dkim WHEN 'pass' THEN 'DKIM passed: the signature is intact.'
           WHEN 'fail' THEN 'DKIM failed: signature or content changed.'
           WHEN 'none' THEN 'DKIM: message is unsigned.' END,
      CASE c.dmarc WHEN 'pass' THEN 'DMARC passed.' WHEN 'fail' THEN 'DMARC failed: no aligned identifier.' END,
      CASE WHEN p.ps IS NOT NULL THEN concat('Anomalies: ', p.ps) END], lambda x: x IS NOT NULL), ' ') AS txt) t""")
def auth_explanations(spark, sf):
    return claimed_auth(spark, sf).select("msg_id", auth.explanation(
        "spf", "dkim", "dmarc", F.col("auth_inconsistencies")).alias("explanation"))


@query("auth_attribution", "P63 A13", ctes={
    "hosts_by": """SELECT DISTINCT msg_id, trim(lower(regexp_extract(raw, '(?i)\\bby\\s+([A-Za-z0-9._-]+)', 1)), '.') AS host
                   FROM received WHERE regexp_matches(raw, '(?i)\\bby\\s+[A-Za-z0-9._-]+')""",
    "ids": """SELECT msg_id, trim(lower(regexp_extract(trim(raw), '^\\s*([A-Za-z0-9_.:\\[\\]-]+)\\s*;', 1)), '.') AS who
              FROM auth_results"""}, oracle=f"""
    SELECT l.msg_id, coalesce(h.hosts, '') AS received_hosts, EXISTS (
      SELECT 1 FROM ids i JOIN hosts_by b ON b.msg_id = i.msg_id AND contains(i.who, '.')
        AND (i.who = b.host OR ends_with(b.host, '.' || i.who) OR ends_with(i.who, '.' || b.host)
             OR {o.reg("i.who")} = {o.reg("b.host")}) WHERE i.msg_id = l.msg_id) AS attributed
    FROM letters l LEFT JOIN (SELECT msg_id, string_agg(host, ',' ORDER BY host) AS hosts
                              FROM hosts_by GROUP BY msg_id) h ON h.msg_id = l.msg_id""")
def auth_attribution(spark, sf):
    d = headers.with_identity(letters(spark, sf, attachments=False))
    d = d.withColumn("attributed", auth.is_attributed())
    return d.select("msg_id", F.array_join("received_hosts", ",").alias("received_hosts"),
                    "attributed")


@query("auth_signal_weights", "J12 F27", ctes={**AUTH_CTES, "auth_sig": o.auth_signals("claims")}, oracle="""
    SELECT msg_id, indicator, strength, weight FROM auth_sig
    UNION ALL SELECT msg_id, 'Authentication Inconsistency', 'strong', 20 FROM problems""")
def auth_signal_weights(spark, sf):
    d = claimed_auth(spark, sf).select("msg_id", auth.auth_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "strength", "weight")


# --- delivery routes -----------------------------------------------------------

_IP = "regexp_extract(raw, '\\[([0-9a-fA-F:.]+)\\]', 1)"
_NUM = "list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b)"
_BLOCKS = """(VALUES ('Loopback', 2130706432, 2147483647), ('Private', 0, 16777215),
  ('Private', 167772160, 184549375), ('Private', 2851995648, 2852061183), ('Private', 2886729728, 2887778303),
  ('Private', 3221225984, 3221226239), ('Private', 3232235520, 3232301055), ('Private', 3323068416, 3323199487),
  ('Private', 3325256704, 3325256959), ('Private', 3405803776, 3405804031), ('Private', 4026531840, 4294967295),
  ('CGNAT', 1681915904, 1686110207)) AS blocks(kind, lo, hi)"""

ROUTE_CTES = {
    "hop_parsed": f"""
        SELECT msg_id, pos, raw, nullif(regexp_extract(raw, '(?i)\\bfrom\\s+([^\\s;]+)', 1), '') AS from_host,
               nullif(regexp_extract(raw, '(?i)\\bby\\s+([^\\s;]+)', 1), '') AS by_host, {_IP} AS ip,
               nullif(regexp_extract(raw, '(?i)\\bwith\\s+([^\\s;]+)', 1), '') AS protocol,
               nullif(regexp_extract(raw, '(?i)\\bfor\\s+<([^>]+)>', 1), '') AS recipient,
               trim(split_part(raw, ';', -1)) AS stamp,
               try_strptime(trim(split_part(raw, ';', -1)), '%a, %d %b %Y %H:%M:%S %z') AS ts
        FROM received""",
    "hop_numbered": f"""
        SELECT h.*, CAST(row_number() OVER (PARTITION BY h.msg_id ORDER BY h.pos DESC) AS INT) AS hop_number,
               coalesce((SELECT min(kind) FROM {_BLOCKS} WHERE h.n BETWEEN lo AND hi), 'Public') AS ip_class
        FROM (SELECT *, {_NUM} AS n FROM hop_parsed) h""",
    "hop_timed": """
        SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w), 0) AS delay,
               coalesce(bool_or(ip_class = 'Public') OVER (PARTITION BY msg_id ORDER BY hop_number
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS public_before,
               lead(from_host) OVER w AS next_from
        FROM hop_numbered WINDOW w AS (PARTITION BY msg_id ORDER BY hop_number)""",
    "flags": f"""
        SELECT msg_id, hop_number * 10 AS ord, 'future_timestamp' AS rule, hop_number AS hop FROM hop_timed
          WHERE epoch(ts) - epoch(TIMESTAMPTZ '{AS_OF}+00') > 300
        UNION ALL SELECT msg_id, hop_number * 10 + 1, 'unparseable_timestamp', hop_number FROM hop_timed WHERE ts IS NULL
        UNION ALL SELECT msg_id, hop_number * 10 + 2, 'time_travel', hop_number FROM hop_timed WHERE delay < -5
        UNION ALL SELECT msg_id, hop_number * 10 + 3, 'excessive_delay', hop_number FROM hop_timed WHERE delay > 86400
        UNION ALL SELECT msg_id, hop_number * 10 + 4, 'private_after_public', hop_number FROM hop_timed
          WHERE public_before AND ip_class IN ('Private', 'Loopback')
        UNION ALL SELECT msg_id, 1000 + hop_number, 'discontinuity', hop_number FROM hop_timed
          WHERE split_part(lower(by_host), '.', 1) <> split_part(lower(next_from), '.', 1)
            AND array_to_string(string_split(lower(by_host), '.')[-2:], '.')
             <> array_to_string(string_split(lower(next_from), '.')[-2:], '.')
        UNION ALL SELECT msg_id, 2000, 'single_hop', NULL FROM received GROUP BY msg_id HAVING count(*) = 1
        UNION ALL SELECT d.doc_id, 0, 'no_received', NULL FROM documents d
          WHERE NOT EXISTS (SELECT 1 FROM received r WHERE r.msg_id = d.doc_id)""",
    "rule_weights": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', {w}, '{n}')" for k, (w, n) in fv.ROUTING_RULES.items()) + ") AS r(rule, weight, indicator)",
    "route_sig": """
        SELECT msg_id, 500 + rn AS seq, concat('Routing Forensics: ', indicator) AS indicator,
               CASE WHEN weight >= 20 THEN 'strong' ELSE 'weak' END AS strength, weight, n
        FROM (SELECT f.msg_id, w.indicator, w.weight, count(*) AS n,
                     row_number() OVER (PARTITION BY f.msg_id ORDER BY w.weight DESC, min(f.ord)) AS rn
              FROM flags f JOIN rule_weights w ON w.rule = f.rule
              GROUP BY f.msg_id, w.rule, w.indicator, w.weight) z WHERE rn <= 3""",
}


def routed(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id")) \
        .join(routing.chains(view(spark, sf, "received")), "msg_id", "left") \
        .withColumn("received_chain", F.coalesce(
            "received_chain", F.expr("cast(array() as array<string>)")))
    return routing.with_routing_flags(routing.with_hops(d), AS_OF)


@query("hop_fields", "F15 F16 F17 W1", ctes=ROUTE_CTES, oracle="""
    SELECT msg_id, hop_number, from_host, by_host, ip, ip_class, protocol, recipient,
           strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS sent FROM hop_numbered""")
def hop_fields(spark, sf):
    return explode_rows(routed(spark, sf), "hops", "msg_id").select(
        "msg_id", "hop_number", "from_host", "by_host", "ip", "ip_class", "protocol", "recipient",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query("hop_timeline", "W2 W3 W4 F18", ctes=ROUTE_CTES, oracle="""
    SELECT msg_id, hop_number, CAST(delay AS DOUBLE) AS delay_seconds, public_before, next_from,
      CASE WHEN hop_number = 1 THEN 'Origin' WHEN delay < 0 THEN format('-{}s ⚠️', CAST(-delay AS BIGINT))
           WHEN delay < 60 THEN format('+{}s', CAST(delay AS BIGINT))
           WHEN delay < 3600 THEN format('+{}m {}s', CAST(delay AS BIGINT) // 60, CAST(delay AS BIGINT) % 60)
           ELSE format('+{}h {}m', CAST(delay AS BIGINT) // 3600, (CAST(delay AS BIGINT) % 3600) // 60) END AS delay_label
    FROM hop_timed""")
def hop_timeline(spark, sf):
    return explode_rows(routed(spark, sf), "hops", "msg_id").select(
        "msg_id", "hop_number", "delay_seconds", "public_before", "next_from", "delay_label")


@query("routing_flags", "P45 P46 P47 P48 P49 P50 P51", ctes=ROUTE_CTES,
       oracle="SELECT msg_id, rule, hop FROM flags")
def routing_flags(spark, sf):
    return explode_rows(routed(spark, sf), "routing_flags", "msg_id").select("msg_id", "rule", "hop")


@query("routing_signals", "J11 A6 W8", ctes=ROUTE_CTES,
       oracle="SELECT msg_id, indicator, strength, weight FROM route_sig")
def routing_signals(spark, sf):
    d = routed(spark, sf).select("msg_id", routing.routing_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "strength", "weight")
