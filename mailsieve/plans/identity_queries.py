"""Queries over sender identity and header rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import identity as ident
from ..functions.base import among, explode_rows
from ..operators import headers, lookalikes
from . import oracle as o
from .registry import query
from .tables import letters, table, view


# --- domains and addresses -----------------------------------------------------

@query("address_parts", "F1 F2 F3 F4", oracle=f"""
    SELECT msg_id, a AS addr, {o.dom("a")} AS domain, {o.display("from_raw")} AS display_name,
           {o.reg(o.dom("a"))} AS organisation
    FROM (SELECT msg_id, from_raw, {o.addr("from_raw")} AS a FROM letters) z""")
def address_parts(spark, sf):
    d = view(spark, sf, "letters").select("msg_id", "from_raw") \
        .withColumn("addr", ident.address("from_raw"))
    d = d.withColumn("domain", ident.domain_of("addr"))
    return d.select("msg_id", "addr", "domain", ident.display_name("from_raw").alias("display_name"),
                    ident.registrable("domain").alias("organisation"))


_LINK_HOSTS = """SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain FROM pages
    UNION SELECT DISTINCT domain FROM senders UNION SELECT DISTINCT split_part(from_addr, '@', -1) FROM mail_log"""


@query("lookalike_domains", "J1 F11", oracle="SELECT domain, brand FROM look",
       ctes=o.lookalike(_LINK_HOSTS))
def lookalike_domains(spark, sf):
    domains = _hosts(spark, sf)[1].select("domain").distinct()
    return domains.withColumn("brand", ident.lookalike_brand("domain")) \
        .where(F.col("brand").isNotNull())


def _hosts(spark, sf):
    """Pages (url, domain), and the same with senders behind them."""
    pages = table(spark, sf, "pages").select(
        "url", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("domain"))
    none = F.lit(None).cast("string").alias("url")
    log = view(spark, sf, "mail_log").select(none, F.substring_index("from_addr", "@", -1).alias("domain"))
    return pages, pages.union(view(spark, sf, "senders").select(none, "domain")).union(log)


@query("lookalike_catalogue", "J1 X2", ctes={
    "page_hosts": "SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain FROM pages",
    "brand_rows": "SELECT brand, min(pos) AS pos FROM (SELECT * FROM (VALUES "
        + ", ".join(f"('{b}', {i})" for i, b in enumerate(fv.BRANDS)) + """) AS f(brand, pos)
        UNION ALL SELECT split_part(domain, '.', 1), 1000 FROM page_hosts) z WHERE brand <> '' GROUP BY brand""",
    "parts": o.lookalike(_LINK_HOSTS)["look_parts"],
    "hits": f"""
      SELECT p.domain, b.brand, CASE
          WHEN p.label <> b.brand AND (p.folded = b.brand OR (length(b.brand) BETWEEN 5 AND 63
              AND (levenshtein(p.label, b.brand) BETWEEN 1 AND 2 OR levenshtein(p.folded, b.brand) BETWEEN 1 AND 2))) THEN b.pos
          WHEN length(b.brand) >= 6 AND b.brand <> 'square' AND (list_contains(p.words, b.brand)
              OR list_contains(list_transform(p.words, lambda w: {o.fold("w")}), b.brand)) THEN 10000 + b.pos END AS place
      FROM parts p CROSS JOIN brand_rows b
      WHERE p.org NOT IN ({o.quoted(fv.BRAND_OWNED_DOMAINS)})
        AND split_part(p.org, '.', 1) NOT IN (SELECT brand FROM brand_rows)"""}, oracle="""
    SELECT z.url, z.domain, f.imitated FROM (
      SELECT url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain FROM pages
      UNION ALL SELECT NULL, domain FROM senders UNION ALL SELECT NULL, split_part(from_addr, '@', -1) FROM mail_log) z
    LEFT JOIN (SELECT domain, arg_min(brand, (place, brand)) AS imitated FROM hits WHERE place IS NOT NULL GROUP BY domain) f
      ON f.domain = z.domain""")
def lookalike_catalogue(spark, sf):
    """Every crawled page and sender against brands as data: the fixed list, and behind it the leading label of every
    host that was crawled."""
    pages, hosts = _hosts(spark, sf)
    fixed = spark.createDataFrame([(b, i) for i, b in enumerate(fv.BRANDS)], "brand string, pos int")
    crawled = pages.select(F.substring_index("domain", ".", 1).alias("brand"), F.lit(1000).alias("pos")).distinct()
    owned = spark.createDataFrame([(d,) for d in fv.BRAND_OWNED_DOMAINS], "domain string")
    return lookalikes.lookalikes(hosts, fixed.union(crawled), owned)


@query("host_membership", "J3 F6 F12", oracle=f"""
    SELECT msg_id, domain, {o.plausible("domain")} AS plausible,
           {o.reg("domain")} IN ({o.quoted(fv.FREE_MAIL_DOMAINS)}) AS free_mail,
           {o.platform("domain")} AS platform,
           {o.reg("domain")} IN ({o.quoted(fv.BRAND_OWNED_DOMAINS)}) AS brand_owned,
           {o.reg("domain")} IN ({o.quoted(fv.TRUSTED_SENDER_DOMAINS)}) AS trusted,
           CASE WHEN contains(domain, 'xn--') THEN concat('punycode:', domain)
                WHEN regexp_matches(domain, '[^\\x00-\\x7F]') THEN concat('unicode:', domain) END AS idn
    FROM (SELECT msg_id, {o.dom(o.addr("reply_to_raw"))} AS domain FROM letters
          UNION ALL SELECT msg_id, {o.dom(o.addr("from_raw"))} FROM letters) z
    WHERE domain IS NOT NULL""")
def host_membership(spark, sf):
    d = view(spark, sf, "letters").select("msg_id", F.explode(F.array("reply_to_raw", "from_raw"))
                                          .alias("header"))
    d = d.select("msg_id", ident.domain_of(ident.address("header")).alias("domain")) \
        .where("domain IS NOT NULL")
    org = ident.registrable("domain")
    return d.select(
        "msg_id", "domain", ident.plausible_host("domain").alias("plausible"),
        ident.is_free_mail("domain").alias("free_mail"),
        ident.is_mail_platform("domain").alias("platform"),
        among(org, fv.BRAND_OWNED_DOMAINS).alias("brand_owned"),
        among(org, fv.TRUSTED_SENDER_DOMAINS).alias("trusted"),
        ident.idn_reason("domain").alias("idn"))


_PAIRS = f"""
    SELECT msg_id, {o.dom(o.addr("from_raw"))} AS a, role, {o.dom(o.addr("raw"))} AS b FROM (
      SELECT msg_id, from_raw, 'reply_to' AS role, reply_to_raw AS raw FROM letters
      UNION ALL SELECT msg_id, from_raw, 'sender', sender_raw FROM letters
      UNION ALL SELECT msg_id, from_raw, 'return_path', return_path_raw FROM letters) z"""


@query("sender_relationships", "F7 F9 F10", oracle=f"""
    SELECT p.msg_id, p.role, p.a AS from_domain, p.b AS other_domain,
           {o.relation("p.a", "p.b", "l.brand")} AS relation,
           coalesce({o.same_org("p.a", "p.b")}, FALSE) AS same_org,
           coalesce(p.a = p.b OR {o.reg("p.a")} = {o.reg("p.b")}, FALSE) AS aligned_relaxed,
           coalesce(p.a = p.b, FALSE) AS aligned_strict
    FROM pairs p LEFT JOIN look l ON l.domain = p.b""",
       ctes={"pairs": _PAIRS, **o.lookalike("SELECT DISTINCT b AS domain FROM pairs WHERE b IS NOT NULL")})
def sender_relationships(spark, sf):
    d = view(spark, sf, "letters").select("msg_id", "from_raw", F.expr(
        "stack(3, 'reply_to', reply_to_raw, 'sender', sender_raw, 'return_path', return_path_raw)"
        " AS (role, raw)"))
    d = d.select("msg_id", "role", ident.domain_of(ident.address("from_raw")).alias("from_domain"),
                 ident.domain_of(ident.address("raw")).alias("other_domain"))
    return d.select(
        "msg_id", "role", "from_domain", "other_domain",
        ident.relationship("from_domain", "other_domain").alias("relation"),
        ident.same_organisation("from_domain", "other_domain").alias("same_org"),
        ident.aligned("other_domain", "from_domain").alias("aligned_relaxed"),
        ident.aligned("other_domain", "from_domain", F.lit(True)).alias("aligned_strict"))


# --- header rules --------------------------------------------------------------

IDENTITY_CTES = {
    "who": f"""
        SELECT *, {o.dom("from_addr")} AS from_domain, {o.dom("sender_addr")} AS sender_domain,
               {o.dom("reply_addr")} AS reply_domain, {o.dom("bounce_addr")} AS bounce_domain
        FROM (SELECT *, {o.addr("from_raw")} AS from_addr, {o.addr("sender_raw")} AS sender_addr,
                     {o.addr("reply_to_raw")} AS reply_addr, {o.addr("return_path_raw")} AS bounce_addr,
                     {o.display("from_raw")} AS shown FROM letters) z""",
    **o.lookalike("""SELECT DISTINCT unnest([from_domain, sender_domain, reply_domain, bounce_domain]) AS domain
                     FROM who"""),
    "related": f"""
        SELECT w.*, lf.brand AS from_brand,
               {o.relation("w.from_domain", "w.sender_domain", "ls.brand")} AS sender_rel,
               {o.relation("w.from_domain", "w.reply_domain", "lr.brand")} AS reply_rel,
               {o.relation("w.from_domain", "w.bounce_domain", "lb.brand")} AS bounce_rel
        FROM who w LEFT JOIN look lf ON lf.domain = w.from_domain
        LEFT JOIN look ls ON ls.domain = w.sender_domain
        LEFT JOIN look lr ON lr.domain = w.reply_domain
        LEFT JOIN look lb ON lb.domain = w.bounce_domain""",
    "brand_claims": f"""
        SELECT r.msg_id, arg_min(b.brand, b.ord) AS brand
        FROM related r JOIN brand_list b ON length(b.brand) >= 6 AND b.brand <> 'square'
          AND list_contains(regexp_split_to_array(lower(r.shown), '[^\\p{{L}}\\p{{N}}_]+'), b.brand)
          AND NOT contains(r.from_domain, b.brand)
        WHERE {o.reg("r.from_domain")} NOT IN ({o.quoted(fv.BRAND_OWNED_DOMAINS)}) GROUP BY r.msg_id""",
}

# title, level, condition over ``related`` joined to brand_claims and header facts
_RULES = [
    ("Display Name Email Spoofing", "High", "decoy"),
    ("Display Name Brand Impersonation", "High", "NOT decoy AND claim IS NOT NULL"),
    ("From vs. Sender Delegate", "Low",
     f"from_addr <> sender_addr AND (sender_rel IN ('same_org','trusted_esp') OR {o.platform('sender_domain')})"),
    ("From vs. Sender Mismatch", "High",
     f"from_addr <> sender_addr AND sender_rel = 'suspicious' AND NOT {o.platform('sender_domain')}"),
    ("From vs. Sender Domain Difference", "Low",
     f"from_addr <> sender_addr AND sender_rel = 'unrelated' AND NOT {o.platform('sender_domain')}"),
    ("Suspicious Reply-To Destination", "High",
     "from_addr <> reply_addr AND reply_rel = 'suspicious'"),
    ("From vs. Reply-To Domain Difference", "Medium",
     "from_addr <> reply_addr AND reply_rel = 'unrelated'"),
    ("From vs. Return-Path ESP Bounce Domain", "Low",
     f"from_domain <> bounce_domain AND (bounce_rel IN ('same_org','trusted_esp') OR {o.platform('bounce_domain')})"),
    ("From vs. Return-Path Domain Mismatch", "High",
     f"from_domain <> bounce_domain AND bounce_rel = 'suspicious' AND NOT {o.platform('bounce_domain')}"),
    ("From vs. Return-Path Domain Difference", "Low",
     f"from_domain <> bounce_domain AND bounce_rel = 'unrelated' AND NOT {o.platform('bounce_domain')}"),
    ("Missing Message-ID Header", "Medium", "trim(message_id) = ''"),
    ("Suspicious Message-ID Format", "Medium",
     """message_id <> '' AND (NOT (starts_with(message_id, '<') AND ends_with(message_id, '>'))
        OR NOT contains(message_id, '@')
        OR regexp_matches(trim(message_id, '<>'), '@(localhost|localdomain|127\\.0\\.0\\.1|192\\.168\\..*|[^.]*)$'))"""),
    ("Duplicate Message-ID Headers Detected", "High", "n_message_id > 1"),
    ("Suspicious X-Headers Detected", "Medium", "n_odd > 0"),
    ("Multiple Authentication-Results Headers", "Medium", "n_ar > 2"),
    ("Authentication-Results Missing Authserv-ID", "Medium", "ar_status = 'anonymous'"),
    ("Unattributed Authentication-Results Header", "Medium", "ar_status = 'unattributed'"),
    ("Header Structural Anomalies Detected", "High",
     "n_from > 1 OR n_subject > 1 OR n_date > 1 OR (date <> '' AND NOT dated)"),
    ("Missing Mandatory Email Headers", "Medium",
     "date = '' OR from_raw = '' OR subject = '' OR to_raw = ''"),
    ("Raw IP Address Sender Domain", "High", "ip_sender"),
    ("High-Risk Top-Level Domain (TLD)", "Medium",
     f"NOT ip_sender AND split_part(from_domain, '.', -1) IN ({o.quoted(fv.HIGH_RISK_TLDS)})"),
    ("Lookalike Brand Domain (Typosquatting)", "High", "NOT ip_sender AND from_brand IS NOT NULL"),
]

_MAILERS = " OR ".join(f"contains(lower(value), '{m}')" for m in fv.SUSPICIOUS_MAILERS)

HEADER_CTES = {
    **IDENTITY_CTES,
    "header_counts": f"""
        SELECT msg_id, count(*) FILTER (lower(name) = 'message-id') AS n_message_id,
               count(*) FILTER (lower(name) = 'from') AS n_from,
               count(*) FILTER (lower(name) = 'subject') AS n_subject,
               count(*) FILTER (lower(name) = 'date') AS n_date,
               count(*) FILTER (lower(name) IN ('x-php-originating-script','x-php-script')
                 OR (lower(name) IN ('x-spam-flag','x-spam-status') AND contains(lower(value), 'yes'))
                 OR (lower(name) IN ('x-mailer','user-agent','x-user-agent') AND ({_MAILERS}))) AS n_odd
        FROM header_rows GROUP BY msg_id""",
    "hosts_by": """
        SELECT DISTINCT msg_id, trim(lower(regexp_extract(raw, '(?i)\\bby\\s+([A-Za-z0-9._-]+)', 1)), '.') AS host
        FROM received WHERE regexp_matches(raw, '(?i)\\bby\\s+[A-Za-z0-9._-]+')""",
    "ar_ids": """
        SELECT msg_id, pos, raw, trim(lower(regexp_extract(trim(raw), '^\\s*([A-Za-z0-9_.:\\[\\]-]+)\\s*;', 1)), '.') AS who
        FROM auth_results""",
    "ar_match": f"""
        SELECT a.msg_id, a.pos, count(h.host) AS hosts,
               coalesce(bool_or(a.who = h.host OR ends_with(h.host, '.' || a.who) OR ends_with(a.who, '.' || h.host)
                       OR {o.reg("a.who")} = {o.reg("h.host")}), FALSE) AS ok
        FROM ar_ids a LEFT JOIN hosts_by h ON h.msg_id = a.msg_id GROUP BY a.msg_id, a.pos""",
    "ar_status": """
        SELECT msg_id, arg_min(status, pos) FILTER (status <> 'ok') AS ar_status FROM (
          SELECT a.msg_id, a.pos, CASE WHEN NOT contains(a.who, '.') THEN 'anonymous'
                   WHEN m.hosts = 0 THEN 'stop' WHEN NOT m.ok THEN 'unattributed' ELSE 'ok' END AS status
          FROM ar_ids a JOIN ar_match m ON m.msg_id = a.msg_id AND m.pos = a.pos
          WHERE contains(lower(a.raw), 'pass')) z GROUP BY msg_id""",
    "facts": """
        SELECT r.*, c.* EXCLUDE (msg_id), s.ar_status, b.brand AS claim,
               coalesce(n.n_ar, 0) AS n_ar,
               coalesce(regexp_full_match(r.from_domain, '\\d{1,3}(\\.\\d{1,3}){3}'), FALSE) AS ip_sender,
               regexp_matches(r.date, '^(\\w{3}, )?\\d{1,2} \\w{3} \\d{4} \\d{1,2}:\\d{2}') AS dated,
               regexp_matches(r.shown, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') AND
                 lower(regexp_extract(r.shown, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')) <> r.from_addr AS decoy
        FROM related r JOIN header_counts c ON c.msg_id = r.msg_id
        LEFT JOIN ar_status s ON s.msg_id = r.msg_id LEFT JOIN brand_claims b ON b.msg_id = r.msg_id
        LEFT JOIN (SELECT msg_id, count(*) AS n_ar FROM auth_results GROUP BY msg_id) n ON n.msg_id = r.msg_id""",
    "header_hits": "\nUNION ALL ".join(
        f"SELECT msg_id, {i} AS rule, '{t}' AS title, '{lvl}' AS risk_level FROM facts WHERE ({c})"
        for i, (t, lvl, c) in enumerate(_RULES)),
}


def _header_rows(spark, sf):
    d = headers.header_findings(headers.with_identity(letters(spark, sf, attachments=False)))
    return explode_rows(d, "header_findings", "msg_id")


def _rule_group(name, covers, first, last):
    titles = [t for t, _, _ in _RULES[first:last]]

    @query(name, covers, oracle=f"""SELECT msg_id, title, risk_level FROM header_hits
                                    WHERE title IN ({o.quoted(titles)})""", ctes=HEADER_CTES)
    def run(spark, sf):
        return _header_rows(spark, sf).where(F.col("title").isin(titles)) \
            .select("msg_id", "title", "risk_level")
    return run


_rule_group("display_name_rules", "P1 P2 J2", 0, 2)
_rule_group("sender_difference_rules", "P3", 2, 5)
_rule_group("reply_to_rules", "P4", 5, 7)
_rule_group("return_path_rules", "P5", 7, 10)
_rule_group("message_id_rules", "P6 P7 P8", 10, 13)
_rule_group("x_header_rules", "P9", 13, 14)
_rule_group("auth_header_rules", "P10 P11 P12 J6", 14, 17)
_rule_group("header_structure_rules", "P13 P14", 17, 19)
_rule_group("sender_domain_rules", "P15 P16 P17", 19, 22)

_WEIGHT = """CASE WHEN contains(lower(title), 'missing') THEN 8 WHEN risk_level = 'High' THEN 25
  WHEN risk_level = 'Low' THEN 5 WHEN contains(lower(title), 'high-risk top-level') THEN
    CASE WHEN regexp_matches(from_domain, '\\.(tk|ml|ga|cf|gq)') THEN 20 ELSE 10 END
  WHEN contains(lower(title), 'reply-to') OR contains(lower(title), 'return-path') THEN 8 ELSE 10 END"""

HEADER_SIGNALS = f"""
    SELECT h.msg_id, 400 + h.rule AS seq, concat('Header Forensics: ', h.title) AS indicator,
           CASE WHEN {_WEIGHT} >= 20 THEN 'strong' ELSE 'weak' END AS strength, {_WEIGHT} AS weight
    FROM header_hits h JOIN facts f ON f.msg_id = h.msg_id"""


@query("header_signal_weights", "F26", oracle=f"""
    SELECT msg_id, indicator, strength, weight, {o.severity("weight")} AS severity
    FROM ({HEADER_SIGNALS}) z""", ctes=HEADER_CTES)
def header_signal_weights(spark, sf):
    d = headers.header_findings(headers.with_identity(letters(spark, sf, attachments=False)))
    return explode_rows(d.withColumn("s", headers.header_signals()), "s", "msg_id") \
        .select("msg_id", "indicator", "strength", "weight", "severity")


_STANDALONE = " UNION ALL ".join([
    "SELECT msg_id, 'Display Name Impersonation' AS indicator, 25 AS weight FROM facts WHERE claim IS NOT NULL",
    "SELECT msg_id, 'Lookalike / Typosquatted Domain', 25 FROM facts WHERE from_brand IS NOT NULL",
    f"""SELECT msg_id, 'High-Risk Top-Level Domain (TLD)',
          CASE WHEN split_part(from_domain, '.', -1) IN ({o.quoted(fv.CORE_ABUSE_TLDS)}) THEN 20 ELSE 10 END
        FROM facts WHERE split_part(from_domain, '.', -1) IN ({o.quoted(fv.HIGH_RISK_TLDS)})""",
    """SELECT msg_id, 'Punycode / Unicode Domain', 20 FROM facts
       WHERE contains(from_domain, 'xn--') OR regexp_matches(from_domain, '[^\\x00-\\x7F]')""",
    """SELECT msg_id, CASE WHEN bad THEN 'Suspicious Reply / Sender Diversion'
              ELSE 'Different Sender Header Domains' END, CASE WHEN bad THEN 25 ELSE 8 END
       FROM (SELECT msg_id,
          bool_or(rel = 'suspicious') AS bad FROM (
            SELECT msg_id, from_domain AS a, sender_domain AS b, sender_rel AS rel FROM facts
            UNION ALL SELECT msg_id, from_domain, reply_domain, reply_rel FROM facts
            UNION ALL SELECT msg_id, from_domain, bounce_domain, bounce_rel FROM facts) y
          WHERE b IS NOT NULL AND a <> b AND rel IN ('suspicious', 'unrelated') GROUP BY msg_id) z"""])


@query("standalone_identity_signals", "P54 P55", oracle=_STANDALONE, ctes=HEADER_CTES)
def standalone_identity_signals(spark, sf):
    d = headers.with_identity(letters(spark, sf, attachments=False))
    return explode_rows(d.withColumn("s", headers.standalone_identity_signals()), "s", "msg_id") \
        .select("msg_id", "indicator", "weight")
