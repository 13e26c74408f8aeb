"""Queries that look messages up in snapshots and in past correspondence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.base import explode_rows
from ..operators import activity, auth, baseline, dnsauth, headers, networks, reputation
from . import oracle as o
from .body_queries import LINK_CTES
from .message_queries import AUTH_CTES, claimed_auth, mail_messages, scored_mail
from .registry import query
from .tables import letters, table, view
from .views import AS_OF


# --- sender baseline -----------------------------------------------------------

def baseline_sql(limit: int, minimum: int = fv.BASELINE_MINIMUM) -> dict[str, str]:
    return {
        "numbered": f"""SELECT id, user_id, from_addr, {o.reg("split_part(from_addr, '@', -1)")} AS org,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM mail_log""",
        "history": f"""SELECT id, user_id, least(rn - 1, {limit}) AS prior_messages,
            count(*) OVER (PARTITION BY user_id, from_addr ORDER BY rn RANGE BETWEEN {limit} PRECEDING AND 1 PRECEDING) AS address_count,
            count(*) OVER (PARTITION BY user_id, org ORDER BY rn RANGE BETWEEN {limit} PRECEDING AND 1 PRECEDING) AS domain_count
            FROM numbered""",
        "contacts": f"""SELECT *, prior_messages >= {minimum} AS available,
            prior_messages >= {minimum} AND address_count = 0 AS first_time_address,
            prior_messages >= {minimum} AND domain_count = 0 AS first_time_domain FROM history""",
    }


@query("sender_baseline", "W6 J5 A8", ctes=baseline_sql(500), oracle="SELECT * FROM contacts")
def sender_baseline(spark, sf):
    return baseline.sender_baseline(view(spark, sf, "mail_log"))


@query("sender_baseline_short", "W6", ctes=baseline_sql(12), oracle="SELECT * FROM contacts")
def sender_baseline_short(spark, sf):
    return baseline.sender_baseline(view(spark, sf, "mail_log"), limit=12)


_CONTACT = {
    **baseline_sql(500), "texts": "SELECT msg_id, body_plain AS body, subject FROM mail",
    "phrase_sig": o.phrase_signals("texts"),
    "context": f"""SELECT msg_id, string_agg(DISTINCT indicator, ', ' ORDER BY indicator) AS names FROM phrase_sig
                   WHERE indicator IN ({o.quoted(fv.PAYMENT_INDICATORS)}) GROUP BY msg_id""",
}


@query("first_contact_signals", "F39 U5", ctes=_CONTACT, oracle="""
    SELECT c.id AS msg_id,
      CASE WHEN first_time_domain AND x.names IS NOT NULL THEN 'Sender History: First Contact Requesting Payment or Credentials'
           WHEN first_time_domain THEN 'Sender History: First Contact from Unfamiliar Domain'
           ELSE 'Sender History: First Contact from New Address at a Known Domain' END AS indicator,
      CASE WHEN first_time_domain AND x.names IS NOT NULL THEN 15 WHEN first_time_domain THEN 5 ELSE 3 END AS weight,
      concat('prior=', prior_messages, CASE WHEN first_time_domain AND x.names IS NOT NULL
             THEN concat(' with ', x.names) ELSE '' END) AS evidence
    FROM contacts c JOIN mail m ON m.msg_id = c.id LEFT JOIN context x ON x.msg_id = c.id
    WHERE first_time_domain OR first_time_address""")
def first_contact_signals(spark, sf):
    from ..operators import content
    fired = content.with_match_text(mail_messages(spark, sf)) \
        .select("msg_id", content.content_signals().alias("signals"))
    facts = baseline.sender_baseline(view(spark, sf, "mail_log")).withColumnRenamed("id", "msg_id")
    d = fired.join(facts, "msg_id").select("msg_id", baseline.first_contact_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "weight", "evidence")


# --- registration age ----------------------------------------------------------

_DATE = """coalesce(try_strptime(created, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(created, '%Y-%m-%d %H:%M:%S'),
  try_strptime(created, '%Y-%m-%d'), try_strptime(created, '%d-%b-%Y'), try_strptime(created, '%d.%m.%Y'),
  try_strptime(created, '%Y.%m.%d'), try_strptime(created, '%Y/%m/%d'))"""
AGE_CTES = {
    **{k: v.replace("FROM linked", "FROM aged_mail") for k, v in LINK_CTES.items()
       if k in ("found", "cut", "firsts", "hosts")},
    "valid": f"""SELECT domain, min({_DATE}) AS created, max(registrar) AS registrar FROM whois
                 WHERE CAST(expires AS TIMESTAMP) > TIMESTAMP '{AS_OF}' GROUP BY domain""",
    "mentioned": f"""
        SELECT msg_id, -1 AS place, {o.reg(o.dom(o.addr("from_raw")))} AS domain, 'sender' AS origin FROM letters
        WHERE {o.dom(o.addr("from_raw"))} IS NOT NULL
        UNION ALL SELECT msg_id, place, {o.reg("host")}, 'link' FROM hosts WHERE host <> ''""",
    "ordered": f"""
        SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY place) AS ord, sum(CASE WHEN exempt THEN 0 ELSE 1 END)
            OVER (PARTITION BY msg_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent
        FROM (SELECT msg_id, domain, min(place) AS place, arg_min(origin, place) AS origin,
                     domain IN ({o.quoted(fv.BRAND_OWNED_DOMAINS)}) OR split_part(domain, '.', 1) IN ({o.quoted(fv.BRANDS)}) AS exempt
              FROM mentioned WHERE contains(domain, '.') GROUP BY msg_id, domain) z""",
    "aged": """
        SELECT d.msg_id, d.domain, d.origin, d.ord, v.created, v.registrar,
               CASE WHEN NOT exempt THEN date_diff('day', CAST(v.created AS DATE), DATE '2026-03-05')
                 - CASE WHEN v.created::TIME > TIME '00:00:00' THEN 1 ELSE 0 END END AS days, d.exempt
        FROM ordered d LEFT JOIN valid v ON v.domain = d.domain AND NOT d.exempt
        WHERE d.exempt OR coalesce(d.spent, 0) < 4""",
    "classed": """
        SELECT *, CASE WHEN exempt THEN 'exempt' WHEN days IS NULL OR days < 0 THEN 'unknown' WHEN days < 30
            THEN 'newly_registered' WHEN days < 90 THEN 'young' ELSE 'established' END AS classification FROM aged""",
    "age_rules": "SELECT * FROM (VALUES " + ", ".join(
        f"('{a}', '{c}', {w}, '{n}')" for (a, c), (w, n) in fv.DOMAIN_AGE_WEIGHTS.items())
    + ") AS r(origin, classification, weight, indicator)",
    "age_sig": """
        SELECT msg_id, 600 + rn AS seq, concat('Domain Reputation: ', indicator) AS indicator, 'weak' AS strength, weight
        FROM (SELECT c.msg_id, r.indicator, r.weight,
                     row_number() OVER (PARTITION BY c.msg_id ORDER BY r.weight DESC, c.ord) AS rn
              FROM classed c JOIN age_rules r ON r.origin = c.origin AND r.classification = c.classification) z
        WHERE rn <= 2""",
}
_AGED = {"aged_mail": "SELECT msg_id, body_html, body_plain FROM letters", **AGE_CTES}


def aged_domains(spark, sf):
    from ..operators import links
    d = links.with_links(headers.with_identity(letters(spark, sf, attachments=False)))
    return reputation.domain_ages(reputation.asked_domains(d), view(spark, sf, "whois"), AS_OF)


@query("domain_registration_age", "J4 A17 F28 F29 W12 S15 F45", ctes=_AGED, oracle="""
    SELECT msg_id, domain, origin, classification, CASE WHEN days >= 0 THEN days END AS age_days,
           CAST(created AS DATE) AS created,
           CASE classification WHEN 'newly_registered' THEN 'High' WHEN 'young' THEN 'Medium'
                WHEN 'unknown' THEN 'NONE' ELSE 'Safe' END AS badge,
           CASE classification WHEN 'newly_registered' THEN 'NEWLY REGISTERED' WHEN 'young' THEN 'RECENT'
                WHEN 'established' THEN 'ESTABLISHED' WHEN 'exempt' THEN 'BRAND-OWNED' ELSE 'UNKNOWN' END AS label
    FROM classed""")
def domain_registration_age(spark, sf):
    badge, label = reputation.age_badge(F.col("classification"))
    return aged_domains(spark, sf).select("msg_id", "domain", "origin", "classification", "age_days",
                                          "created", badge.alias("badge"), label.alias("label"))


@query("domain_age_signals", "W7", ctes=_AGED,
       oracle="SELECT msg_id, indicator, strength, weight FROM age_sig")
def domain_age_signals(spark, sf):
    return explode_rows(reputation.age_signals(aged_domains(spark, sf)), "age_signals", "msg_id") \
        .select("msg_id", "indicator", "strength", "weight")


@query("age_at_arrival", "J4 A17 S15", ctes={
    "asked": "SELECT e.event_id, s.domain, e.ts FROM events e JOIN senders s ON s.k = e.user_id % 16",
    "answers": """
      SELECT s.domain, e.ts, max(e.ts + CASE WHEN e.event_type <> 'error' THEN INTERVAL 604800 SECOND ELSE INTERVAL 3600 SECOND END) AS expires,
             min(CASE WHEN e.event_type <> 'error' THEN DATE '2023-12-01' + CAST(floor(e.value) AS INTEGER) END) AS created
      FROM events e JOIN senders s ON s.k = e.user_id % 16 WHERE e.event_type IN ('error', 'signup') GROUP BY ALL""",
    "found": """
      SELECT a.event_id, a.domain, a.ts, CASE WHEN v.expires > a.ts THEN v.created END AS created
      FROM asked a ASOF LEFT JOIN answers v ON v.domain = a.domain AND v.ts <= a.ts""",
    "timed": "SELECT *, CAST(floor((epoch_us(ts) - epoch_us(created::TIMESTAMP)) / 86400e6) AS INTEGER) AS days FROM found"}, oracle="""
    SELECT event_id, domain, created, CASE WHEN days >= 0 THEN days END AS age_days,
           CASE WHEN days IS NULL OR days < 0 THEN 'unknown' WHEN days < 30 THEN 'newly_registered'
                WHEN days < 90 THEN 'young' ELSE 'established' END AS classification
    FROM timed""")
def age_at_arrival(spark, sf):
    """Every event asks for a domain at its time; signups and errors are answers, good and failed."""
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") % 16) \
        .join(F.broadcast(view(spark, sf, "senders").select("k", "domain")), "k")     # a fixed list
    ok = F.col("event_type") != "error"
    answers = e.where(F.col("event_type").isin("error", "signup")).select(
        "domain", ok.alias("ok"), F.col("ts").alias("fetched"), F.lit("").alias("registrar"),
        F.when(ok, F.date_add(F.lit("2023-12-01").cast("date"), F.floor("value").cast("int")).cast("string")).alias("created"))
    asked = e.select(F.col("event_id").alias("msg_id"), F.lit(0).alias("pos"), "domain", F.lit("link").alias("origin"),
                     F.lit(False).alias("exempt"), F.col("ts").alias("created_at"))
    return reputation.domain_ages_then(asked, answers).select(
        F.col("msg_id").alias("event_id"), "domain", "created", "age_days", "classification")


@query("lookup_cache_expiry", "T4 S15", oracle="""
    SELECT event_id, domain, ok, CAST(expires AS TIMESTAMP) AS expires, CAST(expires AS TIMESTAMP) > asked AS usable FROM (
      SELECT e.event_id, s.domain, e.event_type <> 'error' AS ok,
             e.ts + CASE WHEN e.event_type <> 'error' THEN INTERVAL 604800 SECOND ELSE INTERVAL 3600 SECOND END AS expires,
             e.ts + INTERVAL 7200 SECOND AS asked
      FROM events e JOIN senders s ON s.k = e.event_id % 16) z""")
def lookup_cache_expiry(spark, sf):
    e = table(spark, sf, "events").join(F.broadcast(view(spark, sf, "senders").select("k", "domain")),
                                        F.expr("event_id % 16 = k"))
    d = reputation.with_expiry(e.select("event_id", "domain", F.col("ts").alias("fetched"),
                                        (F.col("event_type") != "error").alias("ok")))
    return d.select("event_id", "domain", "ok", "expires",
                    (F.col("expires") > F.expr("fetched + interval 7200 seconds")).alias("usable"))


# --- independent authentication ------------------------------------------------

_RANGE = """(CASE WHEN contains({a}, '/') THEN CAST(split_part({a}, '/', 2) AS INT) ELSE 32 END)"""
_IPNUM = ("(CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 "
          "+ CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT))")


def _num(x):
    return _IPNUM.replace("{x}", x)


def _spf_levels(depth: int = 3) -> dict[str, str]:
    """Verdicts per nesting level; the fixture nests at most three deep."""
    out = {}
    for level in range(depth, -1, -1):
        child = f"spf_{level + 1}"
        inner = "NULL" if level == depth else f"(SELECT c.verdict FROM {child} c WHERE c.name = t.target AND c.ip = t.ip)"
        out[f"tried_{level}"] = f"""
            SELECT t.*, CASE WHEN mech = 'redirect' THEN coalesce({inner}, 'none')
              WHEN mech NOT IN ('all','ip4','a','mx','include','exists','ptr') THEN 'permerror'
              WHEN mech = 'include' AND {inner} = 'permerror' THEN 'permerror'
              WHEN mech = 'include' AND {inner} = 'temperror' THEN 'temperror'
              WHEN hit OR (mech = 'include' AND {inner} = 'pass') THEN verdict END AS out FROM spf_hits t"""
        out[f"spf_{level}"] = f"""
            SELECT p.name, p.ip, CASE WHEN s.state IS NULL THEN 'none' WHEN s.state <> 'ok' THEN s.state ELSE
                coalesce((SELECT arg_min(out, pos) FROM tried_{level} t WHERE t.name = p.name AND t.ip = p.ip AND out IS NOT NULL), 'neutral') END AS verdict
            FROM spf_pairs p LEFT JOIN spf_state s ON s.name = p.name"""
    return out


_ROUTABLE = """NOT (n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647
  OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3405803776 AND 3405804031
  OR n BETWEEN 3758096384 AND 4294967295)"""
DNS_CTES = {
    **AUTH_CTES,
    "ips": f"""
        SELECT msg_id, arg_min(ip, ord) AS ip FROM (
          SELECT msg_id, ord, ip, {_num("ip")} AS n FROM (
            SELECT msg_id, pos AS ord, regexp_extract(raw, '\\[([0-9.]+)\\]', 1) AS ip FROM received
            UNION ALL SELECT msg_id, 1000, trim(value, '[]') FROM header_rows WHERE lower(name) = 'x-originating-ip') a) b
        WHERE {_ROUTABLE} GROUP BY msg_id""",
    "designated": f"""SELECT msg_id, regexp_extract(raw, '{auth.DESIGNATED_IP}', 1) AS ip FROM ar_joined
                      WHERE regexp_matches(raw, '{auth.DESIGNATED_IP}')""",
    "asks": f"""
        SELECT c.msg_id, c.from_domain, coalesce(lower(split_part(c.mailfrom, '@', -1)),
            {o.dom(o.addr("l.return_path_raw"))}, c.from_domain) AS envelope, coalesce(d.ip, i.ip) AS ip
        FROM claims c JOIN letters l ON l.msg_id = c.msg_id LEFT JOIN ips i ON i.msg_id = c.msg_id
        LEFT JOIN designated d ON d.msg_id = c.msg_id""",
    "spf_state": """
        SELECT name, max(value) FILTER (is_spf) AS record, CASE WHEN bool_or(status = 'temporary') THEN 'temperror'
            WHEN count(*) FILTER (is_spf) = 0 THEN 'none' WHEN count(*) FILTER (is_spf) > 1 THEN 'permerror' ELSE 'ok' END AS state
        FROM (SELECT *, status = 'ok' AND starts_with(lower(value), 'v=spf1') AS is_spf FROM dns WHERE rdtype = 'TXT') z GROUP BY name""",
    "terms": """
        SELECT name, pos, term, CASE substr(term, 1, 1) WHEN '-' THEN 'fail' WHEN '~' THEN 'softfail' WHEN '?' THEN 'neutral' ELSE 'pass' END AS verdict,
          CASE WHEN starts_with(term, 'redirect=') THEN 'redirect' ELSE regexp_extract(ltrim(term, '+-~?'), '^([a-z0-9]+)', 1) END AS mech,
          CASE WHEN starts_with(term, 'redirect=') THEN substr(term, 10)
               WHEN contains(term, ':') THEN substr(term, instr(term, ':') + 1) ELSE '' END AS arg,
          TRY_CAST(regexp_extract(term, '^[+~?-]?(a|mx)/(\\d+)$', 2) AS INT) AS bits
        FROM (SELECT name, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (
          SELECT name, string_split(record, ' ')[2:] AS w FROM spf_state WHERE state = 'ok') y) z""",
    "spf_pairs": """
        WITH RECURSIVE reach AS (
          SELECT DISTINCT envelope AS name, ip, 0 AS depth FROM asks WHERE envelope IS NOT NULL AND ip IS NOT NULL
          UNION ALL SELECT t.arg, r.ip, r.depth + 1 FROM reach r JOIN terms t ON t.name = r.name
          WHERE t.mech IN ('include', 'redirect') AND r.depth < 5)
        SELECT DISTINCT name, ip FROM reach""",
    "addresses": """
        SELECT 'a' AS mech, name AS target, value FROM dns WHERE rdtype = 'A' AND status = 'ok'
        UNION ALL SELECT 'exists', name, value FROM dns WHERE rdtype = 'A' AND status = 'ok'
        UNION ALL SELECT 'mx', m.name, a.value FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS rn
            FROM dns WHERE rdtype = 'MX') m JOIN dns a ON a.name = m.value AND a.rdtype = 'A' WHERE rn <= 10""",
    "spf_hits": f"""
        SELECT p.name, p.ip, CASE WHEN t.mech = 'redirect' THEN 1000 ELSE t.pos END AS pos, t.mech, t.verdict,
          CASE WHEN t.mech IN ('a', 'mx') AND t.arg = '' THEN t.name ELSE t.arg END AS target,
          CASE t.mech WHEN 'all' THEN TRUE
            WHEN 'ip4' THEN {_num("p.ip")} // (1 << (32 - {_RANGE.replace("{a}", "t.arg")}))
                          = {_num("split_part(t.arg, '/', 1)")} // (1 << (32 - {_RANGE.replace("{a}", "t.arg")}))
            WHEN 'exists' THEN EXISTS (SELECT 1 FROM addresses x WHERE x.mech = 'exists' AND x.target = t.arg)
            ELSE t.mech IN ('a', 'mx') AND EXISTS (SELECT 1 FROM addresses x WHERE x.mech = t.mech
              AND x.target = CASE WHEN t.arg = '' THEN t.name ELSE t.arg END
              AND {_num("p.ip")} // (1 << (32 - coalesce(t.bits, 32))) = {_num("x.value")} // (1 << (32 - coalesce(t.bits, 32)))) END AS hit
        FROM spf_pairs p JOIN terms t ON t.name = p.name""",
    **_spf_levels(),
    "dkim_up": """
        SELECT msg_id, CASE WHEN bool_or(outcome = 'pass') THEN 'pass' WHEN bool_or(outcome = 'fail') THEN 'fail' ELSE 'temperror' END AS verdict,
          list_sort(list(DISTINCT domain) FILTER (outcome = 'pass')) AS passed, arg_min(domain, idx) AS first_signer
        FROM dkim_results GROUP BY msg_id""",
    "dmarc_found": f"""
        SELECT d.domain, CASE WHEN own.temp THEN TRUE WHEN own.record IS NULL THEN coalesce(org.temp, FALSE) ELSE FALSE END AS failed,
          coalesce(own.record, org.record) AS record, own.record IS NULL AND org.record IS NOT NULL AND {o.reg("d.domain")} <> d.domain AS from_org
        FROM (SELECT DISTINCT from_domain AS domain FROM asks WHERE from_domain IS NOT NULL) d
        LEFT JOIN dmarc_names own ON own.name = d.domain LEFT JOIN dmarc_names org ON org.name = {o.reg("d.domain")}""",
}
DNS_CTES["dmarc_names"] = """
    SELECT substr(name, 8) AS name, min(value) FILTER (starts_with(lower(value), 'v=dmarc1')) AS record,
           bool_or(status = 'temporary') AS temp FROM dns WHERE starts_with(name, '_dmarc.') GROUP BY name"""
DNS_CTES["dmarc_tags"] = """
    SELECT domain, failed, record, CASE WHEN from_org AND regexp_extract(record, 'sp=(\\w+)', 1) <> '' THEN regexp_extract(record, 'sp=(\\w+)', 1)
             ELSE nullif(regexp_extract(record, '; ?p=(\\w+)', 1), '') END AS policy,
           regexp_extract(record, 'aspf=(\\w)', 1) = 's' AS strict_spf, regexp_extract(record, 'adkim=(\\w)', 1) = 's' AS strict_dkim
    FROM dmarc_found"""
DNS_CTES = {k: DNS_CTES[k] for k in [*[k for k in DNS_CTES if k not in ("dmarc_found", "dmarc_names", "dmarc_tags")],
                                     "dmarc_names", "dmarc_found", "dmarc_tags"]}


def _asked(spark, sf):
    d = claimed_auth(spark, sf)
    originating = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "x-originating-ip"),
                              lambda h: h["value"])
    return d.select("msg_id", F.lower(auth.envelope_domain()).alias("envelope"), F.coalesce(
        "designated_ip", dnsauth.sending_ip("received_chain", originating)).alias("ip"))


@query("sending_addresses", "F34 F41", ctes=DNS_CTES, oracle="SELECT msg_id, envelope, ip FROM asks")
def sending_addresses(spark, sf):
    return _asked(spark, sf)


@query("spf_evaluation", "J7 J8 J9 F32 F33 S16", ctes=DNS_CTES, oracle="""
    SELECT DISTINCT a.envelope AS domain, a.ip, s.verdict AS spf
    FROM asks a JOIN spf_0 s ON s.name = a.envelope AND s.ip = a.ip""")
def spf_evaluation(spark, sf):
    asked = _asked(spark, sf).where("envelope is not null and ip is not null") \
        .select(F.col("envelope").alias("domain"), "ip").distinct()
    return dnsauth.evaluate_spf(asked, view(spark, sf, "dns")).select("domain", "ip", "spf")


_EVENT_IP = """CASE WHEN event_id % 5 = 0
    THEN '2001:db8:' || lower(to_hex(event_id % 7)) || '::' || lower(to_hex(1 + event_id % 60000))
    ELSE (20 + event_id % 40) || '.' || (user_id % 200) || '.' || (event_id % 251) || '.' || (event_id % 249) END"""
_BITS32 = "CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 " \
          "+ CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT)"


@query("event_networks", "J7", ctes={
    "asking": f"SELECT event_id, {_EVENT_IP} AS ip FROM events",
    "nets": """
      SELECT s_suppkey AS owner, (20 + s_suppkey % 40) || '.' || (s_suppkey % 200) || '.' || (s_suppkey % 251) || '.0/' || (6 + s_suppkey % 19) AS network,
             6 + s_suppkey % 19 AS len FROM supplier
      UNION ALL SELECT s_suppkey, '2001:db8:' || (s_suppkey % 7) || '::/' || (s_suppkey % 9 + 40), s_suppkey % 9 + 40 FROM supplier""",
    "held": f"""
      SELECT a.event_id, n.network, n.owner, n.len FROM asking a JOIN nets n ON NOT contains(a.ip, ':') AND NOT contains(n.network, ':')
        AND ({_BITS32.format(x="a.ip")}) // (1::BIGINT << (32 - n.len)) = ({_BITS32.format(x="split_part(n.network, '/', 1)")}) // (1::BIGINT << (32 - n.len))
      UNION ALL
      SELECT a.event_id, n.network, n.owner, n.len FROM asking a JOIN nets n ON contains(a.ip, ':') AND contains(n.network, ':')
        AND CAST(split_part(a.ip, ':', 3) AS INTEGER) // (1 << (48 - n.len)) = CAST(split_part(n.network, ':', 3) AS INTEGER) // (1 << (48 - n.len))""",
    "longest": """
      SELECT event_id, network, owner FROM held
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY len DESC, network, owner) = 1"""}, oracle="""
    SELECT a.event_id, a.ip, f.network, f.owner FROM asking a LEFT JOIN longest f ON f.event_id = a.event_id""")
def event_networks(spark, sf):
    """Addresses of all events against the networks of all suppliers, IPv4 and IPv6, longest first."""
    key, event = F.col("s_suppkey"), F.col("event_id")
    text = lambda c: c.cast("string")
    v4 = F.concat_ws(".", text(20 + key % 40), text(key % 200), text(key % 251), F.concat(F.lit("0/"), text(6 + key % 19)))
    v6 = F.concat(F.lit("2001:db8:"), text(key % 7), F.lit("::/"), text(key % 9 + 40))
    suppliers = table(spark, sf, "supplier")
    nets = suppliers.select(v4.alias("network"), key.alias("owner")).unionByName(
        suppliers.select(v6.alias("network"), key.alias("owner"))).groupBy("network").agg(F.min("owner").alias("owner"))
    rows = table(spark, sf, "events").select("event_id", F.when(event % 5 == 0, F.lower(F.concat(
        F.lit("2001:db8:"), F.hex(event % 7), F.lit("::"), F.hex(1 + event % 60000)))).otherwise(F.concat_ws(
            ".", text(20 + event % 40), text(F.col("user_id") % 200), text(event % 251), text(event % 249))).alias("ip"))
    return networks.match_networks(rows, nets)


@query("dkim_rollup", "A18", ctes=DNS_CTES, oracle="""
    SELECT msg_id, verdict AS dkim_checked, array_to_string(coalesce(passed, []), ',') AS passed_domains FROM dkim_up""")
def dkim_rollup(spark, sf):
    return dnsauth.dkim_rollup(view(spark, sf, "dkim_results")).select(
        "msg_id", "dkim_checked", F.array_join("passed_domains", ",").alias("passed_domains"))


@query("dkim_signature_tags", "F35", oracle="""
    SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY pos) - 1 AS INT) AS idx,
           rtrim(lower(regexp_extract(value, '(^|;)\\s*d\\s*=\\s*([^;\\s]+)', 2)), '.') AS domain,
           regexp_extract(value, '(^|;)\\s*s\\s*=\\s*([^;\\s]+)', 2) AS selector
    FROM header_rows WHERE name = 'DKIM-Signature'""")
def dkim_signature_tags(spark, sf):
    return dnsauth.signature_tags(letters(spark, sf, attachments=False))


@query("dmarc_policies", "J10 F30", ctes=DNS_CTES, oracle="""
    SELECT domain, failed, record, policy, coalesce(strict_spf, FALSE) AS strict_spf, coalesce(strict_dkim, FALSE) AS strict_dkim FROM dmarc_tags""")
def dmarc_policies(spark, sf):
    d = headers.with_identity(letters(spark, sf, attachments=False)) \
        .select(F.col("from_domain").alias("domain")).where("domain is not null").distinct()
    return dnsauth.dmarc_lookup(d, view(spark, sf, "dns")).select(
        "domain", F.col("dmarc_failed").alias("failed"), F.col("dmarc_record").alias("record"),
        "policy", "strict_spf", "strict_dkim")


def _merge_sql(mech, h, i, known, crypto=None):
    note = f"concat('verification mismatch: header {mech}=', {h}, ' independent ', {i})"
    held = f"attributed AND {h} IN ({o.quoted(auth.DEFINITIVE)})"
    broken = f"WHEN {crypto} AND {i} = 'fail' THEN {{b}} " if crypto else ""

    def case(b, k, conf, clear, keep, un):
        return (f"CASE WHEN NOT coalesce({known}, FALSE) THEN {k} " + broken.replace("{b}", b)
                + f"WHEN {held} AND {h} = {i} THEN {conf} WHEN {held} AND {i} = 'pass' AND {h} IN ('fail', 'softfail') THEN {clear} "
                f"WHEN {held} THEN {keep} ELSE {un} END")
    return (case(i, h, i, i, h, i),
            case("'live-verified'", "'header-derived'", "'live-confirmed'", "'live-verified'",
                 "'header-authoritative'", "'live-verified'"),
            case(f"CASE WHEN {h} = 'pass' THEN {note} END", "NULL", "NULL", "NULL", note,
                 f"CASE WHEN {h} = 'pass' AND {i} IN ('fail', 'softfail') THEN {note} END"))


_sv, _sp, _sn = _merge_sql("spf", "spf", "spf_i", "spf_i IN ('pass','fail','softfail','neutral','none','permerror')")
_kv, _kp, _kn = _merge_sql("dkim", "dkim", "dkim_i", "dkim_i IN ('pass','fail','none')", "signed")
_mv, _mp, _mn = _merge_sql("dmarc", "dmarc", "dmarc_i", "dmarc_i IN ('pass','fail','none','permerror')")
VERIFIED_CTES = {
    **DNS_CTES,
    "hosts_by": """SELECT DISTINCT msg_id, trim(lower(regexp_extract(raw, '(?i)\\bby\\s+([A-Za-z0-9._-]+)', 1)), '.') AS host FROM received""",
    "attrib": f"""SELECT DISTINCT i.msg_id FROM (SELECT msg_id, trim(lower(regexp_extract(trim(raw), '^\\s*([A-Za-z0-9_.:\\[\\]-]+)\\s*;', 1)), '.') AS who
          FROM auth_results) i JOIN hosts_by b ON b.msg_id = i.msg_id AND contains(i.who, '.') AND (i.who = b.host
          OR ends_with(b.host, '.' || i.who) OR ends_with(i.who, '.' || b.host) OR {o.reg("i.who")} = {o.reg("b.host")})""",
    "inputs": """
        SELECT c.msg_id, c.from_domain, c.spf, c.dkim, c.dmarc, a.envelope, a.ip, s.verdict AS spf_i,
          coalesce(k.verdict, CASE WHEN sg.msg_id IS NULL THEN 'none' END) AS dkim_i,
          k.first_signer IS NOT NULL OR sg.msg_id IS NOT NULL AS signed,
          CASE WHEN len(k.passed) > 0 THEN k.passed WHEN k.first_signer IS NOT NULL THEN [k.first_signer] ELSE [] END AS dkim_domains,
          t.msg_id IS NOT NULL AS attributed, m.failed, m.record, m.policy,
          coalesce(m.strict_spf, FALSE) AS strict_spf, coalesce(m.strict_dkim, FALSE) AS strict_dkim
        FROM claims c JOIN asks a ON a.msg_id = c.msg_id LEFT JOIN spf_0 s ON s.name = a.envelope AND s.ip = a.ip
        LEFT JOIN dkim_up k ON k.msg_id = c.msg_id LEFT JOIN attrib t ON t.msg_id = c.msg_id
        LEFT JOIN (SELECT DISTINCT msg_id FROM header_rows WHERE name = 'DKIM-Signature') sg ON sg.msg_id = c.msg_id
        LEFT JOIN dmarc_tags m ON m.domain = c.from_domain""",
    "merged_two": f"""SELECT *, {_sv} AS f_spf, {_sp} AS p_spf, {_sn} AS n_spf, {_kv} AS f_dkim, {_kp} AS p_dkim, {_kn} AS n_dkim FROM inputs""",
    "seen": """SELECT *, CASE WHEN spf_i IN ('pass','fail','softfail','neutral','none','permerror') THEN
            CASE WHEN f_spf = spf_i THEN spf_i WHEN f_spf = 'pass' THEN 'pass' END END AS d_spf,
          CASE WHEN dkim_i IN ('pass','fail','none') THEN CASE WHEN f_dkim = dkim_i THEN dkim_i WHEN f_dkim = 'pass' THEN 'pass' END END AS d_dkim
        FROM merged_two""",
    "aligned": f"""SELECT *, coalesce(d_spf = 'pass' AND (envelope = from_domain OR (NOT strict_spf AND {o.reg("envelope")} = {o.reg("from_domain")})), FALSE) AS ok_spf,
          coalesce(d_dkim = 'pass' AND len(list_filter(dkim_domains, lambda d: d = from_domain OR (NOT strict_dkim AND {o.reg("d")} = {o.reg("from_domain")}))) > 0, FALSE) AS ok_dkim
        FROM seen""",
    "dmarced": """SELECT *, CASE WHEN from_domain IS NULL THEN NULL WHEN failed THEN 'temperror' WHEN record IS NULL THEN 'none'
          WHEN ok_spf OR ok_dkim THEN 'pass' WHEN d_spf IS NULL OR d_dkim IS NULL THEN 'temperror' ELSE 'fail' END AS dmarc_i FROM aligned""",
    "finals": f"""SELECT *, {_mv} AS f_dmarc, {_mp} AS p_dmarc, {_mn} AS n_dmarc FROM dmarced""",
}


def verified(spark, sf):
    return dnsauth.verified_auth(claimed_auth(spark, sf), view(spark, sf, "dns"),
                                 view(spark, sf, "dkim_results"))


@query("verified_authentication", "P64 P71 F31 F42", ctes=VERIFIED_CTES, oracle="""
    SELECT msg_id, spf_i AS spf_checked, dkim_i AS dkim_checked, dmarc_i AS dmarc_checked, d_spf AS dmarc_spf, d_dkim AS dmarc_dkim,
           f_spf AS final_spf, f_dkim AS final_dkim, f_dmarc AS final_dmarc,
           p_spf AS spf_provenance, p_dkim AS dkim_provenance, p_dmarc AS dmarc_provenance,
           CASE WHEN names <> '' THEN concat('independent (', names, ') + headers')
                WHEN attributed AND list_contains([p_spf, p_dkim, p_dmarc], 'header-authoritative') THEN 'attributed headers' ELSE 'headers' END AS source
    FROM (SELECT *, array_to_string(list_filter([CASE WHEN starts_with(p_spf, 'live') THEN 'SPF' END, CASE WHEN starts_with(p_dkim, 'live') THEN 'DKIM' END,
            CASE WHEN starts_with(p_dmarc, 'live') THEN 'DMARC' END], lambda x: x IS NOT NULL), '/') AS names FROM finals) z""")
def verified_authentication(spark, sf):
    return verified(spark, sf).select(
        "msg_id", "spf_checked", "dkim_checked", "dmarc_checked", "dmarc_spf", "dmarc_dkim",
        "final_spf", "final_dkim", "final_dmarc", "spf_provenance", "dkim_provenance",
        "dmarc_provenance", "source")


_MERGED = {
    "fin": "SELECT msg_id, f_spf AS spf, f_dkim AS dkim, f_dmarc AS dmarc FROM finals",
    "fin_sig": o.auth_signals("fin"),
}


@query("verified_verdicts", "X1 P64 P71", ctes={**VERIFIED_CTES, **_MERGED}, oracle="""
    SELECT f.msg_id, f.spf, f.dkim, f.dmarc,
      coalesce((SELECT string_agg(s.indicator, ', ' ORDER BY s.indicator) FROM fin_sig s WHERE s.msg_id = f.msg_id), '') AS auth_indicators
    FROM fin f""")
def verified_verdicts(spark, sf):
    """The whole analysis with independent authentication: merged verdicts and the signals they give."""
    from .analysis import analyse
    d = analyse(letters(spark, sf), AS_OF, dns=view(spark, sf, "dns"), dkim_results=view(spark, sf, "dkim_results"))
    named = F.transform(F.filter("signals", lambda s: s["indicator"].isin(
        [i for rules in fv.AUTH_WEIGHTS.values() for _, i in rules.values()])), lambda s: s["indicator"])
    return d.select("msg_id", "spf", "dkim", "dmarc", F.array_join(F.array_sort(named), ", ").alias("auth_indicators"))


@query("enforced_dmarc_failures", "P70", ctes=VERIFIED_CTES, oracle="""
    SELECT msg_id, policy FROM finals WHERE dmarc_i IN ('pass','fail','none','permerror') AND f_dmarc = 'fail'
      AND policy IN ('reject', 'quarantine')""")
def enforced_dmarc_failures(spark, sf):
    d = verified(spark, sf).where(F.exists("auth_inconsistencies", lambda p: F.startswith(
        p, F.lit("dmarc failure under p="))))
    return d.select("msg_id", "policy")


# --- activity ------------------------------------------------------------------

@query("lookup_quota_pressure", "W13", oracle="""
    SELECT DISTINCT user_id, ts, n AS in_window, n > 3 AS over_quota FROM (
      SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS n
      FROM events) z""")
def lookup_quota_pressure(spark, sf):
    return activity.quota_pressure(table(spark, sf, "events"), window_seconds=86400, quota=3)


@query("lookup_quota_pressure_default", "W13", oracle="""
    SELECT DISTINCT user_id, ts, n AS in_window, n > 30 AS over_quota FROM (
      SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n
      FROM events) z""")
def lookup_quota_pressure_default(spark, sf):
    return activity.quota_pressure(table(spark, sf, "events"), window_seconds=60, quota=30)


@query("failure_streaks_default", "W14", oracle="""
    SELECT user_id, count(*) AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM (
      SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events) z
    WHERE event_type = 'error' GROUP BY user_id, grp HAVING count(*) >= 3""")
def failure_streaks_default(spark, sf):
    return activity.failure_streaks(table(spark, sf, "events"), minimum=3)


@query("failure_streaks", "W14", oracle="""
    SELECT user_id, count(*) AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM (
      SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events) z
    WHERE event_type = 'error' GROUP BY user_id, grp HAVING count(*) >= 2""")
def failure_streaks(spark, sf):
    return activity.failure_streaks(table(spark, sf, "events"), minimum=2)
