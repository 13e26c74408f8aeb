"""Independent SPF, DKIM and DMARC results from snapshot tables.

SPF is evaluated once per distinct (domain, address) pair, not per message, and the
answer is joined back with salting because a few senders make up most mail.  Nested
records are resolved bottom-up in a fixed number of rounds, the nesting limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, compact, text
from ..functions.identity import aligned, registrable
from ..functions.network import ipv4_number, is_ipv6, sending_ip
from . import auth
from .scale import durable, salted_lookup

# Limits and qualifiers of SPF, tags of DMARC.
MAX_DEPTH, MAX_LOOKUPS, MAX_MX_HOSTS = 5, 10, 10
QUALIFIERS = {"+": "pass", "-": "fail", "~": "softfail", "?": "neutral"}
KNOWN_MECHANISMS = ["all", "ip4", "ip6", "a", "mx", "include", "exists", "ptr"]
COSTLY_MECHANISMS = ["a", "mx", "include", "exists", "ptr"]
DMARC_TAGS = ["v", "p", "sp", "np", "adkim", "aspf", "pct", "fo", "rf", "ri", "rua", "ruf"]
DEFINITIVE_SPF = ["pass", "fail", "softfail", "neutral", "none", "permerror"]
DEFINITIVE_DKIM = ["pass", "fail", "none"]
DEFINITIVE_DMARC = ["pass", "fail", "none", "permerror"]


# --- SPF -----------------------------------------------------------------------

def spf_policies(dns: DataFrame) -> DataFrame:
    """One row per name: state (ok, none, permerror, temperror) and the record."""
    is_spf = (F.col("status") == "ok") & F.lower(F.ltrim("value")).startswith("v=spf1")
    return dns.where(F.col("rdtype") == "TXT").groupBy("name").agg(
        F.count_if(is_spf).alias("n"), F.max(F.when(is_spf, F.trim("value"))).alias("record"),
        F.bool_or(F.col("status") == "temporary").alias("temporary")) \
        .select("name", "record", (
            F.when(F.col("temporary"), "temperror").when(F.col("n") == 0, "none")
            .when(F.col("n") > 1, "permerror")
            .when(F.col("record").rlike(r"(?i)%\{(?!d\}|i\})"), "temperror")
            .otherwise("ok")).alias("state"))


def spf_terms(policies: DataFrame) -> DataFrame:
    """Terms of readable records in order: qualifier, mechanism, argument, prefix length."""
    words = F.filter(F.split("record", r"\s+"), lambda w: w != "")
    rows = policies.where(F.col("state") == "ok").select(
        "name", F.posexplode(F.slice(words, F.lit(2), F.size(words))).alias("pos", "term"))
    redirect = F.lower("term").startswith("redirect=")
    modifier = F.col("term").rlike(r"(?i)^[a-z][a-z0-9_.-]*=")
    sign = F.substring("term", 1, 1)
    marked = sign.isin(*QUALIFIERS)
    bare = F.when(marked, F.expr("substring(term, 2)")).otherwise(F.col("term"))
    names = F.create_map(*[F.lit(x) for kv in QUALIFIERS.items() for x in kv])
    rows = rows.where(redirect | ~modifier).select(
        "name", "pos", redirect.alias("redirect"),
        F.element_at(names, F.when(marked, sign).otherwise(F.lit("+"))).alias("verdict"),
        F.when(redirect, F.lit("redirect"))
        .otherwise(F.lower(F.regexp_extract(bare, r"^([^:/]*)", 1))).alias("mechanism"),
        F.when(redirect, F.regexp_extract("term", r"=(.*)$", 1))
        .otherwise(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("raw_argument"),
        bare.alias("bare"))
    network = F.col("mechanism").isin("ip4", "ip6")
    argument = F.when(network, F.col("raw_argument")) \
        .otherwise(F.substring_index("raw_argument", "/", 1))
    argument = F.regexp_replace(argument, r"%\{[dD]\}", F.col("name"))
    prefix = F.when(~network, blank_to_null(F.regexp_extract("bare", r"/(\d+)(?://\d+)?$", 1)))
    # a length that no address has; one of too many digits does not fit a number
    stated = F.coalesce(prefix, F.when(network, blank_to_null(F.regexp_extract("raw_argument", r"/(\d+)$", 1))))
    widest = F.when(F.col("mechanism") == "ip6", 128).otherwise(32)
    broken = F.col("mechanism").isin("ip4", "ip6", "a", "mx") & stated.isNotNull() \
        & F.coalesce(stated.try_cast("int") > widest, F.lit(True))
    return rows.select("name", "pos", "redirect", "verdict", "mechanism", argument.alias("argument"),
                       prefix.try_cast("int").alias("prefix"), broken.alias("broken"))


def spf_nesting(terms: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, name, depth): records a root reaches through include and redirect."""
    edges = terms.where(F.col("mechanism").isin("include", "redirect")) \
        .select("name", F.lower("argument").alias("target"))
    level = roots.select(F.col("domain").alias("root"), F.col("domain").alias("name"),
                         F.lit(0).alias("depth")).distinct()
    reached = level
    for depth in range(1, max_depth + 1):
        level = level.join(edges, "name").select(
            "root", F.col("target").alias("name"), F.lit(depth).alias("depth")).distinct()
        reached = reached.unionByName(level)
    return reached


def ipv6_hex(ip) -> Column:
    """An IPv6 address as 32 hexadecimal digits."""
    sides = F.split(F.lower(text(ip)), "::")
    left = F.filter(F.split(F.get(sides, F.lit(0)), ":"), lambda g: g != "")
    right = F.filter(F.split(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    groups = F.when(F.size(sides) > 1, F.concat(left, gap, right)).otherwise(left)
    return F.when(is_ipv6(ip), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def in_network(ip, network, prefix=None) -> Column:
    """``ip`` lies in ``network`` (address or address/length; ``prefix`` overrides).  No address lies in a network
    whose length is over 32 (IPv6: 128)."""
    base = F.substring_index(network, "/", 1)
    length = F.regexp_extract(network, r"/(\d+)$", 1).try_cast("int")
    bits = length if prefix is None else F.coalesce(prefix, length)
    # lengths are bounded before they become exponents; longer ones hold no address
    short, wide = F.coalesce(bits, F.lit(32)), F.coalesce(bits, F.lit(128))
    size = F.pow(F.lit(2.0), F.lit(32) - F.least(short, F.lit(32))).cast("bigint")
    a, b = ipv4_number(ip), ipv4_number(base)
    v4 = (F.floor(a / size) == F.floor(b / size)) & (short <= 32)
    x, y = ipv6_hex(ip), ipv6_hex(base)
    whole, rest = F.floor(F.least(wide, F.lit(128)) / 4).cast("int"), F.least(wide, F.lit(128)) % 4
    digit = [F.conv(v.substr(whole + 1, F.lit(1)), 16, 10).cast("int") for v in (x, y)]
    step = F.pow(F.lit(2.0), F.lit(4) - rest).cast("int")
    v6 = (x.substr(F.lit(1), whole) == y.substr(F.lit(1), whole)) & (wide <= 128) & (
        (rest == 0) | (F.floor(digit[0] / step) == F.floor(digit[1] / step)))
    return F.coalesce(v4, v6, F.lit(False))


def mx_hosts(dns: DataFrame, most: int = MAX_MX_HOSTS) -> DataFrame:
    """First mail hosts of each name."""
    from pyspark.sql import Window
    order = Window.partitionBy("name").orderBy("value")
    return dns.where((F.col("rdtype") == "MX") & (F.col("status") == "ok")) \
        .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most) \
        .select("name", F.col("value").alias("host"))


def _addresses(dns: DataFrame) -> DataFrame:
    """(kind, target, value, temporary) for the mechanisms that look names up."""
    a = dns.where(F.col("rdtype").isin("A", "AAAA"))
    temporary = (F.col("status") == "temporary").alias("temporary")
    direct = a.select(F.lit("a").alias("kind"), F.col("name").alias("target"), "value", temporary)
    exists = direct.withColumn("kind", F.lit("exists"))
    mx = mx_hosts(dns).join(a.select(F.col("name").alias("host"), "value", temporary), "host") \
        .select(F.lit("mx").alias("kind"), F.col("name").alias("target"), "value", "temporary")
    return direct.unionByName(exists).unionByName(mx)


def evaluate_spf(asked: DataFrame, dns: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """SPF verdict of every distinct (domain, ip) in ``asked``.

    The pairs and the terms they try are checkpointed: they are read once per round,
    and without that every round would repeat the whole plan behind ``asked``.
    """
    policies = spf_policies(dns)
    terms = spf_terms(policies)
    roots = durable(asked.select(F.lower("domain").alias("root"), "ip").distinct())
    names = durable(spf_nesting(terms, roots.select(F.col("root").alias("domain")), max_depth))
    deepest = names.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    pairs = durable(roots.join(names.select("root", "name").distinct(), "root")
                    .select("name", "ip").distinct())

    tries = pairs.join(terms, "name").withColumn("target", F.lower(F.regexp_replace(
        F.coalesce(blank_to_null(F.col("argument")), F.col("name")), r"%\{[iI]\}", F.col("ip"))))
    found = tries.where(F.col("mechanism").isin("a", "mx", "exists")).join(
        _addresses(dns).withColumnRenamed("kind", "mechanism"), ["mechanism", "target"]) \
        .withColumn("hit", (F.col("mechanism") == "exists")
                    | in_network("ip", F.col("value"), F.col("prefix"))) \
        .groupBy("name", "ip", "pos").agg(F.bool_or(F.col("hit") & ~F.col("temporary"))
                                          .alias("hit"), F.bool_or("temporary").alias("temporary"))
    tries = tries.join(found, ["name", "ip", "pos"], "left").select(
        "name", "ip", "pos", "mechanism", "verdict", "target", "broken",
        F.coalesce("temporary", F.lit(False)).alias("temporary"), (
            (F.col("mechanism") == "all")
            | (F.col("mechanism").isin("ip4", "ip6") & in_network("ip", F.col("argument")))
            | F.coalesce("hit", F.lit(False))).alias("matched"))

    tries = durable(tries)
    results = None
    for _ in range(deepest + 1):
        results = _spf_round(pairs, policies, tries, results)
    return results.withColumnRenamed("name", "root").join(roots, ["root", "ip"]) \
        .select(F.col("root").alias("domain"), "ip", F.when(
            F.col("lookups") > MAX_LOOKUPS, "permerror").otherwise(F.col("spf")).alias("spf"),
            "lookups")


def _spf_round(pairs, policies, tries, inner) -> DataFrame:
    """Verdicts of all pairs, given the inner verdicts of the previous round."""
    nested = F.col("mechanism").isin("include", "redirect")
    if inner is None:
        # beyond the nesting limit
        d = tries.withColumns({"inner_spf": F.when(nested, F.lit("permerror")),
                               "inner_lookups": F.lit(0)})
    else:
        child = inner.select(F.col("name").alias("target"), "ip", F.col("spf").alias("inner_spf"),
                             F.col("lookups").alias("inner_lookups"))
        d = tries.join(child, ["target", "ip"], "left") \
            .withColumn("inner_spf", F.when(nested, F.coalesce("inner_spf", F.lit("none"))))
    include = F.col("mechanism") == "include"
    decided = (
        F.when(F.col("mechanism") == "redirect", None)
        .when(~F.col("mechanism").isin(KNOWN_MECHANISMS) | (include & (F.col("target") == "")) | F.col("broken"),
              F.lit("permerror"))
        .when(F.col("temporary") & ~F.col("matched"), F.lit("temperror"))
        .when(include & F.col("inner_spf").isin("permerror", "temperror"), F.col("inner_spf"))
        .when(F.col("matched") | (include & (F.col("inner_spf") == "pass")), F.col("verdict")))
    cost = F.when(F.col("mechanism").isin(COSTLY_MECHANISMS + ["redirect"]), 1).otherwise(0) \
        + F.when(nested, F.coalesce("inner_lookups", F.lit(0))).otherwise(0)
    # A record is short (it fits one DNS answer), so its terms fit one array.
    steps = d.select("name", "ip", F.struct(
        F.when(F.col("mechanism") == "redirect", F.lit(10 ** 6)).otherwise(F.col("pos")).alias("at"),
        F.when(F.col("mechanism") == "redirect", F.col("inner_spf")).otherwise(decided).alias("v"),
        cost.alias("cost")).alias("step")).groupBy("name", "ip") \
        .agg(F.array_sort(F.collect_list("step")).alias("steps"))
    at = F.array_position(F.transform("steps", lambda s: s["v"].isNotNull()), F.lit(True)).cast("int")
    used = F.when(at > 0, at).otherwise(F.size("steps"))
    walked = pairs.join(policies, "name", "left").join(steps, ["name", "ip"], "left")
    return walked.select(
        "name", "ip",
        F.when(F.coalesce("state", F.lit("none")) != "ok", F.coalesce("state", F.lit("none")))
        .otherwise(F.coalesce(F.get(F.filter(F.transform("steps", lambda s: s["v"]),
                                             lambda v: v.isNotNull()), F.lit(0)),
                              F.lit("neutral"))).alias("spf"),
        F.coalesce(F.aggregate(F.slice("steps", F.lit(1), used), F.lit(0),
                               lambda a, s: a + s["cost"]), F.lit(0)).alias("lookups"))


# --- DKIM and DMARC ------------------------------------------------------------

def dkim_rollup(results: DataFrame) -> DataFrame:
    """One verdict per message from the outcome of each signature."""
    def seen(outcome):
        return F.bool_or(F.col("outcome") == outcome)

    return results.groupBy("msg_id").agg(
        F.when(seen("pass"), "pass").when(seen("fail"), "fail").otherwise("temperror")
        .alias("dkim_checked"),
        F.array_sort(F.collect_set(F.when(F.col("outcome") == "pass", F.col("domain"))))
        .alias("passed_domains"),
        F.min_by("domain", "idx").alias("first_signer"))


def signature_tags(messages: DataFrame) -> DataFrame:
    """Signing domain and selector of every DKIM-Signature header."""
    signed = F.filter("headers", lambda h: F.lower(h["name"]) == "dkim-signature")
    rows = messages.select("msg_id", F.posexplode(signed).alias("idx", "h"))
    return rows.select(
        "msg_id", "idx",
        F.lower(F.rtrim(F.regexp_extract("h.value", r"(?i)(?:^|;)\s*d\s*=\s*([^;\s]+)", 1),
                        F.lit("."))).alias("domain"),
        F.regexp_extract("h.value", r"(?i)(?:^|;)\s*s\s*=\s*([^;\s]+)", 1).alias("selector"))


def dmarc_records(dns: DataFrame) -> DataFrame:
    """One row per queried name: state and the policy record."""
    is_dmarc = (F.col("status") == "ok") & F.lower(F.ltrim("value")).startswith("v=dmarc1")
    return dns.where((F.col("rdtype") == "TXT") & F.col("name").startswith("_dmarc.")) \
        .groupBy(F.expr("substring(name, 8)").alias("queried")).agg(
            F.min(F.when(is_dmarc, F.trim("value"))).alias("record"),
            F.bool_or(F.col("status") == "temporary").alias("temporary"))


def dmarc_tags(record) -> Column:
    """Known tags of a policy record, names lower-cased; of a tag that is repeated the last counts."""
    cut = F.transform(F.split(F.coalesce(record, F.lit("")), ";"), lambda t: F.struct(
        F.lower(F.trim(F.substring_index(t, "=", 1))).alias("key"),
        F.when(F.contains(t, F.lit("=")), F.trim(F.regexp_replace(t, r"(?s)^[^=]*=", ""))).otherwise(F.lit("")).alias("value")))
    last = F.transform(F.array(*[F.lit(t) for t in DMARC_TAGS]), lambda name: F.struct(
        name, F.try_element_at(F.filter(cut, lambda t: t["key"] == name), F.lit(-1))["value"]))
    return F.map_from_entries(last)


def dmarc_lookup(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """Policy for each distinct domain: its own record, else its organisation's."""
    records = dmarc_records(dns)
    own = records.select(F.col("queried").alias("domain"), F.col("record").alias("own"),
                         F.col("temporary").alias("own_temporary"))
    org = records.select(F.col("queried").alias("org"), F.col("record").alias("parent"),
                         F.col("temporary").alias("org_temporary"))
    d = domains.withColumn("org", registrable("domain")) \
        .join(own, "domain", "left").join(org, "org", "left")
    failed = F.coalesce("own_temporary", F.lit(False)) | (
        F.col("own").isNull() & F.coalesce("org_temporary", F.lit(False)))
    from_org = F.col("own").isNull() & F.col("parent").isNotNull() & (F.col("org") != F.col("domain"))
    d = d.select("domain", failed.alias("dmarc_failed"), from_org.alias("from_org"),
                 F.coalesce("own", "parent").alias("dmarc_record"))
    tags = dmarc_tags(F.col("dmarc_record"))

    def tag(name):
        return F.lower(F.try_element_at(F.col("tags"), F.lit(name)))

    d = d.withColumn("tags", tags)
    return d.select(
        "domain", "dmarc_failed", "dmarc_record",
        F.when(F.col("from_org") & (F.coalesce(tag("sp"), F.lit("")) != ""), tag("sp"))
        .otherwise(blank_to_null(tag("p"))).alias("policy"),
        (F.substring(F.coalesce(tag("aspf"), F.lit("r")), 1, 1) == "s").alias("strict_spf"),
        (F.substring(F.coalesce(tag("adkim"), F.lit("r")), 1, 1) == "s").alias("strict_dkim"))


def visible_to_dmarc(merged_verdict, independent, definitive) -> Column:
    """What DMARC may rely on: the independent result if it stands, else a kept pass."""
    return F.when(definitive & (merged_verdict == independent), independent) \
        .when(definitive & (merged_verdict == "pass"), F.lit("pass"))


def evaluate_dmarc(spf, dkim, envelope, from_domain, passed_domains) -> Column:
    """DMARC verdict on the row; either aligned pass suffices, failing needs both known."""
    spf_ok = F.coalesce((spf == "pass") & aligned(envelope, from_domain, F.col("strict_spf")),
                        F.lit(False))
    dkim_ok = F.coalesce((dkim == "pass") & F.exists(
        passed_domains, lambda d: aligned(d, from_domain, F.col("strict_dkim"))), F.lit(False))
    return (
        F.when(F.coalesce("dmarc_failed", F.lit(False)), F.lit("temperror"))
        .when(F.col("dmarc_record").isNull(), F.lit("none"))
        .when(spf_ok | dkim_ok, F.lit("pass"))
        .when(spf.isNull() | dkim.isNull(), F.lit("temperror"))
        .otherwise(F.lit("fail")))


# --- everything together -------------------------------------------------------

def verified_auth(messages: DataFrame, dns: DataFrame, dkim_results: DataFrame) -> DataFrame:
    """Final SPF/DKIM/DMARC per message with provenance.

    ``messages`` carries header claims (:func:`auth.with_header_auth`); the result is
    keyed by msg_id and holds no message content.
    """
    originating = F.transform(F.filter("headers", lambda h: F.lower(h["name"]).isin(
        "x-originating-ip", "x-sender-ip", "x-source-ip", "x-real-ip")), lambda h: h["value"])
    d = messages.select(
        "msg_id", "from_domain", "spf", "dkim", "dmarc", "mailfrom", "dkim_domain",
        "auth_attributed", "authentication_results",
        F.lower(auth.envelope_domain()).alias("envelope"),
        F.coalesce("designated_ip", sending_ip("received_chain", originating)).alias("client_ip"),
        F.exists("headers", lambda h: F.lower(h["name"]) == "dkim-signature").alias("is_signed"))
    d = durable(d)
    asked = d.where(F.col("envelope").isNotNull() & F.col("client_ip").isNotNull()) \
        .select(F.col("envelope").alias("domain"), F.col("client_ip").alias("ip")).distinct()
    spf = evaluate_spf(asked, dns).select(
        F.concat_ws("|", "domain", "ip").alias("spf_key"), F.col("spf").alias("spf_checked"))
    d = salted_lookup(d.withColumn("spf_key", F.when(
        F.col("client_ip").isNotNull(), F.concat_ws("|", "envelope", "client_ip"))),
        spf, "spf_key", "msg_id")
    d = d.join(dkim_rollup(dkim_results), "msg_id", "left") \
        .withColumn("dkim_checked", F.when(F.col("dkim_checked").isNotNull(), F.col("dkim_checked"))
                    .when(~F.col("is_signed"), "none"))
    senders = d.select(F.col("from_domain").alias("domain")).where("domain is not null").distinct()
    d = salted_lookup(d, dmarc_lookup(senders, dns).withColumnRenamed("domain", "from_domain"),
                      "from_domain", "msg_id")

    spf_known = F.coalesce(F.col("spf_checked").isin(DEFINITIVE_SPF), F.lit(False))
    dkim_known = F.coalesce(F.col("dkim_checked").isin(DEFINITIVE_DKIM), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    passed = F.coalesce("passed_domains", none)
    d = d.withColumns({
        "m_spf": auth.merged("spf", "spf", "spf_checked", spf_known, "auth_attributed"),
        "m_dkim": auth.merged("dkim", "dkim", "dkim_checked", dkim_known, "auth_attributed",
                              crypto_fail=F.col("first_signer").isNotNull()
                              | F.col("is_signed")),
        "spf_known": spf_known, "dkim_known": dkim_known,
        "aligned_with": F.when(F.size(passed) > 0, passed).otherwise(
            F.when(F.col("first_signer").isNotNull(), F.array("first_signer")).otherwise(none))})
    d = d.withColumns({
        "dmarc_spf": visible_to_dmarc(F.col("m_spf.verdict"), F.col("spf_checked"), F.col("spf_known")),
        "dmarc_dkim": visible_to_dmarc(F.col("m_dkim.verdict"), F.col("dkim_checked"),
                                       F.col("dkim_known"))})
    d = d.withColumn("dmarc_checked", F.when(
        F.col("from_domain").isNotNull(), evaluate_dmarc(
            F.col("dmarc_spf"), F.col("dmarc_dkim"), F.col("envelope"), F.col("from_domain"),
            F.col("aligned_with"))))
    d = d.withColumn("dmarc_known", F.coalesce(F.col("dmarc_checked").isin(DEFINITIVE_DMARC),
                                               F.lit(False)))
    d = d.withColumn("m_dmarc", auth.merged("dmarc", "dmarc", "dmarc_checked", "dmarc_known",
                                            "auth_attributed"))
    live = F.lit("live")
    d = d.withColumns({
        "final_spf": F.col("m_spf.verdict"), "final_dkim": F.col("m_dkim.verdict"),
        "final_dmarc": F.col("m_dmarc.verdict"),
        "final_signer": F.when(F.col("m_dkim.provenance").startswith(live) & F.col("dkim_known"),
                               F.coalesce(F.get(passed, F.lit(0)), "first_signer", "dkim_domain"))
        .otherwise(F.col("dkim_domain"))})
    problems = F.concat(
        auth.inconsistencies("final_spf", "final_dkim", "final_dmarc", "envelope", "final_signer"),
        compact(F.col("m_spf.note"), F.col("m_dkim.note"), F.col("m_dmarc.note"),
                F.when(F.col("dmarc_known") & (F.col("final_dmarc") == "fail")
                       & F.col("policy").isin("reject", "quarantine"),
                       F.concat(F.lit("dmarc failure under p="), "policy"))))
    names = compact(*[F.when(F.col(f"m_{m}.provenance").startswith(live), F.lit(m.upper()))
                      for m in ("spf", "dkim", "dmarc")])
    d = d.withColumns({"auth_inconsistencies": F.array_distinct(problems), "verified": names})
    kept = (F.col("m_spf.provenance") == "header-authoritative") \
        | (F.col("m_dkim.provenance") == "header-authoritative") \
        | (F.col("m_dmarc.provenance") == "header-authoritative")
    return d.select(
        "msg_id", "client_ip", "envelope", "spf_checked", "dkim_checked", "dmarc_checked",
        "policy", "dmarc_spf", "dmarc_dkim",
        "final_spf", "final_dkim", "final_dmarc", "auth_inconsistencies",
        F.col("m_spf.provenance").alias("spf_provenance"),
        F.col("m_dkim.provenance").alias("dkim_provenance"),
        F.col("m_dmarc.provenance").alias("dmarc_provenance"),
        (F.size("verified") > 0).alias("live_verified"),
        F.when(F.size("verified") > 0, F.concat(
            F.lit("independent ("), F.array_join("verified", "/"), F.lit(") + headers")))
        .when(F.col("auth_attributed") & kept, F.lit("attributed headers"))
        .otherwise(F.lit("headers")).alias("source"),
        F.concat_ws(" ", F.when(F.col("auth_attributed"), F.lit("headers attributed;")),
                    F.when(F.size("verified") > 0, F.concat(
                        F.array_join("verified", ", "), F.lit(" re-verified;"))),
                    F.concat(F.lit("sending ip "), "client_ip", F.lit(";"))).alias("note"))
