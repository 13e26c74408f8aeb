"""Building blocks for the DuckDB side of the checks.

The SQL here is a second, independent statement of the rules: joins, windows and
long tables where the engine uses arrays on the message's row.
"""

from __future__ import annotations

from ..functions import fixed_values as fv


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return f"[{quoted(values)}]"


def addr(x: str) -> str:
    return (f"lower(coalesce(nullif(trim(regexp_extract({x}, '<([^<>]*@[^<>]*)>\\s*$', 1)), ''), "
            f"nullif(trim(regexp_extract({x}, '<([^>]*@[^>]*)>', 1)), ''), "
            f"nullif(regexp_extract({x}, '[^\\s<>,;:\"()]+@[^\\s<>,;:\"()]+'), '')))")


def dom(a: str) -> str:
    return (f"CASE WHEN contains({a}, '@') THEN "
            f"nullif(lower(rtrim(trim(split_part({a}, '@', -1), '<>[] '), '.')), '') END")


def reg(h: str) -> str:
    parts = f"list_filter(string_split(lower({h}), '.'), lambda p: p <> '')"
    return (f"(CASE WHEN list_contains({listed(fv.MULTI_LABEL_SUFFIXES)}, "
            f"array_to_string(({parts})[-2:], '.')) THEN array_to_string(({parts})[-3:], '.') "
            f"ELSE array_to_string(({parts})[-2:], '.') END)")


def display(x: str) -> str:
    return (f"CASE WHEN contains({x}, '<') THEN trim(regexp_extract({x}, '^\\s*\"?([^\"<]*)\"?\\s*<', 1)) "
            f"ELSE trim(regexp_extract({x}, '\\(([^()]*)\\)\\s*$', 1)) END")


def fold(x: str) -> str:
    return f"translate({x}, '01358@-', 'olesba')"


def plausible(h: str) -> str:
    return (f"(length({h}) <= 253 AND regexp_full_match({h}, "
            f"'[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+') "
            f"AND list_contains({listed(fv.COMMON_TLDS)}, split_part({h}, '.', -1)))")


def same_org(a: str, b: str) -> str:
    return (f"({a} = {b} OR {reg(a)} = {reg(b)} OR ends_with({a}, '.' || {reg(b)}) "
            f"OR ends_with({b}, '.' || {reg(a)}))")


def platform(h: str) -> str:
    return (f"({reg(h)} NOT IN ({quoted(fv.FREE_MAIL_DOMAINS)}) AND EXISTS (SELECT 1 FROM "
            f"(SELECT unnest({listed(fv.ESP_DOMAINS)}) AS esp) z "
            f"WHERE {h} = z.esp OR ends_with({h}, '.' || z.esp)))")


def lookalike(domains: str) -> dict[str, str]:
    """CTEs ending in ``look(domain, brand)`` for a query of distinct domains."""
    brands = ", ".join(f"({i}, '{b}')" for i, b in enumerate(fv.BRANDS))
    return {
        "brand_list": f"SELECT * FROM (VALUES {brands}) AS b(ord, brand)",
        "look_parts": f"""
            SELECT domain, trim(lower(domain), '.') AS h, {reg("domain")} AS org,
                   split_part(trim(lower(domain), '.'), '.', 1) AS label,
                   {fold("split_part(trim(lower(domain), '.'), '.', 1)")} AS folded,
                   regexp_split_to_array(trim(lower(domain), '.'), '[._-]+') AS words
            FROM ({domains}) z""",
        "look_hits": f"""
            SELECT p.domain, b.brand,
                   CASE WHEN p.label <> b.brand AND (p.folded = b.brand OR (length(b.brand) >= 5
                        AND (levenshtein(p.label, b.brand) BETWEEN 1 AND 2
                             OR levenshtein(p.folded, b.brand) BETWEEN 1 AND 2))) THEN b.ord
                        WHEN length(b.brand) >= 6 AND b.brand <> 'square'
                        AND (list_contains(p.words, b.brand)
                             OR list_contains(list_transform(p.words, lambda w: {fold("w")}), b.brand))
                        THEN 1000 + b.ord END AS place
            FROM look_parts p CROSS JOIN brand_list b
            WHERE p.org NOT IN ({quoted(fv.BRAND_OWNED_DOMAINS)})
              AND split_part(p.org, '.', 1) NOT IN ({quoted(fv.BRANDS)})""",
        "look": """SELECT domain, arg_min(brand, place) AS brand FROM look_hits
                   WHERE place IS NOT NULL GROUP BY domain""",
    }


def relation(a: str, b: str, brand: str) -> str:
    """Relationship of two domains; ``brand`` is the lookalike of ``b`` or NULL."""
    free = quoted(fv.FREE_MAIL_DOMAINS)
    return (f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 'unrelated' "
            f"WHEN {same_org(a, b)} THEN 'same_org' "
            f"WHEN {reg(b)} IN ({free}) AND {reg(a)} NOT IN ({free}) THEN 'suspicious' "
            f"WHEN (contains({b}, '.') AND split_part({b}, '.', -1) IN ({quoted(fv.HIGH_RISK_TLDS)})) "
            f"OR {brand} IS NOT NULL THEN 'suspicious' "
            f"WHEN {platform(b)} THEN 'trusted_esp' ELSE 'unrelated' END")


def family(indicator: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({indicator}), '{n}')" for n in needles)
        + f" THEN '{fam}'" for fam, needles in fv.FAMILY_NEEDLES)
    return f"CASE {cases} ELSE '{fv.DEFAULT_FAMILY}' END"


def severity(weight: str) -> str:
    return (f"CASE WHEN {weight} >= 30 THEN 'Critical' WHEN {weight} >= 20 THEN 'High' "
            f"WHEN {weight} >= 10 THEN 'Medium' ELSE 'Low' END")


def display_score(raw: str) -> str:
    return (f"CAST(CASE WHEN {raw} <= 70 THEN {raw} WHEN {raw} <= 150 "
            f"THEN round_even(70 + ({raw} - 70) * 20 / 80.0, 0) "
            f"ELSE least(99, round_even(90 + 10 * (1 - 150.0 / {raw}), 0)) END AS INT)")


def bucket(score: str) -> str:
    return (f"CASE WHEN {score} >= 90 THEN 'Critical' WHEN {score} >= 70 THEN 'High' "
            f"WHEN {score} >= 30 THEN 'Medium' ELSE 'Low' END")


CAPS = "(VALUES " + ", ".join(f"('{f}', {c})" for f, c in fv.FAMILY_CAPS.items()) \
    + ") AS caps(family, cap)"


def scored(signals: str, messages: str) -> dict[str, str]:
    """CTEs from long signals to verdicts.

    ``signals``: msg_id, seq, indicator, strength, weight.  ``messages``: msg_id,
    trusted, claimed, hop_count, has_body.
    """
    soft = quoted(fv.DAMPENED_INDICATORS)
    return {
        "sig_in": signals,
        "msg_in": messages,
        "sig_damped": f"""
            SELECT s.msg_id, s.seq, s.indicator, s.strength, s.weight AS original_weight,
                   {family("s.indicator")} AS family,
                   CASE WHEN m.trusted AND s.indicator IN ({soft}) THEN 0 ELSE s.weight END AS w
            FROM sig_in s JOIN msg_in m ON m.msg_id = s.msg_id""",
        "sig_capped": f"""
            SELECT d.*, greatest(0, least(d.w, caps.cap - coalesce(sum(d.w) OVER (
                     PARTITION BY d.msg_id, d.family ORDER BY d.w DESC, d.seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS weight
            FROM sig_damped d JOIN {CAPS} ON caps.family = d.family""",
        "msg_totals": """
            SELECT m.msg_id, m.trusted, m.claimed, m.hop_count, m.has_body,
                   CAST(coalesce(sum(c.weight), 0) AS INT) AS raw_score,
                   count(c.msg_id) AS n_signals, count(DISTINCT c.family) AS n_families,
                   CAST(count(*) FILTER (c.weight > 0 AND c.strength = 'strong') AS INT) AS strong_signals,
                   CAST(count(*) FILTER (c.weight > 0 AND c.strength = 'weak') AS INT) AS weak_signals,
                   CAST(coalesce(sum(c.weight) FILTER (c.weight > 0 AND c.strength = 'strong'), 0) AS INT) AS strong_weight,
                   list_sort(coalesce(list(DISTINCT c.family) FILTER (c.weight > 0 AND c.strength = 'strong'), [])) AS fams
            FROM msg_in m LEFT JOIN sig_capped c ON c.msg_id = m.msg_id GROUP BY ALL""",
        "msg_scored": f"""
            SELECT *, {display_score("raw_score")} AS score FROM msg_totals""",
        "msg_verdicts": f"""
            SELECT msg_id, raw_score, score, strong_signals, weak_signals, strong_weight, trusted,
              array_to_string(fams, ',') AS strong_families,
              CASE WHEN len(fams) >= 2 AND score >= 90 THEN 'Critical'
                   WHEN len(fams) >= 2 AND score >= 55 THEN 'High'
                   WHEN score < 70 THEN {bucket("score")} ELSE 'Medium' END AS risk_level,
              CASE WHEN len(fams) >= 2 AND score >= 55 THEN concat('corroborated:families=', len(fams))
                   WHEN score < 70 THEN concat('band:', {bucket("score")})
                   WHEN fams = ['authentication'] THEN concat('demoted:authentication-only:weight=', strong_weight)
                   ELSE concat('demoted:uncorroborated:weight=', strong_weight, ':families=', len(fams)) END AS reason,
              claimed, hop_count, has_body, n_signals, n_families
            FROM msg_scored""",
    }


def confidence(optional: list[tuple[str, str, str]] = ()) -> tuple[str, str]:
    """(score, label) over msg_verdicts columns; optional (name, applicable, satisfied)."""
    factors = [("authentication results", "TRUE", "claimed"),
               ("verifiable routing chain", "TRUE", "hop_count >= 2"),
               ("message body", "TRUE", "has_body"), *optional,
               ("corroborating families", "n_signals > 0", "n_families >= 3")]
    total = " + ".join(f"CASE WHEN {a} THEN 1 ELSE 0 END" for _, a, _ in factors)
    held = " + ".join(f"CASE WHEN {a} AND {s} THEN 1 ELSE 0 END" for _, a, s in factors)
    missing = "list_filter([" + ", ".join(
        f"CASE WHEN {a} AND NOT ({s}) THEN '{n}' END" for n, a, s in factors) \
        + "], lambda x: x IS NOT NULL)"
    score = (f"CASE WHEN ({held}) > 0 THEN CAST(round_even(30 + 60.0 * ({held}) / ({total}), 0) "
             "AS INT) END")
    label = (f"CASE WHEN ({held}) = 0 THEN 'Insufficient evidence' ELSE concat("
             f"CASE WHEN {score} >= 85 THEN 'Very High Confidence' WHEN {score} >= 70 "
             f"THEN 'High Confidence' WHEN {score} >= 55 THEN 'Moderate Confidence' "
             "ELSE 'Low Confidence' END, "
             f"CASE WHEN len({missing}) > 0 THEN concat(' - limited by missing ', "
             f"array_to_string({missing}, ', ')) ELSE '' END) END")
    return score, label


def phrase_signals(source: str) -> str:
    """Wording signals of ``source``(msg_id, body, subject) as long rows."""
    rows, order = [], 0
    rows.append(f"""
        SELECT msg_id, 200 AS seq, 'Suspicious Keywords' AS indicator, 'weak' AS strength, 8 AS weight,
          array_to_string(list_filter({listed(fv.SUSPICIOUS_KEYWORDS)},
            lambda k: contains(lower(body), k) OR contains(lower(subject), k)), ', ') AS evidence
        FROM {source} WHERE {" OR ".join(f"contains(lower(body), '{k}') OR contains(lower(subject), '{k}')"
                                          for k in fv.SUSPICIOUS_KEYWORDS)}""")
    for order, (_, indicator, weight, strength, patterns) in enumerate(fv.PHRASE_FAMILIES, 1):
        tries = ", ".join(
            f"nullif(regexp_extract({col}, '(?i){p}', 0), '')"
            for _, p in patterns for col in ("body", "subject"))
        rows.append(f"""
            SELECT * FROM (SELECT msg_id, {200 + order} AS seq, '{indicator}' AS indicator,
              '{strength}' AS strength, {weight} AS weight, coalesce({tries}) AS evidence
              FROM {source}) z WHERE evidence IS NOT NULL""")
    return "\nUNION ALL ".join(rows)


def auth_signals(source: str) -> str:
    """Authentication verdict signals of ``source``(msg_id, spf, dkim, dmarc)."""
    rules = ", ".join(
        f"('{mech}', '{verdict}', {weight}, '{indicator}', {300 + i})"
        for i, mech in enumerate(fv.AUTH_WEIGHTS)
        for verdict, (weight, indicator) in fv.AUTH_WEIGHTS[mech].items())
    claims = " UNION ALL ".join(
        f"SELECT msg_id, '{m}' AS mech, {m} AS verdict FROM {source}" for m in fv.AUTH_WEIGHTS)
    return f"""
        SELECT c.msg_id, r.seq, r.indicator,
               CASE WHEN r.verdict = 'fail' THEN 'strong' ELSE 'weak' END AS strength, r.weight
        FROM ({claims}) c JOIN (VALUES {rules}) AS r(mech, verdict, weight, indicator, seq)
          ON r.mech = c.mech AND r.verdict = lower(c.verdict)"""
