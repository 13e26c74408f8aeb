"""Queries over links, HTML markup and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files
from ..functions import fixed_values as fv
from ..functions import urls
from ..functions.base import explode_rows
from ..operators import attachments, html, links
from . import oracle as o
from .registry import query
from .tables import view


# --- links ---------------------------------------------------------------------

def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_A = _sql(urls.ANCHOR_ELEMENT)
_SHAPE = _sql(urls.URL_SHAPE)


def _host(x: str) -> str:
    return (f"lower(split_part(regexp_replace(regexp_extract({x}, '{_SHAPE}', 2), '^.*@', ''), ':', 1))")


def _query(x: str) -> str:
    return f"regexp_extract({x}, '{_SHAPE}', 4)"


LINK_CTES = {
    "found": f"""
        SELECT msg_id, 0 AS src, generate_subscripts(m, 1) AS pos, unnest(m) AS el FROM (
          SELECT msg_id, regexp_extract_all(body_html, '{_A}') AS m FROM linked) z
        UNION ALL SELECT msg_id, 1, generate_subscripts(m, 1), unnest(m) FROM (
          SELECT msg_id, regexp_extract_all(body_plain, '{_sql(urls.PLAIN_URL)}') AS m FROM linked) z""",
    "cut": f"""
        SELECT msg_id, src, pos, CASE src WHEN 0 THEN trim(regexp_extract(el, '{_A}', 1)) ELSE trim(el) END AS raw,
               CASE src WHEN 0 THEN trim(regexp_replace(regexp_extract(el, '{_A}', 2), '<[^>]+>', '', 'g')) ELSE '' END AS anchor
        FROM found""",
    "firsts": """
        SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY msg_id ORDER BY src, pos) - 1 AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY msg_id, raw ORDER BY src, pos) AS rn FROM cut) z
        WHERE rn = 1 AND raw <> '' AND NOT starts_with(raw, 'javascript:') AND NOT starts_with(raw, 'mailto:')""",
    "hosts": f"""
        SELECT *, {_host("url")} AS host FROM (
          SELECT *, replace(raw, '&amp;', '&') AS url FROM firsts) z""",
    **o.lookalike("SELECT DISTINCT host AS domain FROM hosts WHERE host <> ''"),
    "claims": f"""
        SELECT h.*, l.brand,
          CASE WHEN anchor <> '' AND host <> '' THEN coalesce(
            CASE WHEN contains(anchor, '://') THEN (SELECT x FROM (SELECT {_host("anchor")} AS x) y
              WHERE {o.plausible("x")} OR regexp_full_match(x, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}')) END,
            (SELECT d FROM (SELECT {o.dom(o.addr("anchor"))} AS d) y WHERE {o.plausible("d")}),
            list_filter(list_transform(regexp_extract_all(anchor, '{_sql(urls.HOST_TOKEN)}', 1), lambda t: lower(t)),
                        lambda t: {o.plausible("t")})[1]) END AS claim
        FROM hosts h LEFT JOIN look l ON l.domain = h.host""",
    "redirects": f"""
        SELECT DISTINCT msg_id, raw FROM (
          SELECT msg_id, raw, own, lower(split_part(pair, '=', 1)) AS key,
                 url_decode(url_decode(CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) ELSE '' END)) AS target
          FROM (SELECT msg_id, raw, {_host("raw")} AS own, unnest(string_split({_query("raw")}, '&')) AS pair
                FROM firsts WHERE regexp_matches(raw, '{urls.OPEN_REDIRECT}')) z) y
        WHERE key IN ({o.quoted(fv.REDIRECT_KEYS)}) AND regexp_matches(target, '^(https?:)?//')
          AND {_host("target")} <> '' AND {o.reg(_host("target"))} <> {o.reg("own")}""",
    "flagged": f"""
        SELECT c.*, regexp_full_match(host, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') AS is_ip,
               host IN ({o.quoted(fv.SHORTENER_HOSTS)}) AS is_shortener,
               split_part(host, '.', -1) IN ({o.quoted(fv.HIGH_RISK_TLDS)}) AS risky_tld,
               regexp_extract(url, '{urls.OPEN_REDIRECT}', 0) AS redirect,
               r.raw IS NOT NULL AS leaves_site,
               coalesce({o.reg("claim")} <> {o.reg("host")}, FALSE) AS is_mismatched
        FROM claims c LEFT JOIN redirects r ON r.msg_id = c.msg_id AND r.raw = c.raw""",
    "link_findings": """
        SELECT *, list_filter([CASE WHEN is_ip THEN concat('ip:', host) END,
          CASE WHEN is_shortener THEN concat('shortener:', host) END,
          CASE WHEN risky_tld THEN concat('tld:', split_part(host, '.', -1)) END,
          CASE WHEN brand IS NOT NULL THEN concat('lookalike:', brand) END,
          CASE WHEN redirect <> '' THEN concat('redirect:', redirect) END,
          CASE WHEN is_mismatched THEN concat('anchor:', claim) END], lambda x: x IS NOT NULL) AS findings
        FROM flagged""",
    "link_sig": """
        SELECT msg_id, place * 5 AS seq, 'Deceptive / Mismatched Hyperlink' AS indicator, 'strong' AS strength, 30 AS weight
          FROM flagged WHERE is_mismatched
        UNION ALL SELECT msg_id, place * 5 + 1, 'IP-Based Link Target', 'strong', 25 FROM flagged WHERE is_ip
        UNION ALL SELECT msg_id, place * 5 + 2, 'URL Shortener Link', 'weak', 10 FROM flagged WHERE is_shortener
        UNION ALL SELECT msg_id, place * 5 + 3, 'Suspicious Link Domain',
            CASE WHEN brand IS NOT NULL THEN 'strong' ELSE 'weak' END, CASE WHEN brand IS NOT NULL THEN 25 ELSE 10 END
          FROM flagged WHERE risky_tld OR brand IS NOT NULL
        UNION ALL SELECT msg_id, min(place) * 5 + 4, 'Multiple / Open Redirect Link Parameter', 'weak', 15
          FROM flagged WHERE leaves_site GROUP BY msg_id""",
}


def linked(spark, sf):
    return links.with_links(view(spark, sf, "linked"))


@query("extracted_links", "B1 B2 W9 P18 F5", ctes=LINK_CTES, oracle=f"""
    SELECT msg_id, CAST(place AS INT) AS place, raw, anchor, host,
           concat(coalesce(nullif(lower(regexp_extract(url, '{_SHAPE}', 1)), ''), 'http'), '://', host,
             rtrim(regexp_extract(url, '{_SHAPE}', 3), '/'),
             CASE WHEN {_query("url")} <> '' THEN concat('?', {_query("url")}) ELSE '' END) AS normalised
    FROM hosts""")
def extracted_links(spark, sf):
    return links.link_rows(linked(spark, sf)).select(
        "msg_id", F.col("pos").alias("place"), "raw", "anchor", "host", "normalised")


@query("link_risk_flags", "P19 P20 P21 P22 P24 F8 F12", ctes=LINK_CTES, oracle="""
    SELECT msg_id, raw, is_ip, is_shortener, risky_tld, brand, nullif(redirect, '') AS redirect, claim,
           is_mismatched, array_to_string(findings, '; ') AS findings FROM link_findings""")
def link_risk_flags(spark, sf):
    return links.link_rows(linked(spark, sf)).select(
        "msg_id", "raw", "is_ip", "is_shortener", "risky_tld", F.col("lookalike").alias("brand"),
        "redirect", F.col("claims").alias("claim"), "is_mismatched",
        F.array_join("findings", "; ").alias("findings"))


@query("cross_site_redirects", "P23", ctes=LINK_CTES,
       oracle="SELECT msg_id, raw, leaves_site FROM flagged")
def cross_site_redirects(spark, sf):
    return links.link_rows(linked(spark, sf)).select("msg_id", "raw", "leaves_site")


@query("link_totals", "A5", ctes=LINK_CTES, oracle="""
    SELECT l.msg_id, CAST(count(f.raw) AS INT) AS total_urls,
           CAST(count(*) FILTER (len(f.findings) > 0) AS INT) AS suspicious_count,
           coalesce(string_agg(concat(f.raw, ': ', array_to_string(f.findings, '; ')), ' | '
             ORDER BY f.place) FILTER (len(f.findings) > 0), '') AS flags
    FROM linked l LEFT JOIN link_findings f ON f.msg_id = l.msg_id GROUP BY l.msg_id""")
def link_totals(spark, sf):
    return links.link_totals(linked(spark, sf)).withColumn("flags", F.array_join("flags", " | "))


@query("link_signals", "W10", ctes=LINK_CTES, oracle="SELECT msg_id, indicator, strength, weight FROM link_sig")
def link_signals(spark, sf):
    d = linked(spark, sf).select("msg_id", links.link_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "strength", "weight")


@query("link_search", "P67 F38 F40", ctes=LINK_CTES, oracle=f"""
    SELECT msg_id, raw, regexp_replace(regexp_replace(raw, '^[hH][tT][tT][pP]([sS]?)://', 'hxxp\\1://'),
             '^(hxxps?)://', '\\1[://]') AS defanged,
           coalesce(CASE WHEN is_ip THEN concat('ip:', host) END,
             CASE WHEN is_shortener THEN concat('shortener:', host) END,
             CASE WHEN host <> '' AND redirect <> '' THEN concat('redirect:', redirect) END) AS reason
    FROM flagged WHERE contains(lower(concat(url, ' ', anchor)), 'bit.ly') OR contains(lower(concat(url, ' ', anchor)), 'claims')
      OR contains(lower(concat(url, ' ', anchor)), '185.10')""")
def link_search(spark, sf):
    rows = links.link_rows(linked(spark, sf))
    hits = None
    for needle in ("BIT.ly", "claims", "185.10"):
        found = links.search_links(rows, needle)
        hits = found if hits is None else hits.union(found)
    return hits.distinct().select("msg_id", "raw", urls.defanged("raw").alias("defanged"),
                                  urls.risk_reason("url").alias("reason"))


# --- HTML ----------------------------------------------------------------------

_TOKEN = html.TOKEN
_RAW = ("regexp_replace(body_html, '(?is)(<!--.*?-->)|(<script\\b[^>]*>).*?(</script\\s*>)"
        "|(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2\\3\\4\\5', 'g')")


def _attr(x: str, name: str) -> str:
    return (f"regexp_replace(regexp_extract({x}, '(?is)[\\s\"''/]{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1), "
            "'^[\"'']|[\"'']$', '', 'g')")


def _css(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', '', 'g')"


_HIDING = html.HIDING
HTML_CTES = {
    "toks": f"""
        SELECT msg_id, generate_subscripts(m, 1) AS i, unnest(m) AS raw FROM (
          SELECT msg_id, regexp_extract_all({_RAW}, '{_TOKEN}') AS m FROM markup) z""",
    "tok": """
        SELECT *, CASE WHEN starts_with(raw, '<!--') THEN 'comment' WHEN regexp_matches(raw, '^<[!?]') THEN 'declaration'
            WHEN regexp_matches(raw, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(raw, '^<[a-zA-Z]') THEN 'open'
            ELSE 'text' END AS kind, lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM toks""",
    "sheet_rules": f"""
        SELECT msg_id, unnest(string_split({_css("sheet")}, '}}')) AS rule FROM (
          SELECT msg_id, unnest(regexp_extract_all(body_html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS sheet FROM markup) z""",
    "hidden_names": f"""
        SELECT DISTINCT msg_id, unnest(regexp_extract_all(split_part(rule, '{{', -2), '[.#][a-z0-9_-]+')) AS name
        FROM sheet_rules WHERE contains(rule, '{{') AND regexp_matches(split_part(rule, '{{', -1), '{_HIDING}')""",
    "hiders": f"""
        SELECT t.msg_id, t.i, t.tag FROM tok t WHERE t.kind = 'open'
          AND t.tag NOT IN ({o.quoted(fv.VOID_TAGS + fv.UNSTYLED_TAGS)})
          AND (regexp_matches({_css(_attr("t.raw", "style"))}, '{_HIDING}')
            OR regexp_matches({_css(_attr("t.raw", "style"))}, '(^|;)color:(#fff|white|#fefefe)')
            OR regexp_matches(t.raw, '(?i)\\shidden[\\s=/>]')
            OR {_attr("t.raw", "width")} IN ('0', '0px', '0%') OR {_attr("t.raw", "height")} IN ('0', '0px', '0%')
            OR EXISTS (SELECT 1 FROM hidden_names n WHERE n.msg_id = t.msg_id
                 AND (list_contains(list_transform(string_split(lower({_attr("t.raw", "class")}), ' '), lambda c: '.' || c), n.name)
                   OR n.name = '#' || lower({_attr("t.raw", "id")}))))""",
    "scopes": """
        SELECT h.msg_id, h.i AS lo, coalesce(min(c.i), 1000000000) AS hi
        FROM hiders h LEFT JOIN (
          SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (
            PARTITION BY msg_id, tag ORDER BY i) AS bal FROM tok WHERE kind IN ('open', 'close')) c
          ON c.msg_id = h.msg_id AND c.tag = h.tag AND c.i > h.i AND c.kind = 'close'
         AND c.bal < (SELECT sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) FROM tok x
                      WHERE x.msg_id = h.msg_id AND x.tag = h.tag AND x.i <= h.i)
        GROUP BY h.msg_id, h.i""",
    "texts": f"""
        SELECT t.msg_id, t.i, length(regexp_replace(regexp_replace(regexp_replace(raw, '&#?[a-zA-Z0-9]+;', 'x', 'g'),
            '&#?[a-zA-Z0-9]+;', 'x', 'g'), '[\\s\\x{{a0}}\\x{{ad}}]+', '', 'g')) AS chars,
          EXISTS (SELECT 1 FROM scopes s WHERE s.msg_id = t.msg_id AND t.i > s.lo AND t.i < s.hi) AS hid
        FROM tok t WHERE kind = 'text'""",
    "text_sums": """
        SELECT msg_id, coalesce(sum(chars) FILTER (hid), 0) AS hidden_chars,
               coalesce(sum(chars) FILTER (NOT hid), 0) AS visible_chars FROM texts GROUP BY msg_id""",
    "splits": """
        SELECT msg_id, count(*) AS n FROM (
          SELECT msg_id, kind, raw, lag(raw) OVER w AS before, lag(kind) OVER w AS kb,
                 lead(raw) OVER w AS after, lead(kind) OVER w AS ka FROM tok WINDOW w AS (PARTITION BY msg_id ORDER BY i)) z
        WHERE kind = 'comment' AND kb = 'text' AND ka = 'text' AND regexp_matches(before, '[\\p{L}\\p{N}]\\s*$')
          AND regexp_matches(after, '^[\\p{L}\\p{N}]') AND NOT regexp_matches(lower(raw), '^<!--\\s*(\\[if|<!\\[|\\[endif)|endif')
        GROUP BY msg_id""",
    "fields": f"""
        SELECT msg_id, CASE WHEN kind IN ({o.quoted(fv.SILENT_FIELD_TYPES)}) THEN 'silent' WHEN kind = 'password' THEN 'password'
            WHEN regexp_matches(words, '(?i){fv.STRONG_FIELD_PATTERN}') THEN 'strong'
            WHEN regexp_matches(words, '(?i){fv.IDENTITY_FIELD_PATTERN}') THEN 'identity' ELSE 'plain' END AS field
        FROM (SELECT msg_id, lower(coalesce(nullif({_attr("raw", "type")}, ''), CASE tag WHEN 'input' THEN 'text' ELSE tag END)) AS kind,
              concat_ws(' ', {", ".join(_attr("raw", n) for n in ("name", "id", "placeholder", "autocomplete", "aria-label"))}) AS words
              FROM tok WHERE kind = 'open' AND tag IN ('input', 'textarea', 'select')) z""",
    "opens": f"""
        SELECT msg_id, count(*) FILTER (tag = 'img') AS images, count(*) FILTER (tag = 'form') AS forms,
          count(*) FILTER (tag = 'script') AS scripts, count(*) FILTER (tag IN ('iframe', 'frame')) AS frames,
          count(*) FILTER (tag IN ('iframe', 'frame') AND (contains(raw, 'srcdoc')
            OR regexp_matches({_css(_attr("raw", "src"))}, '^(javascript:|vbscript:|data:text/html|data:application)'))) AS hostile_frames,
          count(*) FILTER (tag IN ('object', 'embed', 'applet')) AS active_objects,
          coalesce(sum(len(regexp_extract_all(raw, '(?i)[\\s"''/](on[a-z]+)\\s*='))), 0) AS event_handlers,
          count(*) FILTER (tag = 'meta' AND lower({_attr("raw", "http-equiv")}) = 'refresh') AS meta_refresh,
          count(*) FILTER (tag = 'form' AND regexp_matches(lower({_attr("raw", "action")}), '^(https?://|//|mailto:|ftp://)')) AS external_actions
        FROM tok WHERE kind = 'open' GROUP BY msg_id""",
    "uris": f"""
        SELECT msg_id, lower(unnest(regexp_extract_all(body_html, '{html.DATA_URI}', 1))) AS mime FROM markup""",
    "codes": """
        SELECT msg_id, CASE WHEN lower(e[1]) = 'x' THEN CAST(concat('0x', substr(e, 2)) AS INT) ELSE CAST(e AS INT) END AS code
        FROM (SELECT msg_id, unnest(regexp_extract_all(body_html, '(?i)&#(x[0-9a-f]{1,4}|[0-9]{1,5});', 1)) AS e FROM markup) z""",
    "counts": f"""
        SELECT m.msg_id, coalesce(s.hidden_chars, 0) AS hidden_chars, coalesce(s.visible_chars, 0) AS visible_chars,
          coalesce(c.n, 0) AS comment_splits,
          {", ".join(f"coalesce(o.{n}, 0) AS {n}" for n in ("images", "forms", "scripts", "frames", "hostile_frames",
            "active_objects", "event_handlers", "meta_refresh", "external_actions"))},
          (SELECT count(*) FROM fields f WHERE f.msg_id = m.msg_id AND field = 'password') AS password_fields,
          (SELECT count(*) FROM fields f WHERE f.msg_id = m.msg_id AND field = 'strong') AS strong_fields,
          (SELECT count(*) FROM fields f WHERE f.msg_id = m.msg_id AND field = 'identity') AS identity_fields,
          (SELECT count(*) FROM uris u WHERE u.msg_id = m.msg_id AND (mime IN ('text/html', 'text/xml', 'application/xhtml+xml')
             OR contains(mime, 'javascript'))) AS executable_uris,
          (SELECT count(*) FROM uris u WHERE u.msg_id = m.msg_id AND NOT (mime IN ('text/html', 'text/xml', 'application/xhtml+xml')
             OR contains(mime, 'javascript')) AND NOT regexp_matches(mime, '^(image|font|audio|video)/')) AS other_uris,
          len(regexp_extract_all(m.body_html, '{_sql(html.SCRIPT_URI)}')) AS script_uris,
          (SELECT count(*) FROM codes d WHERE d.msg_id = m.msg_id AND (code BETWEEN 48 AND 57 OR code BETWEEN 65 AND 90
             OR code BETWEEN 97 AND 122)) AS disguised_entities
        FROM markup m LEFT JOIN text_sums s ON s.msg_id = m.msg_id LEFT JOIN splits c ON c.msg_id = m.msg_id
        LEFT JOIN opens o ON o.msg_id = m.msg_id""",
    "html_hits": " UNION ALL ".join(
        f"SELECT msg_id, {i} AS rule, '{c}' AS category, '{s}' AS severity FROM counts WHERE {cond}"
        for i, (c, s, cond) in enumerate([
            ("hidden_text", "Low", "hidden_chars BETWEEN 1 AND 200"),
            ("hidden_text", "Medium", "hidden_chars > 200 AND hidden_chars < 600"),
            ("hidden_text", "High", "hidden_chars >= 600"),
            ("credential_form", "High", "password_fields > 0"),
            ("credential_form", "Medium", "password_fields = 0 AND strong_fields > 0"),
            ("form_credential_fields", "Medium", "password_fields + strong_fields = 0 AND identity_fields >= 2"),
            ("form_external_action", "Medium", "password_fields + strong_fields = 0 AND external_actions > 0"),
            ("meta_refresh", "High", "meta_refresh > 0"),
            ("iframe", "High", "hostile_frames > 0"),
            ("iframe", "Medium", "hostile_frames = 0 AND frames > 0"),
            ("script", "Medium", "scripts > 0"),
            ("active_content", "Medium", "active_objects > 0"),
            ("event_handler", "Medium", "event_handlers > 0"),
            ("comment_obfuscation", "Medium", "comment_splits > 0"),
            ("image_only_body", "Low", "images >= 1 AND visible_chars < 80"),
            ("data_uri_html", "High", "executable_uris > 0"),
            ("data_uri_other", "Medium", "executable_uris = 0 AND other_uris > 0"),
            ("javascript_uri", "High", "script_uris > 0"),
            ("entity_obfuscation", "Medium", "disguised_entities >= 20")])),
    "html_ranked": """
        SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY CASE severity WHEN 'High' THEN 0
            WHEN 'Medium' THEN 1 ELSE 2 END, rule) - 1 AS place FROM html_hits""",
    "html_weights": "SELECT * FROM (VALUES " + ", ".join(
        f"('{c}', '{s}', {w}, '{fv.HTML_INDICATORS[(c, s)]}')" for c, by in fv.HTML_WEIGHTS.items()
        for s, w in by.items()) + ") AS w(category, severity, weight, indicator)",
    "html_sig": """
        SELECT msg_id, 700 + rn AS seq, concat('HTML Forensics: ', indicator) AS indicator,
               CASE WHEN weight >= 18 THEN 'strong' ELSE 'weak' END AS strength,
               greatest(0, least(z.weight, 30 - used)) AS weight, severity, z.weight AS full_weight
        FROM (SELECT *, coalesce(sum(weight) OVER (PARTITION BY msg_id ORDER BY rn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
          SELECT r.msg_id, r.severity, w.weight, w.indicator,
                 row_number() OVER (PARTITION BY r.msg_id ORDER BY w.weight DESC, r.place) AS rn
          FROM html_ranked r JOIN html_weights w ON w.category = r.category AND w.severity = r.severity) y
          WHERE rn <= 4) z WHERE used < 30""",
}


def marked_up(spark, sf):
    d = view(spark, sf, "markup").withColumn("body_plain", F.lit(""))
    return html.with_html_findings(html.with_html_counts(html.with_tokens(d)))


@query("html_tokens", "B6", ctes=HTML_CTES,
       oracle="SELECT msg_id, kind, tag, count(*) AS n FROM tok GROUP BY msg_id, kind, tag")
def html_tokens(spark, sf):
    d = html.with_tokens(view(spark, sf, "markup"))
    return explode_rows(d, "html_tokens", "msg_id").groupBy("msg_id", "kind", "tag") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("html_counters", "A15 P41 P42", ctes=HTML_CTES,
       oracle="SELECT * EXCLUDE (hidden_chars, visible_chars) FROM counts")
def html_counters(spark, sf):
    return marked_up(spark, sf).select("msg_id", "html.*").drop("hidden_chars", "visible_chars")


@query("hidden_text", "B7", ctes=HTML_CTES,
       oracle="SELECT msg_id, hidden_chars, visible_chars FROM counts")
def hidden_text(spark, sf):
    return marked_up(spark, sf).select("msg_id", "html.hidden_chars", "html.visible_chars")


@query("html_findings", "P33 P34 P35 P36 P37 P38 P39 P40 P43 P44 O4", ctes=HTML_CTES,
       oracle="SELECT msg_id, place, category, severity FROM html_ranked")
def html_findings(spark, sf):
    return explode_rows(marked_up(spark, sf), "html_findings", "msg_id", pos="place") \
        .select("msg_id", "place", "category", "severity")


@query("html_signals", "W7", ctes=HTML_CTES,
       oracle="SELECT msg_id, indicator, strength, weight, severity FROM html_sig")
def html_signals(spark, sf):
    d = marked_up(spark, sf).select("msg_id", html.html_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "strength", "weight",
                                                 "severity")


# --- attachments ---------------------------------------------------------------

def _ext(x):
    return f"(CASE WHEN contains({x}, '.') THEN lower(split_part({x}, '.', -1)) ELSE '' END)"


_MAGIC = "CASE " + " ".join(f"WHEN starts_with(hex(content), '{m}') THEN '{t}'"
                            for m, t in fv.MAGIC_NUMBERS) + " ELSE 'unknown' END"
_ALLOWED = " OR ".join(f"(ext = '{e}' AND true_type NOT IN ({o.quoted(s)}))"
                       for e, s in fv.EXPECTED_SIGNATURES.items())
_MIME_EXT = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in fv.MIME_BY_EXTENSION.items()) + " END"
_MIME_SIG = "CASE true_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in fv.MIME_BY_SIGNATURE.items()) + " END"

ATTACH_CTES = {
    "att": f"SELECT *, {_ext('filename')} AS ext, {_MAGIC} AS true_type FROM attachments",
    # what each payload was built to contain
    "truth": """SELECT * FROM (VALUES
        ('bundle.zip', ['archive_encrypted', 'archive_contains_executable', 'archive_double_extension_entry', 'archive_nested']),
        ('report.docm', ['office_vba_macro']),
        ('old.xls', ['office_vba_macro']),
        ('plain.doc', ['legacy_office_no_macro']),
        ('terms.pdf', ['pdf_javascript', 'pdf_open_action']),
        ('locked.docx', ['office_encrypted', 'type_mismatch']),
        ('photo.png', ['type_mismatch'])) AS t(filename, features)""",
    "facts": f"""
        SELECT a.msg_id, a.pos, a.filename, a.ext, a.true_type, octet_length(a.content) AS size_bytes, a.content,
          coalesce(t.features, []) AS features,
          ext IN ({o.quoted(fv.EXECUTABLE_EXTENSIONS)}) OR true_type IN ('exe', 'elf') AS is_executable,
          ext IN ({o.quoted(fv.SCRIPT_EXTENSIONS)}) OR ext = 'lnk' OR true_type = 'lnk' AS is_script,
          coalesce(list_contains(t.features, 'office_vba_macro'), FALSE) OR ext IN ({o.quoted(fv.MACRO_EXTENSIONS)})
            OR (ext IN ('doc', 'xls') AND NOT coalesce(list_contains(t.features, 'legacy_office_no_macro'), FALSE)) AS is_macro,
          regexp_matches(lower(a.filename), '\\.({"|".join(fv.MASKING_EXTENSIONS)})\\.({"|".join(fv.RISKY_EXTENSIONS)})$') AS is_double_extension,
          list_has_any(coalesce(t.features, []), ['archive_encrypted', 'office_encrypted'])
            OR (ext = '7z' AND regexp_matches(lower(a.filename), '(^|[_\\W])(encrypted|protected|password)([_\\W]|$)')) AS is_encrypted,
          true_type <> 'unknown' AND ({_ALLOWED}) AS is_mismatched,
          coalesce({_MIME_EXT}, {_MIME_SIG}, 'application/octet-stream') AS mime_type
        FROM att a LEFT JOIN truth t ON t.filename = a.filename""",
    "named": f"""
        SELECT *, regexp_matches(lower(filename), '^[a-f0-9]{{8,64}}\\.[a-z0-9]+$') OR (
            len(list_filter({o.listed(fv.LURE_WORDS)}, lambda w: contains(lower(filename), w))) > 0
            AND (is_executable OR is_script OR is_macro OR is_double_extension OR ext IN ('zip','iso','img','cab')
                 OR len(features) > 0)) AS is_suspicious_name FROM facts""",
    "reasons": "\nUNION ALL ".join([
        "SELECT msg_id, filename, 35 AS w FROM named WHERE is_double_extension",
        f"SELECT msg_id, filename, 30 FROM named WHERE is_executable OR is_script OR ext IN ({o.quoted(fv.RISKY_EXTENSIONS)})",
        "SELECT msg_id, filename, 30 FROM named WHERE true_type = 'exe' AND ext NOT IN ('exe', 'dll', 'scr', 'com')",
        "SELECT msg_id, filename, 25 FROM named WHERE is_macro AND NOT list_contains(features, 'office_vba_macro')",
        "SELECT msg_id, filename, 20 FROM named WHERE is_encrypted AND NOT list_has_any(features, ['archive_encrypted', 'office_encrypted'])",
        "SELECT n.msg_id, n.filename, f.w FROM named n JOIN (VALUES " + ", ".join(
            f"('{k}', {w})" for k, w in fv.CONTENT_FEATURE_WEIGHTS.items())
        + ") AS f(feature, w) ON list_contains(n.features, f.feature)",
        "SELECT msg_id, filename, 10 FROM named WHERE is_suspicious_name"]),
    "att_sig": """
        SELECT msg_id, 800 AS seq, 'Executable / Suspicious Attachment' AS indicator,
               CASE WHEN max(w) >= 20 THEN 'strong' ELSE 'weak' END AS strength, max(w) AS weight,
               filename, count(*) AS n FROM reasons GROUP BY msg_id, filename""",
}


def attached(spark, sf):
    rows = view(spark, sf, "attachments").select(
        "msg_id", F.array(F.struct("pos", "filename", "content")).alias("attachments"))
    return attachments.with_attachments(rows)


@query("attachment_identity", "S8 F19 F20 P32 F36", ctes=ATTACH_CTES, oracle="""
    SELECT msg_id, filename, ext, true_type, size_bytes, md5(content) AS md5, sha1(content) AS sha1,
           sha256(content) AS sha256, mime_type,
           regexp_replace(filename, '[^a-zA-Z0-9_.-]', '', 'g') AS stored_as FROM facts""")
def attachment_identity(spark, sf):
    return attachments.attachment_rows(attached(spark, sf)).select(
        "msg_id", "filename", "ext", "true_type", "size_bytes", "md5", "sha1", "sha256",
        "mime_type", files.safe_filename("filename").alias("stored_as"))


@query("attachment_flags", "P25 P26 P27 P28 P29 P30 P31 U3", ctes=ATTACH_CTES, oracle="""
    SELECT msg_id, filename, is_executable, is_script, is_macro, is_double_extension, is_encrypted,
           is_mismatched, is_suspicious_name FROM named""")
def attachment_flags(spark, sf):
    return attachments.attachment_rows(attached(spark, sf)).select(
        "msg_id", "filename", "is_executable", "is_script", "is_macro", "is_double_extension",
        "is_encrypted", "is_mismatched", "is_suspicious_name")


@query("container_features", "B3 B4 B5", ctes=ATTACH_CTES, oracle="""
    SELECT msg_id, filename, array_to_string(list_sort(features), ',') AS features FROM facts""")
def container_features(spark, sf):
    return attachments.attachment_rows(attached(spark, sf)).select(
        "msg_id", "filename", F.array_join(F.array_sort("features"), ",").alias("features"))


@query("attachment_signals", "A4", ctes=ATTACH_CTES,
       oracle="SELECT msg_id, indicator, strength, weight FROM att_sig")
def attachment_signals(spark, sf):
    d = attached(spark, sf).select("msg_id", attachments.attachment_signals().alias("s"))
    return explode_rows(d, "s", "msg_id").select("msg_id", "indicator", "strength", "weight")
