"""HTML body rules over a token array.

The body is cut into comments, tags and text by one regular expression.  Counters
come from filters over the tag tokens; hidden text needs the nesting of elements
and is one fold over the tokens that carries a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.base import among, compact, strip, text
from ..functions.scores import signal, take_within
from ..functions.text import decode_entities, meaningful_length, without_raw_bodies

FINDING = "struct<category:string,severity:string,indicator:string,evidence:string>"
FAMILY = "html body forensics"

TOKEN = r"(?s)<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<"
HIDING = "|".join(fv.HIDING_STYLES)
DATA_URI = r"(?i)data:([a-z0-9][a-z0-9!#$&^_+./-]*)?\s*[;,]"
MEDIA_TYPE = r"(?i)^(image|font|audio|video)/"
SCRIPT_URI = (r"""(?i)(?:href|src|action|formaction|background|data|xlink:href)\s*=\s*["']?\s*"""
              r"""(?:javascript|vbscript):""")
NUMERIC_ENTITY = r"(?i)&#(x[0-9a-f]{1,4}|[0-9]{1,5});"
EXECUTABLE_MEDIA = ["text/html", "text/xml", "application/xhtml+xml", "image/svg+xml"]


def attribute(tag, name: str) -> Column:
    """Value of an attribute in a tag token, NULL when absent."""
    quoted = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract(tag, quoted, 1)
    return F.when(found != "", F.regexp_replace(found, r"""^["']|["']$""", ""))


def has_attribute(tag, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}[\s=/>]")


def css(value) -> Column:
    """Lower-case style text without comments and white space."""
    plain = F.regexp_replace(F.lower(text(value)), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(plain, r"\s+", "")


def is_white(colour) -> Column:
    hit = F.startswith(colour, F.lit(fv.WHITE_COLOURS[0]))
    for c in fv.WHITE_COLOURS[1:]:
        hit = hit | F.startswith(colour, F.lit(c))
    return hit


def hidden_selectors(html) -> Column:
    """'.class' and '#id' names that a style sheet in the body hides."""
    sheets = F.regexp_extract_all(text(html), F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    rules = F.filter(F.flatten(F.transform(sheets, lambda s: F.split(css(s), r"\}"))),
                     lambda r: F.contains(r, F.lit("{")))
    hiding = F.filter(rules, lambda r: F.substring_index(r, "{", -1).rlike(HIDING))
    return F.array_distinct(F.flatten(F.transform(hiding, lambda r: F.regexp_extract_all(
        F.substring_index(F.substring_index(r, "{", -2), "{", 1),
        F.lit(r"([.#][a-z0-9_-]+)"), F.lit(1)))))


def _token(tok) -> Column:
    kind = (F.when(F.startswith(tok, F.lit("<!--")), F.lit("comment"))
            .when(tok.rlike(r"^<[!?]"), F.lit("declaration"))
            .when(tok.rlike(r"^</[a-zA-Z]"), F.lit("close"))
            .when(tok.rlike(r"^<[a-zA-Z]"), F.lit("open"))
            .otherwise(F.lit("text")))
    return F.struct(kind.alias("kind"),
                    F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("tag"),
                    tok.alias("raw"))


def with_tokens(messages: DataFrame) -> DataFrame:
    """Add ``html_tokens`` (kind, tag, raw) of the whole HTML part."""
    pieces = F.regexp_extract_all(without_raw_bodies("body_html"), F.lit(TOKEN), F.lit(0))
    return messages.withColumn("html_tokens", F.transform(pieces, _token))


def _styled(selectors):
    """Per-token facts the fold needs."""
    def facts(t):
        tag, raw = t["tag"], t["raw"]
        style = css(attribute(raw, "style"))
        ground = F.coalesce(
            F.nullif(F.regexp_extract(style, r"(?:^|;)background(?:-color)?:([^;]+)", 1), F.lit("")),
            css(attribute(raw, "bgcolor")))
        hidden_attr = has_attribute(raw, "hidden") & F.lower(strip(F.coalesce(
            attribute(raw, "hidden"), F.lit("")))).isin("", "hidden", "true")
        zero = F.lower(strip(text(attribute(raw, "width")))).isin("0", "0px", "0%") \
            | F.lower(strip(text(attribute(raw, "height")))).isin("0", "0px", "0%")
        names = F.concat(
            F.transform(F.split(F.lower(text(attribute(raw, "class"))), r"\s+"),
                        lambda c: F.concat(F.lit("."), c)),
            F.array(F.concat(F.lit("#"), F.lower(strip(text(attribute(raw, "id")))))))
        by_sheet = (F.size(selectors) > 0) & F.arrays_overlap(names, selectors)
        styleable = ~among(tag, fv.UNSTYLED_TAGS)
        carries = (t["kind"] == "open") & F.contains(raw, F.lit(" "))
        colour = F.regexp_extract(style, r"(?:^|;)color:([^;]+)", 1)
        return F.struct(
            t["kind"].alias("kind"), tag.alias("tag"),
            (F.when(carries & styleable, style.rlike(HIDING) | hidden_attr | zero | by_sheet)
             .otherwise(F.lit(False))).alias("hides"),
            F.when(carries & styleable, is_white(colour)).otherwise(F.lit(False)).alias("white"),
            F.when(carries & ~among(ground, fv.TRANSPARENT_COLOURS), ground).alias("ground"),
            F.when(t["kind"] == "text", meaningful_length(decode_entities(raw)))
            .otherwise(0).alias("chars"),
            F.when(t["kind"] == "text", raw.rlike(r"^[\p{L}\p{N}]")).otherwise(
                F.lit(False)).alias("starts_word"),
            F.when(t["kind"] == "text", F.when(strip(raw) == "", None).otherwise(
                raw.rlike(r"[\p{L}\p{N}]\s*$"))).alias("ends_word"),
            ((t["kind"] == "comment") & F.lower(raw).rlike(r"^<!--\s*(\[if|<!\[|\[endif)|endif"))
            .alias("conditional"))
    return facts


STATE = ("struct<stack:array<struct<tag:string,hidden:boolean,ground:string>>,"
         "hidden:int,visible:int,tail:boolean,pending:boolean,splits:int>")


def _fold(acc, t) -> Column:
    stack = acc["stack"]
    top = F.get(stack, F.size(stack) - 1)
    ground = F.coalesce(t["ground"], top["ground"], F.lit("#ffffff"))
    hides = t["hides"] | (t["white"] & is_white(ground))
    opened = F.when(among(t["tag"], fv.VOID_TAGS), stack).otherwise(F.array_append(stack, F.struct(
        t["tag"].alias("tag"), hides.alias("hidden"), ground.alias("ground"))))
    place = F.array_position(F.reverse(F.transform(stack, lambda s: s["tag"])), t["tag"])
    closed = F.when(place > 0, F.slice(stack, F.lit(1), (F.size(stack) - place).cast("int"))) \
        .otherwise(stack)
    cloaked = F.exists(stack, lambda s: s["hidden"])
    is_text, is_comment = t["kind"] == "text", t["kind"] == "comment"
    is_tag = t["kind"].isin("open", "close")
    split = is_text & acc["pending"] & acc["tail"] & t["starts_word"]

    def build(new_stack, hidden, visible, tail, pending, splits):
        return F.struct(new_stack.alias("stack"), hidden.alias("hidden"), visible.alias("visible"),
                        tail.alias("tail"), pending.alias("pending"), splits.alias("splits"))

    no = F.lit(False)
    return (
        F.when(is_text, build(
            stack, acc["hidden"] + F.when(cloaked, t["chars"]).otherwise(0),
            acc["visible"] + F.when(cloaked, 0).otherwise(t["chars"]),
            F.coalesce(t["ends_word"], acc["tail"]), no,
            acc["splits"] + F.when(split, 1).otherwise(0)))
        .when(is_comment, build(
            stack, acc["hidden"], acc["visible"], acc["tail"] & ~t["conditional"],
            acc["tail"] & ~t["conditional"], acc["splits"]))
        .when(is_tag, build(
            F.when(t["kind"] == "open", opened).otherwise(closed),
            acc["hidden"], acc["visible"], no, no, acc["splits"]))
        .otherwise(acc)).cast(STATE)


def with_html_counts(messages: DataFrame) -> DataFrame:
    """Add ``html``: a struct of counters over the token array."""
    d = messages.withColumn("hidden_selectors", hidden_selectors("body_html"))
    d = d.withColumn("_styled", F.transform("html_tokens", _styled(F.col("hidden_selectors"))))
    start = F.struct(
        F.expr("cast(array() as array<struct<tag:string,hidden:boolean,ground:string>>)")
        .alias("stack"),
        F.lit(0).alias("hidden"), F.lit(0).alias("visible"), F.lit(False).alias("tail"),
        F.lit(False).alias("pending"), F.lit(0).alias("splits")).cast(STATE)
    d = d.withColumn("_walk", F.aggregate("_styled", start, _fold))
    d = d.withColumn("_open", F.filter("html_tokens", lambda t: t["kind"] == "open"))

    def raws(*tags):
        return F.transform(F.filter("_open", lambda t: t["tag"].isin(*tags)), lambda t: t["raw"])

    def count(array, predicate):
        return F.size(F.filter(array, predicate))

    frames, fields = raws("iframe", "frame"), raws("input", "textarea", "select")

    def field(f):
        tag = F.lower(F.regexp_extract(f, r"^<([a-zA-Z]+)", 1))
        kind = F.lower(strip(F.coalesce(
            F.nullif(attribute(f, "type"), F.lit("")),
            F.when(tag == "input", F.lit("text")).otherwise(tag))))
        words = F.concat_ws(" ", *[F.coalesce(attribute(f, n), F.lit("")) for n in
                                   ("name", "id", "placeholder", "autocomplete", "aria-label")])
        return (F.when(among(kind, fv.SILENT_FIELD_TYPES), F.lit("silent"))
                .when(kind == "password", F.lit("password"))
                .when(words.rlike("(?i)" + fv.STRONG_FIELD_PATTERN), F.lit("strong"))
                .when(words.rlike("(?i)" + fv.IDENTITY_FIELD_PATTERN), F.lit("identity"))
                .otherwise(F.lit("plain")))

    d = d.withColumn("_fields", F.transform(fields, field))

    def hostile(f):
        source = css(F.coalesce(F.nullif(attribute(f, "src"), F.lit("")), attribute(f, "srcdoc")))
        return source.rlike(r"^(javascript:|vbscript:|data:text/html|data:application)") \
            | has_attribute(f, "srcdoc")

    external = F.filter(raws("form"), lambda f: F.lower(strip(
        text(attribute(f, "action")))).rlike(r"^(https?://|//|mailto:|ftp://)"))
    refresh = count(raws("meta"),
                    lambda m: F.lower(strip(text(attribute(m, "http-equiv")))) == "refresh")
    handlers = F.flatten(F.transform("_open", lambda t: F.regexp_extract_all(
        t["raw"], F.lit(r"""(?i)[\s"'/](on[a-z]+)\s*="""), F.lit(1))))
    source = text("body_html")
    uris = F.transform(F.regexp_extract_all(source, F.lit(DATA_URI), F.lit(1)), lambda u: F.lower(u))
    payloads = F.filter(uris, lambda u: ~u.rlike(MEDIA_TYPE))

    def runs(u):
        return u.isin(EXECUTABLE_MEDIA) | F.contains(u, F.lit("javascript")) \
            | F.contains(u, F.lit("ecmascript"))

    def alnum_code(e):
        code = F.when(F.lower(F.substring(e, 1, 1)) == "x",
                      F.conv(F.substring(e, 2, 8), 16, 10).cast("int")).otherwise(
            e.try_cast("int"))
        return code.between(48, 57) | code.between(65, 90) | code.between(97, 122)

    return d.withColumn("html", F.struct(
        F.col("_walk")["hidden"].alias("hidden_chars"),
        F.col("_walk")["visible"].alias("visible_chars"),
        F.col("_walk")["splits"].alias("comment_splits"),
        F.size(raws("img")).alias("images"),
        F.size(raws("form")).alias("forms"),
        F.size(raws("script")).alias("scripts"),
        F.size(frames).alias("frames"),
        count(frames, hostile).alias("hostile_frames"),
        F.size(raws("object", "embed", "applet")).alias("active_objects"),
        F.size(handlers).alias("event_handlers"),
        refresh.alias("meta_refresh"),
        F.size(external).alias("external_actions"),
        count("_fields", lambda f: f == "password").alias("password_fields"),
        count("_fields", lambda f: f == "strong").alias("strong_fields"),
        count("_fields", lambda f: f == "identity").alias("identity_fields"),
        count(payloads, runs).alias("executable_uris"),
        count(payloads, lambda u: ~runs(u)).alias("other_uris"),
        F.size(F.regexp_extract_all(source, F.lit(SCRIPT_URI), F.lit(0))).alias("script_uris"),
        count(F.regexp_extract_all(source, F.lit(NUMERIC_ENTITY), F.lit(1)), alnum_code)
        .alias("disguised_entities"),
    )).drop("_styled", "_walk", "_open", "_fields", "hidden_selectors")


def with_html_findings(messages: DataFrame) -> DataFrame:
    """Add ``html_findings``, most severe first, rule order within a severity."""
    h = F.col("html")

    def finding(cond, category, severity, evidence):
        return F.when(cond, F.struct(
            F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(fv.HTML_INDICATORS[(category, severity)]).alias("indicator"),
            F.concat(*[F.lit(e) if isinstance(e, str) else e.cast("string") for e in evidence])
            .alias("evidence")))

    hid = h["hidden_chars"]
    hidden_ev = ["hidden=", hid, " visible=", h["visible_chars"]]
    secrets = h["password_fields"] + h["strong_fields"]
    form_ev = ["secret fields=", secrets, " forms=", h["forms"]]
    frames = h["frames"]
    rules = [
        finding((hid > 0) & (hid <= fv.PREHEADER_CHARS), "hidden_text", "Low", hidden_ev),
        finding((hid > fv.PREHEADER_CHARS) & (hid < fv.HIDDEN_HIGH_CHARS),
                "hidden_text", "Medium", hidden_ev),
        finding(hid >= fv.HIDDEN_HIGH_CHARS, "hidden_text", "High", hidden_ev),
        finding(h["password_fields"] > 0, "credential_form", "High", form_ev),
        finding((h["password_fields"] == 0) & (h["strong_fields"] > 0),
                "credential_form", "Medium", form_ev),
        finding((secrets == 0) & (h["identity_fields"] >= fv.MIN_CREDENTIAL_FIELDS),
                "form_credential_fields", "Medium", ["identity fields=", h["identity_fields"]]),
        finding((secrets == 0) & (h["external_actions"] > 0), "form_external_action", "Medium",
                ["external actions=", h["external_actions"]]),
        finding(h["meta_refresh"] > 0, "meta_refresh", "High", ["refresh=", h["meta_refresh"]]),
        finding(h["hostile_frames"] > 0, "iframe", "High", ["frames=", frames]),
        finding((h["hostile_frames"] == 0) & (frames > 0), "iframe", "Medium",
                ["frames=", frames]),
        finding(h["scripts"] > 0, "script", "Medium", ["scripts=", h["scripts"]]),
        finding(h["active_objects"] > 0, "active_content", "Medium",
                ["objects=", h["active_objects"]]),
        finding(h["event_handlers"] > 0, "event_handler", "Medium",
                ["handlers=", h["event_handlers"]]),
        finding(h["comment_splits"] > 0, "comment_obfuscation", "Medium",
                ["split words=", h["comment_splits"]]),
        finding((h["images"] >= 1) & (h["visible_chars"] < fv.IMAGE_ONLY_TEXT_CHARS)
                & (meaningful_length("body_plain") < fv.IMAGE_ONLY_PLAIN_CHARS),
                "image_only_body", "Low", ["images=", h["images"]]),
        finding(h["executable_uris"] > 0, "data_uri_html", "High",
                ["payloads=", h["executable_uris"]]),
        finding((h["executable_uris"] == 0) & (h["other_uris"] > 0), "data_uri_other", "Medium",
                ["payloads=", h["other_uris"]]),
        finding(h["script_uris"] > 0, "javascript_uri", "High", ["uris=", h["script_uris"]]),
        finding(h["disguised_entities"] >= fv.MIN_OBFUSCATED_ENTITIES, "entity_obfuscation",
                "Medium", ["references=", h["disguised_entities"]]),
    ]
    ranks = F.create_map(*[F.lit(x) for kv in fv.HTML_SEVERITY_ORDER.items() for x in kv])
    found = F.transform(compact(*rules), lambda f, i: F.struct(
        F.element_at(ranks, f["severity"]).alias("rank"), i.alias("i"), f.alias("f")))
    has_body = strip(text("body_html")) != ""
    return messages.withColumn("html_findings", F.when(
        has_body, F.transform(F.array_sort(found), lambda x: x["f"]))
        .otherwise(F.expr("array()")).cast(f"array<{FINDING}>"))


def html_weight(category, severity) -> Column:
    listed = F.create_map(*[F.lit(x) for c, by in fv.HTML_WEIGHTS.items()
                            for s, w in by.items() for x in (f"{c}/{s}", w)])
    default = F.create_map(*[F.lit(x) for kv in fv.HTML_DEFAULT_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(listed, F.concat(category, F.lit("/"), severity)),
                      F.try_element_at(default, severity), F.lit(0))


def html_signals() -> Column:
    def one(f):
        weight = html_weight(f["category"], f["severity"])
        return signal(F.concat(F.lit("HTML Forensics: "), f["indicator"]), weight,
                      F.when(weight >= fv.HTML_STRONG_WEIGHT, F.lit("strong"))
                      .otherwise(F.lit("weak")),
                      f["evidence"], FAMILY, severity=f["severity"])
    return take_within(F.transform("html_findings", one), fv.MAX_HTML_SCORE, fv.MAX_HTML_SIGNALS)
