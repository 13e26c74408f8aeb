"""Markup stripping, entity decoding and the text that phrase rules read."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let, text

INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
INSIGNIFICANT = "[\\s\u00a0\u00ad\u200b-\u200f\u2028\u2029\u2060\ufeff]+"
# Runs of horizontal space other than one blank, which stays as it is.
HORIZONTAL_SPACE = "(?: [ \\t\\r\\f\\x0B\u00a0]|[\\t\\r\\f\\x0B\u00a0])[ \\t\\r\\f\\x0B\u00a0]*"

# Keeps comments and the script/style tags themselves, drops what the tags enclose.
RAW_BODIES = r"(?is)(<!--.*?-->)|(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)"


def without_raw_bodies(html) -> Column:
    return F.regexp_replace(text(html), RAW_BODIES, "$1$2$3$4$5")


def strip_markup(html, replacement: str = " ") -> Column:
    return _without_tags(_without_code(html), replacement)


def _without_code(html) -> Column:
    """Markup without scripts, style sheets and comments."""
    no_script = F.regexp_replace(text(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(no_script, r"(?s)<!--.*?-->", " ")


def _without_tags(markup, replacement: str) -> Column:
    return F.regexp_replace(markup, r"<[^>]+>", replacement)


_COMMON = {"amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;"}


def _named_entities() -> Column:
    # All HTML 5 names, taken from the standard library's table.  A map is searched from its start, so the usual
    # names, which also stand without a semicolon, come first.
    names = sorted((n for n in html5 if n.endswith(";")), key=lambda n: (n not in _COMMON, n[:-1] not in html5, n))
    pairs = "\u0002".join(f"{name}\u0001{html5[name]}" for name in names)
    return F.str_to_map(F.lit(pairs), F.lit("\u0002"), F.lit("\u0001"))


def _open_entities() -> tuple[Column, str]:
    # The names that also stand without a semicolon, and a pattern for the longest one.
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    pairs = "\u0002".join(f"{n}\u0001{html5[n]}" for n in names)
    return F.str_to_map(F.lit(pairs), F.lit("\u0002"), F.lit("\u0001")), f"^&({'|'.join(names)})"


def character(code: Column) -> Column:
    """One Unicode character from its code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(value) -> Column:
    """Character references of any length and all HTML 5 names, closed or not."""
    raw = text(value)
    pieces = F.regexp_extract_all(
        raw, F.lit(r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"), F.lit(0))
    names = _named_entities()
    open_names, longest = _open_entities()
    # Windows-1252 stands in for the control codes from 128 to 159
    western = F.lit("".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)))

    def decoded(piece: Column) -> Column:
        is_hex = F.lower(F.substring(piece, 3, 1)) == "x"
        digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
        short = F.when(F.length(digits) <= 8, F.when(digits == "", F.lit("0")).otherwise(digits))
        code = F.when(is_hex, F.conv(short, 16, 10)).otherwise(F.when(short.rlike("^[0-9]+$"), short)).cast("bigint")
        usable = (code > 0) & (code < 1114112) & ~code.between(55296, 57343)
        numeric = F.when(code.between(128, 159), F.substring(western, (code - 127).cast("int"), F.lit(1))) \
            .when(usable, character(code)).otherwise(F.lit("\ufffd"))
        closed = F.when(F.endswith(piece, F.lit(";")),
                        F.try_element_at(names, F.substring(piece, F.lit(2), F.length(piece))))
        name = F.regexp_extract(piece, longest, 1)
        opened = F.when(name != "", F.concat(
            F.try_element_at(open_names, name), F.substring(piece, F.length(name) + 2, F.length(piece))))
        return (F.when(F.startswith(piece, F.lit("&#")) & (F.length(piece) > 2), numeric)
                .when(F.startswith(piece, F.lit("&")) & (F.length(piece) > 1), F.coalesce(closed, opened, piece))
                .otherwise(piece))

    return F.when(F.contains(raw, F.lit("&")),
                  F.array_join(F.transform(pieces, decoded), "")).otherwise(raw)


def normalise(value) -> Column:
    """Decode entities, drop invisible separators, squeeze horizontal space."""
    def visible(v):    # plain ASCII holds nothing invisible
        return F.when(F.octet_length(v["t"]) == F.char_length(v["t"]), v["t"]).otherwise(
            F.regexp_replace(v["t"], INVISIBLE, ""))
    return F.regexp_replace(let(visible, t=decode_entities(value)), HORIZONTAL_SPACE, " ")


def match_text(body_plain, body_html) -> Column:
    """What a reader sees: plain part, spaced HTML text, and glued HTML text if new."""
    def joined(v):
        parts = F.filter(F.array(v["plain"], v["spaced"]), lambda p: p != "")
        return let(lambda w: F.array_join(
            F.when((v["glued"] == "") | F.array_contains(w["parts"], v["glued"]), w["parts"])
            .otherwise(F.array_append(w["parts"], v["glued"])), "\n"), parts=parts)

    def stripped(u):
        def seen(replacement):
            return F.when(u["markup"] != "", normalise(_without_tags(u["markup"], replacement))).otherwise(F.lit(""))
        return let(joined, plain=u["plain"], spaced=seen(" "), glued=seen(""))

    return let(stripped, plain=normalise(body_plain), markup=_without_code(body_html))


def meaningful_length(value) -> Column:
    return F.length(F.regexp_replace(text(value), INSIGNIFICANT, ""))


def first_phrase(required, pattern: str, *texts) -> Column:
    """First match of a pattern in the first of ``texts`` that has one, or NULL.

    ``texts`` are (column, lower-cased column) pairs.  The cheap substring tests run
    first, so the regular expression only sees texts that hold all of its words.
    """
    def search(value, lowered):
        present = F.contains(col(lowered), F.lit(required[0]))
        for word in required[1:]:
            present = present & F.contains(col(lowered), F.lit(word))
        return F.when(present, F.nullif(F.regexp_extract(value, f"(?iU){pattern}", 0), F.lit("")))

    return F.coalesce(*[search(value, lowered) for value, lowered in texts])
