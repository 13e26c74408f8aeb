"""File names, signatures and container markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import among, col, string_array, text
from . import fixed_values as fv


def extension(filename) -> Column:
    name = text(filename)
    return F.when(F.contains(name, F.lit(".")),
                  F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def double_extension(filename) -> Column:
    """Document-like extension in front of a risky one; at least a third part in front."""
    name = F.lower(text(filename))
    parts = F.split(name, r"\.")
    return ((F.size(parts) >= 3)
            & among(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), fv.MASKING_EXTENSIONS)
            & among(F.substring_index(name, ".", -1), fv.RISKY_EXTENSIONS))


def true_type(content) -> Column:
    """Type by leading bytes, first signature in order."""
    data = col(content)
    label = None
    for magic, name in fv.MAGIC_NUMBERS:
        hit = F.startswith(data, F.unhex(F.lit(magic)))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise("unknown")


def mime_type(filename, true_type_) -> Column:
    by_ext = F.create_map(*[F.lit(x) for kv in fv.MIME_BY_EXTENSION.items() for x in kv])
    by_sig = F.create_map(*[F.lit(x) for kv in fv.MIME_BY_SIGNATURE.items() for x in kv])
    return F.coalesce(F.try_element_at(by_ext, extension(filename)),
                      F.try_element_at(by_sig, col(true_type_)), F.lit(fv.MIME_FALLBACK))


def signature_mismatch(filename, true_type_) -> Column:
    """The extension is one with known signatures and the bytes carry another one."""
    ext, sig = extension(filename), col(true_type_)
    allowed = None
    for e, sigs in fv.EXPECTED_SIGNATURES.items():
        hit = F.when(ext == e, ~sig.isin(sigs)) if allowed is None \
            else allowed.when(ext == e, ~sig.isin(sigs))
        allowed = hit
    return (sig != "unknown") & (sig != "") & allowed.otherwise(False)


def safe_filename(filename) -> Column:
    base = F.substring_index(text(filename), "/", -1)
    kept = F.regexp_replace(base, r"[^a-zA-Z0-9_.-]", "")
    return F.when(kept == "", F.lit("uploaded_message.eml")).otherwise(kept)


def lure_word(filename) -> Column:
    name = F.lower(text(filename))
    return F.get(F.filter(string_array(fv.LURE_WORDS), lambda w: F.contains(name, w)), F.lit(0))


def hash_like_name(filename) -> Column:
    return F.lower(text(filename)).rlike(r"^[a-f0-9]{8,64}\.[a-z0-9]+$")


def encryption_word(filename) -> Column:
    return F.lower(text(filename)).rlike(r"(?:^|[_\W])(?:encrypted|protected|password)(?:[_\W]|$)")


def zip_entries(content) -> Column:
    """array<struct<name, flags>> read from the local headers of a ZIP container.

    The bytes are viewed as Latin-1 text, so every byte is one character.
    """
    latin = F.decode(col(content), "ISO-8859-1")
    pieces = F.split(latin, "PK\x03\x04", -1)
    heads = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def low_high(head, at):
        return (F.ascii(F.substring(head, at, 1)).cast("int")
                + 256 * F.ascii(F.substring(head, at + 1, 1)).cast("int"))

    def entry(head):
        length = low_high(head, 23)
        return F.struct(
            head.substr(F.lit(27), length).alias("raw_name"),
            length.alias("name_length"),
            low_high(head, 3).alias("flags"))

    entries = F.filter(F.transform(heads, entry), lambda e: (
        (e["name_length"] > 0) & (F.length(e["raw_name"]) == e["name_length"])
        & ~e["raw_name"].rlike(r"[\x00-\x1f\x7f]")))
    named = F.transform(entries, lambda e: F.struct(
        e["raw_name"].alias("name"), e["flags"].alias("flags")))
    return F.when(F.startswith(col(content), F.unhex(F.lit("504B"))), named)


def base_name(path) -> Column:
    return F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1)


def utf16_marker(content, name: str) -> Column:
    return F.contains(col(content), F.unhex(F.lit(name.encode("utf-16-le").hex())))


def pdf_features(content) -> Column:
    latin = F.decode(col(content), "ISO-8859-1")
    is_pdf = F.contains(latin, F.lit("%PDF-")) | F.startswith(latin, F.lit("%PDF"))
    found = [F.when(latin.rlike(p), F.lit(key)) for key, p in fv.PDF_FEATURES]
    return F.when(is_pdf, F.array_compact(F.array(*found))) \
        .otherwise(F.expr("cast(array() as array<string>)"))
