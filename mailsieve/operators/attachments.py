"""Attachment rules: names, signatures and container contents, on the message's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files
from ..functions import fixed_values as fv
from ..functions.base import among, compact, explode_rows, extend
from ..functions.scores import signal

FAMILY = "attachment forensics"
INDICATOR = "Executable / Suspicious Attachment"


def _any_marker(content, names):
    hit = files.utf16_marker(content, names[0])
    for n in names[1:]:
        hit = hit | files.utf16_marker(content, n)
    return hit


def _bases(a, keep) -> Column:
    """Distinct file names in an archive that satisfy ``keep``."""
    bases = F.filter(F.transform(a["entries"], lambda e: files.base_name(e["name"])),
                     lambda b: (b != "") & keep(b))
    return F.when(F.coalesce(a["is_ooxml"], F.lit(False)), F.array().cast("array<string>")) \
        .otherwise(F.coalesce(F.array_distinct(bases), F.array().cast("array<string>")))


def analysed(rows: Column) -> Column:
    """Analyse an array of (filename, content, ...) structs; content is dropped."""
    def holds(entries, suffix):
        return F.coalesce(F.exists(entries, lambda e: F.endswith(F.lower(e["name"]), F.lit(suffix))),
                          F.lit(False))

    a = extend(
        rows,
        ext=lambda r: files.extension(r["filename"]),
        true_type=lambda r: files.true_type(r["content"]),
        size_bytes=lambda r: F.coalesce(F.octet_length(r["content"]), F.lit(0)),
        md5=lambda r: F.when(F.octet_length(r["content"]) > 0, F.md5(r["content"])),
        sha1=lambda r: F.when(F.octet_length(r["content"]) > 0, F.sha1(r["content"])),
        sha256=lambda r: F.when(F.octet_length(r["content"]) > 0, F.sha2(r["content"], 256)),
        entries=lambda r: files.zip_entries(r["content"]),
        pdf_features=lambda r: files.pdf_features(r["content"]))
    a = extend(
        a,
        is_ooxml=lambda r: holds(r["entries"], "[content_types].xml"),
        zip_macro=lambda r: holds(r["entries"], "vbaproject.bin"),
        zip_encrypted=lambda r: F.coalesce(F.exists(
            r["entries"], lambda e: e["flags"].bitwiseAND(F.lit(65)) != 0), F.lit(False)),
        is_ole=lambda r: r["true_type"] == "ole/doc-xls-ppt")
    a = extend(
        a,
        archive_read=lambda r: F.coalesce(F.size(r["entries"]) > 0, F.lit(False)),
        risky_entries=lambda r: _bases(
            r, lambda b: among(files.extension(b), fv.RISKY_EXTENSIONS)),
        nested_archives=lambda r: _bases(
            r, lambda b: among(files.extension(b), fv.NESTED_ARCHIVE_EXTENSIONS)),
        masked_entries=lambda r: _bases(r, files.double_extension),
        ole_macro=lambda r: r["is_ole"] & _any_marker(r["content"], fv.OLE_MACRO_NAMES),
        ole_encrypted=lambda r: r["is_ole"] & _any_marker(r["content"], fv.OLE_ENCRYPTION_NAMES),
        ole_read=lambda r: r["is_ole"] & _any_marker(
            r["content"], fv.OLE_MACRO_NAMES + fv.OLE_ENCRYPTION_NAMES + fv.OLE_ORDINARY_NAMES))
    a = extend(
        a,
        mime_type=lambda r: files.mime_type(r["filename"], r["true_type"]),
        is_executable=lambda r: among(r["ext"], fv.EXECUTABLE_EXTENSIONS)
        | r["true_type"].isin("exe", "elf"),
        is_script=lambda r: among(r["ext"], fv.SCRIPT_EXTENSIONS + ["lnk"])
        | (r["true_type"] == "lnk"),
        macro_seen=lambda r: r["zip_macro"] | r["ole_macro"],
        is_macro=lambda r: r["zip_macro"] | r["ole_macro"] | among(r["ext"], fv.MACRO_EXTENSIONS)
        | (among(r["ext"], fv.LEGACY_OFFICE_EXTENSIONS) & ~r["ole_read"]),
        is_double_extension=lambda r: files.double_extension(r["filename"]),
        is_encrypted=lambda r: r["zip_encrypted"] | r["ole_encrypted"]
        | (~r["archive_read"] & among(r["ext"], fv.ARCHIVE_EXTENSIONS)
           & files.encryption_word(r["filename"])),
        is_mismatched=lambda r: files.signature_mismatch(r["filename"], r["true_type"]))
    a = extend(a, features=lambda r: F.concat(
        compact(
            F.when(r["macro_seen"], F.lit("office_vba_macro")),
            F.when(~r["macro_seen"] & ~among(r["ext"], fv.MACRO_EXTENSIONS)
                   & among(r["ext"], fv.LEGACY_OFFICE_EXTENSIONS) & r["ole_read"],
                   F.lit("legacy_office_no_macro")),
            F.when(r["zip_encrypted"], F.lit("archive_encrypted"))
            .when(r["ole_encrypted"], F.lit("office_encrypted")),
            F.when(F.size(r["risky_entries"]) > 0, F.lit("archive_contains_executable")),
            F.when(F.size(r["masked_entries"]) > 0, F.lit("archive_double_extension_entry")),
            F.when(F.size(r["nested_archives"]) > 0, F.lit("archive_nested"))),
        r["pdf_features"],
        compact(F.when(r["is_mismatched"], F.lit("type_mismatch")))))
    a = extend(a, is_suspicious_name=lambda r: files.hash_like_name(r["filename"]) | (
        files.lure_word(r["filename"]).isNotNull()
        & (r["is_executable"] | r["is_script"] | r["is_macro"] | r["is_double_extension"]
           | among(r["ext"], fv.LURE_CONTAINER_EXTENSIONS) | (F.size(r["features"]) > 0))))
    a = extend(a, reasons=_reasons)
    return F.transform(a, lambda r: r.dropFields("content"))


def _reasons(r) -> Column:
    """(weight, reason) pairs in rule order."""
    def why(cond, weight, name):
        return F.when(cond, F.struct(F.lit(weight).alias("weight"), F.lit(name).alias("reason")))

    risky = r["is_executable"] | among(r["ext"], fv.RISKY_EXTENSIONS)
    weights = F.create_map(*[F.lit(x) for kv in fv.CONTENT_FEATURE_WEIGHTS.items() for x in kv])
    seen = r["features"]
    named = compact(
        why(r["is_double_extension"], 35, "double extension"),
        why(risky, 30, "executable payload"),
        why(~risky & r["is_script"], 30, "script payload"),
        why((r["true_type"] == "exe") & ~r["ext"].isin("exe", "dll", "scr", "com"), 30,
            "executable under another extension"),
        why(r["is_macro"] & ~r["macro_seen"], 25, "macro document"),
        why(r["is_encrypted"] & ~F.array_contains(seen, "archive_encrypted")
            & ~F.array_contains(seen, "office_encrypted"), 20, "password protected"))
    content = F.transform(
        F.filter(seen, lambda f: F.try_element_at(weights, f).isNotNull()),
        lambda f: F.struct(F.element_at(weights, f).alias("weight"), f.alias("reason")))
    return F.concat(named, content, compact(why(r["is_suspicious_name"], 10, "lure filename")))


def with_attachments(messages: DataFrame) -> DataFrame:
    """Replace raw attachments and inline images by their analysed form."""
    return messages.withColumn("attachments", analysed(F.col("attachments")))


def attachment_rows(messages: DataFrame) -> DataFrame:
    return explode_rows(messages.withColumn("attachments", F.transform(
        "attachments", lambda a: a.dropFields("pos"))), "attachments", "msg_id", pos="pos")


def attachment_signals() -> Column:
    def one(a):
        weight = F.array_max(F.transform(a["reasons"], lambda r: r["weight"]))
        detail = F.array_join(F.transform(a["reasons"], lambda r: r["reason"]), "; ")
        return signal(INDICATOR, weight,
                      F.when(weight >= 20, F.lit("strong")).otherwise(F.lit("weak")),
                      F.concat(a["filename"], F.lit(": "), detail), FAMILY)
    return F.transform(F.filter("attachments", lambda a: F.size(a["reasons"]) > 0), one)
