"""Nothing is cut short: long names, padded files, long links, padded references."""

import html

from pyspark.sql import functions as F

from mailsieve.functions import files
from mailsieve.functions.text import decode_entities


def test_character_references(spark):
    texts = ["a &amp; b", "&#0000000000104;i", "&#x000000041;&#X42", "&colon;&Tab;&lpar;x", "&notit; &copy2020 &ampx",
             "&#150;&#x80;", "&#1114112; &#xD800;", "&#99999999999999;", "& &;&#; &#x;", "&lt&gt", "&bogus;", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_entities(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == {t: html.unescape(t) for t in texts}


def test_long_entry_name_and_padded_document(spark):
    name = b"a" * 600 + b".exe"
    archive = b"PK\x03\x04" + b"\x14\x00\x00\x00" + b"\0" * 18 + len(name).to_bytes(2, "little") + b"\0\0" + name + b"data"
    padded = b" " * 5000 + b"%PDF-1.7 /JavaScript "
    row = spark.createDataFrame([(bytearray(archive), bytearray(padded))], "a binary, p binary").select(
        files.zip_entries(F.col("a")).alias("e"), files.pdf_features(F.col("p")).alias("f")).first()
    assert [e.name for e in row.e] == [name.decode()]
    assert row.f
