"""The derived mail views as DataFrames."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import TABLES, VIEWS, needed

#: Messages of one partition of the mail views.  Rules cost time by message, not by byte, so partitions are
#: not sized by bytes.
MESSAGES = 8192
#: Tables that the mail views join, and the keys they are joined by.
_MAIL_KEYS = {"documents": "doc_id", "events": "event_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.table(_registered(spark, sf_dir, name))


def _registered(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Temporary view over one parquet table; its footer is read once per session."""
    alias = f"{name}__{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}"
    if not spark.catalog.tableExists(alias):
        _spread(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(alias)
    return alias


def _spread(spark: SparkSession, path: str) -> DataFrame:
    """A table whose scan gives fewer tasks than there are cores (one row group, say) is dealt
    to all of them; tables of many files or row groups keep the partitions these give."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Temporary view over a table of the mail views, dealt by its key to a number of partitions that grows
    with the messages.

    All sides of the joins are dealt alike, so their rows are spread evenly whichever side is broadcast and wherever
    the ids of the messages lie in the files; a fixed number is not merged again because the columns read are narrow.
    """
    alias = f"{_registered(spark, sf_dir, name)}__dealt"
    if not spark.catalog.tableExists(alias):
        table(spark, sf_dir, name).repartition(dealt_partitions(spark, sf_dir), _MAIL_KEYS[name]).createOrReplaceTempView(alias)
    return alias


def dealt_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the mail views."""
    messages = table(spark, sf_dir, "documents").count()
    return max(-(-messages // MESSAGES), spark.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view, as a plan over the parquet tables."""
    names = needed(f"SELECT * FROM {name}")
    sources = " ".join(VIEWS[n] for n in names)
    read = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", sources)]
    heavy = "mail" in names or name == "attachments"
    ctes = [f"{t} AS (SELECT * FROM {(_dealt if heavy and t in _MAIL_KEYS else _registered)(spark, sf_dir, t)})"
            for t in read]
    ctes += [f"{n} AS ({VIEWS[n]})" for n in names]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def _dimension(spark, sf_dir, name: str, key: str, *fields: str) -> DataFrame:
    """A fixed VALUES list as one array per key; a handful of rows, so it is broadcast."""
    rows = view(spark, sf_dir, name).groupBy(F.col(key).alias(f"_{name}")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *fields))).alias(name))
    return F.broadcast(rows)


def letters(spark: SparkSession, sf_dir: str, attachments: bool = True) -> DataFrame:
    """Messages in the engine's row shape.

    Header arrays are put together on the row from the fixed dimensions, as a parsed
    message would have them; no message is regrouped from child tables.
    """
    d = view(spark, sf_dir, "letters").withColumns({"cc_raw": F.lit(""), "bcc_raw": F.lit("")})
    for name, key, modulus, fields in (("hops_dim", "chain", 5, ["raw"]), ("ar_dim", "k", 6, ["tpl"]),
                                       ("quirks_dim", "k", 8, ["name", "value"])):
        d = d.join(_dimension(spark, sf_dir, name, key, *fields),
                   F.col("msg_id") % modulus == F.col(f"_{name}"), "left").drop(f"_{name}")
    none = F.expr("cast(array() as array<string>)")

    def filled(template):
        for mark, column in (("{spf}", "claimed_spf"), ("{dkim}", "claimed_dkim"),
                             ("{dmarc}", "claimed_dmarc"), ("{dom}", "claimed_domain")):
            template = F.replace(template, F.lit(mark), F.col(column))
        return template

    d = d.withColumns({
        "received_chain": F.coalesce(F.transform("hops_dim", lambda h: h["raw"]), none),
        "authentication_results": F.coalesce(
            F.transform("ar_dim", lambda a: filled(a["tpl"])), none)})

    def line(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    own = [("From", "from_raw"), ("To", "to_raw"), ("Sender", "sender_raw"),
           ("Reply-To", "reply_to_raw"), ("Return-Path", "return_path_raw"),
           ("Subject", "subject"), ("Message-ID", "message_id"), ("Date", "date")]
    quirks = F.coalesce(
        F.transform("quirks_dim", lambda q: F.struct(q["name"].alias("name"), q["value"].alias("value"))),
        F.expr("cast(array() as array<struct<name:string,value:string>>)"))
    lines = F.filter(F.concat(
        F.transform("received_chain", lambda r: line("Received", r)),
        F.transform("authentication_results", lambda r: line("Authentication-Results", r)),
        F.array(*[line(n, F.col(c)) for n, c in own]), quirks), lambda h: h["value"] != "")
    d = d.withColumn("headers", F.transform(lines, lambda h, i: F.struct(
        i.alias("pos"), h["name"].alias("name"), h["value"].alias("value")))) \
        .drop("hops_dim", "ar_dim", "quirks_dim")
    if not attachments:
        return d
    a = view(spark, sf_dir, "attachments").select("msg_id", F.array(
        F.struct("pos", "filename", "content")).alias("attachments"))
    return d.join(a, "msg_id", "left").withColumn("attachments", F.coalesce("attachments", F.expr(
        "cast(array() as array<struct<pos:int,filename:string,content:binary>>)")))
