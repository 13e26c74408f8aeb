"""Similarity join of hosts with brands from a table, by an index of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.base import let
from ..functions.identity import clean_host, fold_homoglyphs, registrable
from .scale import durable, salted_lookup

#: Groups over which the labels around one brand are spread.
SALTS = 8

#: A label of a host name has no more characters; longer brands are only met by equality.
LONGEST_LABEL = 63

#: Most edits between a label and a brand that it imitates.
EDITS = 2


def _shortened(word) -> Column:
    """All strings that lack one character of ``word``."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word, wide) -> Column:
    """Hashes of a word and, where ``wide``, of all strings that lack one or two of its characters.

    Words within two edits of each other share one of them.  ``wide`` words need three characters.
    """
    one = F.array_distinct(_shortened(word))
    two = let(lambda v: F.flatten(F.transform(v["one"], _shortened)), one=one)
    strings = F.when(wide, F.concat(F.array(word), one, two)).otherwise(F.array(word))
    return F.array_distinct(F.transform(strings, lambda s: F.xxhash64(s)))


def _first(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The first brand in order for each key; combined before the shuffle."""
    return rows.groupBy(key).agg(F.min(F.struct("pos", "brand")).alias(name))


def _imitated(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """(label, near): the first brand that each label imitates, by one or two edits or by homoglyphs."""
    typo = (F.length("brand") >= fv.BRAND_TYPO_MIN_LENGTH) & (F.length("brand") <= LONGEST_LABEL)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    index = brands.select("brand", "pos", F.explode(neighbourhood(F.col("brand"), typo)).alias("_key")) \
        .withColumn("_salt", F.explode(salts))
    size = F.length("word")
    wide = (size >= fv.BRAND_TYPO_MIN_LENGTH - EDITS) & (size <= LONGEST_LABEL + EDITS)
    asked = labels.withColumn("word", F.explode(F.array_distinct(F.array("label", "folded")))) \
        .withColumn("_key", F.explode(neighbourhood(F.col("word"), wide))) \
        .withColumn("_salt", F.pmod(F.xxhash64("label"), F.lit(SALTS)).cast("int"))
    near = typo & F.levenshtein("word", "brand", EDITS).between(1, EDITS)
    hits = asked.join(index, ["_key", "_salt"]).where(
        (F.col("label") != F.col("brand")) & ((F.col("folded") == F.col("brand")) | near))
    return _first(hits, "label", "near")


def _named(hosts: DataFrame, brands: DataFrame, exempt: list[str]) -> DataFrame:
    """(host, named): the first brand that is a whole token of each host, as written or folded."""
    words = F.split("host", r"[.\-_]+")
    tokens = F.array_distinct(F.concat(words, F.transform(words, fold_homoglyphs)))
    spoken = brands.where((F.length("brand") >= fv.BRAND_TOKEN_MIN_LENGTH) & ~F.col("brand").isin(exempt)) \
        .select(F.col("brand").alias("token"), F.struct("pos", "brand").alias("as_token"))
    asked = hosts.select("host", F.explode(tokens).alias("token")).where(F.length("token") >= fv.BRAND_TOKEN_MIN_LENGTH)
    return salted_lookup(asked, spoken, "token", "host").where("as_token IS NOT NULL") \
        .groupBy("host").agg(F.min("as_token").alias("named"))


def lookalikes(domains: DataFrame, brands: DataFrame, owned: DataFrame | None = None,
               column: str = "domain", exempt: list[str] = fv.BRAND_TOKEN_EXEMPT) -> DataFrame:
    """Rows of ``domains`` with ``imitated``, the brand that the host imitates, or null.

    Same rule as ``identity.lookalike_brand``, for any number of brands: ``brands`` has ``brand`` and ``pos``
    (the order in which brands win), ``owned`` has ``domain``: organisation domains that are genuine.  Hosts
    and labels are made distinct first.  A label meets only brands with which it shares a deletion of up to two
    characters; the distance then decides.  Null and empty hosts imitate nothing; null and empty brands are left
    out, of a brand's rows the least position counts, equal positions go by name.  Characters are code points.  A brand or label of
    over 63 characters, which no host name can have, is compared by equality and tokens only.  No row is lost
    or repeated, other columns are carried.
    """
    catalogue = durable(brands.where("brand <> ''").groupBy("brand").agg(F.min("pos").alias("pos")))
    hosts = domains.select(clean_host(column).alias("host")).where("host <> ''").distinct() \
        .withColumn("org", registrable("host")).withColumn("org_label", F.substring_index("org", ".", 1))
    genuine = catalogue.select(F.col("brand").alias("org_label"), F.lit(True).alias("_brand"))
    hosts = salted_lookup(hosts, genuine, "org_label", "host").where("_brand IS NULL")
    if owned is not None:
        own = owned.select(F.col("domain").alias("org")).distinct().withColumn("_own", F.lit(True))
        hosts = salted_lookup(hosts, own, "org", "host").where("_own IS NULL")
    hosts = durable(hosts.select("host", F.substring_index("host", ".", 1).alias("label")))
    labels = hosts.select("label").distinct().withColumn("folded", fold_homoglyphs("label"))
    found = salted_lookup(hosts, _imitated(labels, catalogue), "label", "host") \
        .join(_named(hosts, catalogue, exempt), "host", "left") \
        .select(F.col("host").alias("_host"), F.coalesce("near", "named")["brand"].alias("imitated")).where("imitated IS NOT NULL")
    # rows of one very common host are spread by their other columns
    return salted_lookup(domains.withColumns({"_host": clean_host(column), "_spread": F.xxhash64(*domains.columns)}),
                         found, "_host", "_spread").select(*domains.columns, "imitated")
