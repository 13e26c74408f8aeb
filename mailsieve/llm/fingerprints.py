"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's items are its k-mers of words, each numbered by its occurrence.  ``TUPLES`` times, ``ORDER``
hash functions select their least item each; the selected items keep the order they have in the
text and are hashed together, so a signature changes when words change and also when they move.  Two
texts are as like as the share of signatures they have in common.

Hash and position of an item share one 64-bit number, so selection is a minimum of numbers that
combines in the scan; items of a document never leave its partition.  Only documents in which a
k-mer repeats need a window to number occurrences; both kinds give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.operators.scale import prefix_sums

from .common import stage_table

KMER = 5
TUPLES = 16
ORDER = 2
_PLACE_BITS = 26
_PLACE = (1 << _PLACE_BITS) - 1
_SPACE = "[ \\t-\\r]+"
EMPTY = "0" * 8 * TUPLES


def kmers(text: Column, k: int = KMER) -> Column:
    """Hashes of the k-mers of a text; a text of fewer words is one k-mer, one without has none."""
    words = F.transform(F.filter(F.split(text, _SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(hashed: Column) -> Column:
        n = F.size(hashed)
        whole = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashed, i + d) for d in range(k)]))
        return F.when(n >= k, whole).when(n > 0, F.array(F.xxhash64(hashed, n))).otherwise(
            F.array().cast("array<bigint>"))
    # bound once: the list of word hashes is built before it is read k times
    return F.element_at(F.transform(F.array(words), of), 1)


def _least() -> list[Column]:
    """Least item by each hash function; the item's place fills the low bits."""
    place = F.least(F.col("at").cast("long"), F.lit(_PLACE))
    return [F.min(F.xxhash64("item", F.lit(j)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)).alias(f"m{j}")
            for j in range(TUPLES * ORDER)]


def _signatures() -> Column:
    parts = []
    for t in range(TUPLES):
        chosen = F.array_sort(F.array(*[F.struct(
            F.col(f"m{j}").bitwiseAND(F.lit(_PLACE)).alias("at"), F.lit(j).alias("by"),
            F.shiftright(f"m{j}", _PLACE_BITS).alias("item")) for j in range(t * ORDER, (t + 1) * ORDER)]))
        tuple_ = F.transform(chosen, lambda x: F.struct(x["by"], x["item"]))
        parts.append(F.lpad(F.lower(F.hex(F.xxhash64(tuple_).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.concat(*parts)


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, version, fingerprint`` of each of the text ``columns`` that has a word.

    ``texts`` should be partitioned by the first key, which then is the only shuffle there is.
    """
    made = texts.select(*keys, *[kmers(F.col(c)).alias(f"_k{i}") for i, c in enumerate(columns)])
    lists = [F.col(f"_k{i}") for i in range(len(columns))]
    again = F.lit(False)
    for k in lists:
        again = again | (F.size(F.array_distinct(k)) < F.size(k))
    versions = F.explode(F.array(*[F.struct(F.lit(i).alias("version"), k.alias("kmers")) for i, k in enumerate(lists)]))

    def items(some: DataFrame) -> DataFrame:
        return some.select(*keys, versions.alias("v")).select(
            *keys, F.col("v.version").alias("version"), F.posexplode("v.kmers").alias("at", "kmer"))

    group = [*keys, "version"]
    once = items(made.where(~again)).withColumn("item", F.xxhash64("kmer", F.lit(1).cast("long")))
    nth = F.row_number().over(Window.partitionBy(*group, "kmer").orderBy("at")).cast("long")
    numbered = items(made.where(again)).withColumn("item", F.xxhash64("kmer", nth))
    least = once.groupBy(*group).agg(*_least()).unionByName(numbered.groupBy(*group).agg(*_least()))
    return least.select(*group, _signatures().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures of two fingerprints, 0 to 1."""
    same = F.filter(F.sequence(F.lit(0), F.lit(TUPLES - 1)),
                    lambda i: F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8)))
    return F.size(same) / F.lit(float(TUPLES))


def successors(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, next_id``: the next document by ascending id, after the last the first."""
    sized = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.lit(0).alias("_all"))
    ranked = stage_table(prefix_sums(sized, ["_all"], ["doc_id"], {"rank": F.lit(1)}).drop("_all"))
    many = ranked.count()
    after = ranked.select(F.col("doc_id").alias("next_id"), (F.col("rank")).alias("_at"))
    return stage_table(ranked.withColumn("_at", F.col("rank") % F.lit(max(1, many)) + 1).join(after, "_at")
                       .select("doc_id", "n_chars", "next_id"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how like they are.

    The edited text has the last quarter of the code points replaced by as many (or all) of the next
    document.  Takes ``doc_id, text``; a null text is empty, texts without a word have the fingerprint
    ``EMPTY``; rows without id are left out; of rows that repeat an id the least text counts; an
    empty table gives no rows; extra columns are ignored.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    follow = successors(docs)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = follow.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), quarter.alias("need"), "n_chars")
    heads = docs.join(wanted, "doc_id").select(
        F.col("for_id").alias("doc_id"), "n_chars", "need", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    both = docs.join(heads, "doc_id").select("doc_id", "n_chars", "text", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("need")).cast("int")), "head").alias("edited"))
    made = stage_table(fingerprints(both, ["doc_id"], ["text", "edited"]).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(n)
          for v, n in enumerate(["fingerprint", "edited_fingerprint"])]))
    facts = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own = facts.join(made, "doc_id", "left").join(follow.select("doc_id", "next_id"), "doc_id")
    theirs = made.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    filled = {n: F.coalesce(n, F.lit(EMPTY)) for n in ("fingerprint", "edited_fingerprint", "next_fingerprint")}
    return own.join(theirs, "next_id", "left").withColumns(filled).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
