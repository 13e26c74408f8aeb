"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, common, fingerprints, langid, merkle, neardup, negatives, online, packing, secrets, substrings,
               suffixes, vafile)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = secrets.train(secrets.samples_from(docs).unionByName(secrets.random_strings(spark)))
    return secrets.digest(secrets.scan(docs, model))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.documents(spark, sf_dir), bpe.default_vocabulary())


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(common.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(common.documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(common.documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.integer_vectors(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), bpe.default_vocabulary())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.documents(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    check = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chat.CHECK_TEXT).alias("text"))
    return chat.digest(chat.format_paths(chat.chain(turns.unionByName(check))))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = langid.is_held_out(F.col("doc_id"))
    langs, net = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), langs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def tampered() -> Column:
    """Rows whose id's crc32 five divides; none without id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(common.read(spark, sf_dir, "documents", *merkle.FIELDS), tampered())


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.pack(common.documents(spark, sf_dir), bpe.default_vocabulary())


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(rows.withColumn("label", moved))
    return negatives.mine(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_bpe, op3_substrings, op4_suffixes, op5_fingerprints, op6_top_k, op7_packing, op8_near_duplicates, op9_chat, op10_language, op11_manifest, op12_windows,
                                op13_negatives)}
ORACLES: dict[str, str] = {"op6_top_k": vafile.ORACLE, "op9_chat": chat.ORACLE, "op11_manifest": merkle.ORACLE, "op13_negatives": negatives.ORACLE}
