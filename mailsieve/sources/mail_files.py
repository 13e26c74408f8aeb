"""Folders of message files, and tables of raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every message file below a folder, whatever the case of its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").rlike(r"\.(eml|msg)$")) \
        .select("path", F.xxhash64("path").alias("msg_id"), "content")


def stream_folder(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The same folder as a stream of arriving files."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA) \
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch) \
        .load(folder)
    return files.where(F.lower("path").rlike(r"\.(eml|msg)$")) \
        .select("path", F.xxhash64("path").alias("msg_id"), "content")
