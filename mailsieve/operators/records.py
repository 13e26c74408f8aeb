"""Stored results: current versions, history listing, lookup, deletion, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import text
from ..functions.scores import display_score

SORTS = {
    "date_desc": [F.desc, "created_at"], "date_asc": [F.asc, "created_at"],
    "score_desc": [F.desc, "risk_score"], "score_asc": [F.asc, "risk_score"],
    "filename": [F.asc, "filename"],
}
MAX_PAGE = 100


def current(log: DataFrame) -> DataFrame:
    """Latest version of each record from an append-only log.

    An aggregate, not a window: rows combine before the shuffle, so a record that
    was rewritten very often does not make a large group.
    """
    rest = [c for c in log.columns if c not in ("id", "version")]
    return log.groupBy("id").agg(
        F.max_by(F.struct("version", *rest), "version").alias("r")).select("id", "r.*")


def finding_field(name: str) -> Column:
    """One field of the stored finding; null where that is no JSON."""
    return F.try_variant_get(F.try_parse_json("finding_json"), f"$.{name}", "string")


def history(records: DataFrame, user_id=None, risk_level: str = "All",
            search: str | None = None) -> DataFrame:
    """Records of an owner, filtered by verdict and by a case-blind search."""
    d = records if user_id is None else records.where(F.col("user_id") == user_id)
    if risk_level and risk_level != "All":
        d = d.where(F.col("verdict") == ("Low" if risk_level == "Safe" else risk_level))
    if search and search.strip():
        like = f"%{search.strip().lower()}%"
        d = d.where(F.col("filename").ilike(like) | finding_field("subject").ilike(like)
                    | finding_field("from_addr").ilike(like))
    return d


def listing(records: DataFrame) -> DataFrame:
    """What a history page shows of each record."""
    legacy = finding_field("raw_score").isNull() & (F.col("risk_score") > 100)
    return records.select(
        "id", "user_id", "filename",
        F.coalesce(F.nullif(finding_field("subject"), F.lit("")), F.lit("(No Subject)"))
        .alias("subject"),
        F.coalesce(F.nullif(finding_field("from_addr"), F.lit("")), F.lit("-")).alias("from_addr"),
        F.when(legacy, display_score("risk_score")).otherwise(F.coalesce("risk_score", F.lit(0)))
        .alias("score"),
        F.col("verdict").alias("risk_level"), F.to_date("created_at").alias("date"),
        "created_at", "risk_score")


def page(records: DataFrame, sort: str = "date_desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the history; the sort is made unique by the record id."""
    direction, column = SORTS.get(sort, SORTS["date_desc"])
    return records.orderBy(direction(column), "id").offset(max(0, offset)) \
        .limit(min(max(1, limit), MAX_PAGE))


def total(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"))


def find(records: DataFrame, id_: str, user_id) -> DataFrame:
    return records.where((F.col("id") == id_) & (F.col("user_id") == user_id))


def owned(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records that requests (id, user_id) may see."""
    return records.join(requests, ["id", "user_id"])


def without_deleted(records: DataFrame, deletions: DataFrame) -> DataFrame:
    """Records left after deletions (id, user_id); only the owner can delete."""
    return records.join(deletions.select("id", "user_id"), ["id", "user_id"], "left_anti")


def dashboard(records: DataFrame, *by: str) -> DataFrame:
    """Counts shown on the overview page."""
    level = F.col("verdict")
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(level.isin("High", "Critical")).alias("high"),
        F.count_if(level == "Medium").alias("medium"),
        F.count_if(level.isin("Low", "Safe")).alias("safe"))


def newest(records: DataFrame, most: int = 6) -> DataFrame:
    return records.orderBy(F.desc("created_at"), "id").limit(most)


def prior_senders(records: DataFrame) -> DataFrame:
    """Past senders in the shape the sender baseline expects; stubs are left out."""
    from ..functions.identity import address
    return records.where(F.col("verdict") != "Pending").select(
        "id", "user_id", F.col("created_at").alias("ts"),
        address(text(finding_field("from_addr"))).alias("from_addr"))
