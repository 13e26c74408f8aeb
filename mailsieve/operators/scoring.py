"""From signals to verdicts, all on the message's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.base import explode_rows, text
from ..functions.identity import trusted_sender
from .headers import diverted
from .scale import durable


def with_trust(messages: DataFrame) -> DataFrame:
    """Authenticated known sender whose replies are not diverted."""
    return messages.withColumn("trusted_sender", F.coalesce(
        trusted_sender("from_domain", "spf", "dkim", "dmarc") & ~diverted(messages), F.lit(False)))


def confidence_factors(signals: str, optional: dict[str, tuple[Column, Column]]) -> Column:
    """Evidence that could have been there, and was.  ``optional`` adds factors that
    only count when their stage ran: name -> (applicable, satisfied)."""
    def factor(name, applicable, satisfied):
        return F.struct(F.lit(name).alias("name"),
                        F.coalesce(applicable, F.lit(False)).alias("applicable"),
                        F.coalesce(satisfied, F.lit(False)).alias("satisfied"))

    yes = F.lit(True)
    claimed = (text("spf") != "not_present") | (text("dkim") != "not_present") \
        | (text("dmarc") != "not_present")
    families = F.array_distinct(F.transform(signals, lambda s: s["family"]))
    listed = [
        factor("authentication results", yes, claimed),
        factor("verifiable routing chain", yes, F.col("hop_count") >= 2),
        factor("message body", yes, F.col("has_body")),
    ] + [factor(n, a, s) for n, (a, s) in optional.items()] + [
        factor("corroborating families", F.size(signals) > 0, F.size(families) >= 3)]
    return F.array(*listed)


def verdicts(scored: DataFrame, optional=None, keep=()) -> DataFrame:
    """Damp, cap, sum, gate and explain.

    Expects ``signals`` in source order and ``trusted_sender``; confidence uses
    ``hop_count``, ``has_body`` and the three authentication verdicts.
    """
    d = scored.withColumn("signals", scores.dampened("signals", "trusted_sender"))
    d = d.withColumn("signals", scores.saturated("signals"))
    d = d.withColumns({
        "raw_score": scores.total_weight("signals"),
        "_strong": scores.active("signals", "strong"),
        "_weak": scores.active("signals", "weak")})
    d = d.withColumns({
        "score": scores.display_score("raw_score"),
        "strong_families": F.array_sort(F.array_distinct(
            F.transform("_strong", lambda s: s["family"]))),
        "strong_weight": scores.total_weight("_strong"),
        "strong_signals": F.size("_strong"),
        "weak_signals": F.size("_weak")})
    level, reason = scores.gate("score", "strong_families", "strong_weight")
    conf, label = scores.confidence(confidence_factors("signals", optional or {}))
    d = d.withColumns({"risk_level": level, "reason": reason, "confidence": conf,
                       "confidence_label": label, "rationale": rationale()})
    d = d.withColumn("signals", F.transform("signals", lambda s: s.withField(
        "contribution_pct", scores.contribution(s["weight"], "raw_score"))))
    return d.select("msg_id", *keep, "raw_score", "score", "risk_level", "reason", "rationale",
                    "confidence", "confidence_label", "strong_signals", "weak_signals",
                    "strong_families", "strong_weight", "trusted_sender", "signals")


def rationale() -> Column:
    """Counts and the five heaviest strong and weak indicators."""
    def names(column):
        top = F.transform(F.slice(scores.by_weight(column), 1, 5), lambda s: s["indicator"])
        return F.when(F.size(top) > 0, F.array_join(top, ", ")).otherwise(F.lit("none"))

    return F.concat(
        F.lit("score="), F.col("score").cast("string"),
        F.lit(" strong="), F.col("strong_signals").cast("string"),
        F.lit(" families="), F.size("strong_families").cast("string"),
        F.lit(" weak="), F.col("weak_signals").cast("string"),
        F.lit(" | strong: "), names("_strong"), F.lit(" | weak: "), names("_weak"))


def signal_rows(scored: DataFrame) -> DataFrame:
    """The long signal table, one row per signal with its position."""
    return explode_rows(scored, "signals", "msg_id", pos="seq")


def ranked(verdict_rows: DataFrame, *tiebreak: str) -> DataFrame:
    """Batch order: highest score first, stable on the tiebreak columns.

    A global sort reads its input twice, once to sample the ranges; the narrow verdict
    rows are checkpointed so that the analysis behind them runs once.
    """
    return durable(verdict_rows).orderBy(F.desc("score"), *(tiebreak or ("msg_id",)))
