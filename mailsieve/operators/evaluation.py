"""Accuracy of verdicts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import by_weight


def outcome(level, malicious) -> Column:
    flagged = level.isin("High", "Critical")
    return (F.when(flagged & malicious, "TP").when(flagged, "FP")
            .when(malicious, "FN").otherwise("TN"))


def confusion(cases: DataFrame, level: str = "risk_level", malicious: str = "malicious") -> DataFrame:
    """tp, fp, tn, fn in one pass."""
    kind = outcome(F.col(level), F.col(malicious))
    return cases.select(kind.alias("o")).agg(
        *[F.count_if(F.col("o") == o.upper()).alias(o) for o in ("tp", "fp", "tn", "fn")])


def accuracy(matrix: DataFrame) -> DataFrame:
    """Precision, recall, accuracy and F1, zero when undefined, four decimals."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    d = matrix.withColumns({"p": ratio(tp, tp + fp), "r": ratio(tp, tp + fn)})
    return d.select(
        "tp", "fp", "tn", "fn", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"),
        F.bround(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        F.bround(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r")
                        / F.when(F.col("p") + F.col("r") > 0, F.col("p") + F.col("r")))
                 .otherwise(F.lit(0.0)), 4).alias("f1"))


def top_signals(most: int = 8) -> Column:
    """Heaviest signals of a case; cut first, then drop the weightless."""
    return F.filter(F.slice(by_weight("signals"), 1, most), lambda s: s["weight"] > 0)
