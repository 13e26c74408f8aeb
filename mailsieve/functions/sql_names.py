"""SQL names for the scalar library, as SQL-bodied functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed_values as fv


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    bodies = {
        "registrable_domain(host STRING) RETURNS STRING": (
            "CASE WHEN substring_index(lower(trim('.' FROM host)), '.', -2) "
            f"IN ({_quoted(fv.MULTI_LABEL_SUFFIXES)}) "
            "THEN substring_index(lower(trim('.' FROM host)), '.', -3) "
            "ELSE substring_index(lower(trim('.' FROM host)), '.', -2) END"),
        "fold_homoglyphs(label STRING) RETURNS STRING": "translate(label, '01358@-', 'olesba')",
        "display_score(raw INT) RETURNS INT": (
            f"CAST(CASE WHEN greatest(raw, 0) <= {fv.LINEAR_CEILING} THEN greatest(raw, 0) "
            f"WHEN raw <= {fv.COMPRESSED_CEILING} THEN "
            f"bround({fv.LINEAR_CEILING} + (raw - {fv.LINEAR_CEILING}) * 20 / 80D) "
            f"ELSE least(99D, bround(90 + 10 * (1 - {fv.COMPRESSED_CEILING}D / raw))) END AS INT)"),
        "risk_bucket(score INT) RETURNS STRING": (
            f"CASE WHEN score >= {fv.CRITICAL_FROM} THEN 'Critical' "
            f"WHEN score >= {fv.HIGH_FROM} THEN 'High' "
            f"WHEN score >= {fv.MEDIUM_FROM} THEN 'Medium' ELSE 'Low' END"),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
