"""Shapes of physical plans that matter at scale."""

from pyspark.sql import functions as F

from mailsieve.operators import records
from mailsieve.plans.analysis import inspected, message_signals
from mailsieve.plans.tables import view
from mailsieve.plans.views import AS_OF
from mailsieve.sources import mime

from .conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_stage_moves_no_data(spark, tmp_path):
    """From raw bytes to weighted signals without a shuffle, join or Python worker."""
    view(spark, SF, "raw_mail").select(
        "msg_id", "path", F.encode("raw_text", "UTF-8").alias("content")) \
        .withColumns({"user_id": F.col("msg_id") % 9, "created_at": F.timestamp_seconds("msg_id")}) \
        .write.parquet(str(tmp_path / "raw"))
    messages, _ = mime.parse(spark.read.parquet(str(tmp_path / "raw")))
    signals = message_signals(inspected(messages, AS_OF))
    plan = _plan(signals)
    for word in ("Exchange", "Join", "Window", "Python", "Pandas"):
        assert word not in plan, word
    assert plan.count("FileScan") == 1
    assert signals.count() == 192


def test_history_filters_reach_the_scan(spark, tmp_path):
    view(spark, SF, "records_log").write.parquet(str(tmp_path / "records"))
    stored = spark.read.parquet(str(tmp_path / "records"))
    plan = _plan(records.history(stored, user_id=8, risk_level="Safe").select("id"))
    assert "EqualTo(user_id,8)" in plan and "EqualTo(verdict,Low)" in plan
    assert "finding_json" not in plan
