"""Costly steps are done once for each message."""

import re

from pyspark.sql import functions as F

from mailsieve.functions import text
from mailsieve.plans import analysis, result_queries

from .conftest import SF

ODD = ["", None, "plain words", "a  b\t\tc  d", " lead and trail ", "x y", "soft­hyphen​ ﻿ end",
       "a &amp; b &lt;c&gt; &NotEqualTilde; &bogus; &amp &copy2 &#65; &#x1F600; &", "é \tè", "a\r\n b\f\fc"]


def test_match_text_reads_markup_once(spark):
    d = spark.createDataFrame([("a", "<p>b</p>")], "plain string, html string").repartition(2)
    plan = d.select(text.match_text("plain", "html").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(script|style)") == 1


def test_normalised_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    d = spark.createDataFrame(rows, "i int, t string").repartition(2)
    found = {r.i: r for r in d.select("i", text.decode_entities("t").alias("d"), text.normalise("t").alias("n")).collect()}
    for i, _ in rows:
        visible = re.sub(text.INVISIBLE, "", found[i].d)
        assert found[i].n == re.sub("[ \t\r\f\x0b ]+", " ", visible), i
    assert found[7].d == "a & b <c> ≂̸ &bogus; & ©2 A \U0001F600 &"


def test_match_text_parts(spark):
    d = spark.createDataFrame(
        [(0, "one", ""), (1, "one", None), (2, "one", "<b>t</b>wo"), (3, "", "<p>x</p>"), (4, None, "x"), (5, "x", "x"),
         (6, "a", "<script>s</script>"), (7, "a", "ver<!-- z -->ify")], "i int, p string, h string").repartition(2)
    got = {r.i: r.t for r in d.select("i", text.match_text("p", "h").alias("t")).collect()}
    assert got == {0: "one", 1: "one", 2: "one\n t wo\ntwo", 3: " x \nx", 4: "x", 5: "x\nx", 6: "a\n ", 7: "a\nver ify"}


def test_evidence_inspects_messages_once(spark, monkeypatch):
    calls = []

    def counted(messages, as_of, plain=analysis.inspected):
        calls.append(as_of)
        return plain(messages, as_of)

    monkeypatch.setattr(analysis, "inspected", counted)
    monkeypatch.setattr(result_queries, "inspected", counted)
    log = result_queries.evidence_with_signals(spark, SF)
    assert len(calls) == 1
    assert log.where(F.col("category") == "signal").count() > 0
