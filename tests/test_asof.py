import bisect
import datetime as dt
import random

from pyspark.sql import functions as F

from mailsieve.operators import asof, reputation
from mailsieve.plans.analysis import analyse
from mailsieve.plans.tables import letters, view

from .conftest import SF

START = dt.datetime(2026, 1, 1)


def test_equals_a_search_in_sorted_versions(spark):
    r = random.Random(7)
    names = ["hot"] * 20 + ["a", "b", "only asked", None]
    moment = lambda: r.choice([None, *[START + dt.timedelta(hours=r.randrange(60)) for _ in range(9)]])
    rows = [(k, r.choice(names), moment(), "r", "x") for k in range(900)]
    versions = [(name, t, v, "s") for v in range(300) if (name := r.choice(names + ["only told"])) != "only asked" and ((t := moment()) or True)]
    got = asof.last_version(
        spark.createDataFrame(rows + rows[:30], "k long, domain string, at timestamp, _version string, since string"),
        spark.createDataFrame(versions + versions[:30], "domain string, since timestamp, v int, k string"), "domain", "at", "since")
    assert got.columns == ["k", "domain", "at", "_version", "since", "version"]
    held = {}
    for name, t, v, _ in versions:
        if name is not None and t is not None:
            held.setdefault(name, []).append((t, v))
    found = got.collect()
    assert len(found) == 930 and len({x.k for x in found}) == 900
    for x in found:
        mine = sorted(held.get(x.domain, []))
        i = bisect.bisect_right(mine, (x["at"], 10 ** 9)) if x["at"] else 0
        assert (x.version and (x.version.since, x.version.v)) == (mine[i - 1] if i else None)
    assert {x.version is None for x in found} == {True, False}


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", START)], "k long, domain string, at timestamp")
    versions = spark.createDataFrame([("a", START)], "domain string, since timestamp")
    assert asof.last_version(rows, versions.limit(0), "domain", "at", "since").collect()[0].version is None
    assert asof.last_version(rows.limit(0), versions, "domain", "at", "since").count() == 0
    assert asof.last_version(rows, versions, "domain", "at", "since").collect()[0].version.since == START


def test_answers_expire_and_failures_replace(spark):
    day = dt.timedelta(days=1)
    answers = spark.createDataFrame([
        ("a.com", "2025-12-30", "R", True, START), ("a.com", "2025-12-01", "S", True, START),
        ("a.com", None, None, False, START + 2 * day)], "domain string, created string, registrar string, ok boolean, fetched timestamp")
    times = [START - day, START, START + day, START + 2 * day, START + 2.1 * day, None]
    asked = spark.createDataFrame([(k, 0, "a.com", "sender", False, t) for k, t in enumerate(times)] + [
        (9, 0, "google.com", "sender", True, START)], "msg_id long, pos int, domain string, origin string, exempt boolean, created_at timestamp")
    got = {x.msg_id: (x.classification, x.age_days) for x in reputation.domain_ages_then(asked, answers).collect()}
    assert got == {0: ("unknown", None), 1: ("young", 31), 2: ("young", 32), 3: ("unknown", None),
                   4: ("unknown", None), 5: ("unknown", None), 9: ("exempt", None)}


def test_analysis_sees_the_answer_of_its_time(spark):
    mail = letters(spark, SF).withColumns({"user_id": F.lit(1), "created_at": F.timestamp_seconds(F.lit(1772668800) + F.col("msg_id") % 2 * 86400)})
    whois = view(spark, SF, "whois").withColumns({"ok": F.lit(True), "fetched": F.timestamp_seconds(F.lit(1772668800 + 3600))}).drop("expires")
    rows = analyse(mail, "2026-03-05 00:00:00", whois=whois).select("msg_id", F.exists("signals", lambda s: F.startswith(s["indicator"], F.lit("Domain Reputation"))).alias("aged")).collect()
    assert not any(x.aged for x in rows if x.msg_id % 2 == 0) and any(x.aged for x in rows if x.msg_id % 2)
