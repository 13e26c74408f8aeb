"""Rules on small inputs made for the purpose."""

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import identity, mailtime, network, scores, urls
from mailsieve.functions.sql_names import register
from mailsieve.sources import dims, labelled


def test_labelled_set_is_told_apart(spark):
    row = labelled.measure(spark).first()
    assert (row.precision, row.recall, row.accuracy, row.f1) == (1.0, 1.0, 1.0, 1.0)
    assert row.tn >= 20 and row.tp >= 7


def test_display_score_rises_and_stays_in_range(spark):
    d = spark.range(2001).select(F.col("id").cast("int").alias("raw"))
    got = [r.s for r in d.select("raw", scores.display_score("raw").alias("s")).orderBy("raw").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] <= 99
    assert (got[70], got[72], got[150], got[300]) == (70, 70, 90, 95)

    def plain(raw):
        if raw <= 70:
            return raw
        return round(70 + (raw - 70) / 4) if raw <= 150 else min(99, round(90 + 10 * (1 - 150 / raw)))
    assert got == [plain(r) for r in range(2001)]
    register(spark)
    assert got == [r.s for r in d.selectExpr("raw", "display_score(raw) s").orderBy("raw").collect()]


def test_family_budget_goes_to_the_heaviest(spark):
    weights = [20, 30, 25, 30]
    signals = F.array(*[scores.signal(f"spf {i}", w, "strong", "", "authentication")
                        for i, w in enumerate(weights)])
    got = spark.range(1).select(scores.saturated(signals).alias("s")).first().s
    assert [x.weight for x in got] == [0, 30, 15, 30]
    assert [x.original_weight for x in got] == weights


@pytest.mark.parametrize("domain, brand", [
    ("paypa1.com", "paypal"), ("micros0ft.ru", "microsoft"), ("linkedln.com", "linkedin"),
    ("login.paypal.evil.tk", "paypal"), ("pineapple-farm.com", None), ("follow-ups.com", None),
    ("paypal.me", None), ("mail.amazon.co.uk", None), ("town-square.com", None), ("", None)])
def test_lookalikes(spark, domain, brand):
    d = spark.createDataFrame([(domain,)], "d string")
    assert d.select(identity.lookalike_brand("d").alias("b")).first().b == brand


def test_addresses(spark):
    rows = [('"billing@paypal.com" <Thief@Evil.tk>', "thief@evil.tk"), ("a@b.org", "a@b.org"),
            ("Ann (x) <ann@b.org.>", "ann@b.org."), ("nobody", None), (None, None)]
    d = spark.createDataFrame([(r[0],) for r in rows], "h string")
    assert [r.a for r in d.select(identity.address("h").alias("a")).collect()] == [r[1] for r in rows]


def test_mail_dates(spark):
    rows = [("Tue, 3 Mar 2026 08:30:00 -0800 (PST)", "2026-03-03 16:30:00"),
            ("03 Mar 2026 08:30 GMT", "2026-03-03 08:30:00"),
            ("Tue, 03 Mar 2026 08:30:00 EST", "2026-03-03 13:30:00"), ("soon", None), ("", None)]
    d = spark.createDataFrame([(r[0],) for r in rows], "d string")
    got = d.select(F.date_format(mailtime.parse_mail_date("d"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert [r.t for r in got.collect()] == [r[1] for r in rows]


def test_address_classes(spark):
    import ipaddress
    ips = ["10.1.2.3", "172.31.0.1", "192.168.1.1", "127.0.0.1", "100.64.0.9", "8.8.8.8",
           "203.0.113.9", "169.254.1.1", "0.1.2.3", "250.1.1.1", "198.18.0.1", "9.9.9.9"]
    d = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.c for r in d.select("ip", network.ip_class("ip").alias("c")).collect()}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        expect = ("Loopback" if a.is_loopback else "Private" if a.is_private else
                  "CGNAT" if a in ipaddress.ip_network("100.64.0.0/10") else "Public")
        assert got[ip] == expect, ip


def test_redirects_and_anchor_claims(spark):
    rows = [("https://a.com/x?url=https://b.com/", "www.b.com", True, "www.b.com"),
            ("https://a.com/x?url=https://m.a.com/", "Click here", False, None),
            ("https://a.com/x?continue=https://b.com/", "invoice.pdf", False, None),
            ("https://a.com/x?next=https%3A%2F%2Fb.com", "mail ann@c.org", True, "c.org")]
    d = spark.createDataFrame(rows, "u string, a string, r boolean, c string")
    for row in d.select("r", "c", urls.redirects_elsewhere("u").alias("gr"),
                        urls.claimed_host("a").alias("gc")).collect():
        assert (row.gr, row.gc) == (row.r, row.c)


def test_reference_lists(spark):
    assert dims.reference_lists(spark).where("list = 'brands'").count() == 34
    assert dims.magic_numbers(spark).count() == 14
