"""Input from strangers that must not end a job: it gets a verdict, or is replaced, like any other."""

import base64

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import dnsauth, records
from mailsieve.plans.analysis import analyse
from mailsieve.sources import mime

DNS = "name string, rdtype string, value string, status string"


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be", "utf-16"])
def test_utf16_equals_python(spark, codec):
    texts = [b"", b"a", b"a\0b\0", b"\0a\0b", b"\x00\xd8\x00\xd8", b"\xd8\x00\xdc\x00x", b"\x3d\xd8\x00\xde!", b"\xff\xfea\0", b"\xfe\xff\0a",
             b"\x00\xdca\0", b"\xdc\x00\0a", "\U0001f600é".encode("utf-16-le"), "\U0001f600é".encode("utf-16-be")]
    rows = spark.createDataFrame([(bytearray(t),) for t in texts], "b binary").select(
        "b", mime.decode_bytes(F.col("b"), F.lit(codec)).alias("t"))
    for r in rows.collect():
        raw = bytes(r.b)
        want = raw.decode(codec, "replace")
        assert r.t.replace("\ufffd", "") == want.replace("\ufffd", ""), raw
        assert ("\ufffd" in r.t) == ("\ufffd" in want), raw


def spf(spark, *policies, ip="1.2.3.4"):
    rows = [(f"d{k}.com", "TXT", p, "ok") for k, p in enumerate(policies)] + [
        (f"d{k}.com", "A", "1.2.3.9", "ok") for k in range(len(policies))] + [(f"d{k}.com", "AAAA", "2001:db8::1", "ok") for k in range(len(policies))]
    asked = spark.createDataFrame([(f"d{k}.com", ip) for k in range(len(policies))], "domain string, ip string")
    found = {r.domain: r.spf for r in dnsauth.evaluate_spf(asked, spark.createDataFrame(rows, DNS)).collect()}
    return [found[f"d{k}.com"] for k in range(len(policies))]


def test_network_lengths_that_no_address_has(spark):
    assert spf(spark, "v=spf1 ip4:1.2.3.4/99 -all", "v=spf1 a/99 -all", "v=spf1 a/99999999999 -all", "v=spf1 ip4:1.2.3.4/33 -all",
               "v=spf1 ip4:1.2.3.0/99999999999 ~all", "v=spf1 ip4:1.2.3.0/24 -all", "v=spf1 a/24 -all", "v=spf1 a/24//64 -all",
               "v=spf1 ip4:1.2.3.4/0 -all", "v=spf1 ip6:2001:db8::/129 -all", "v=spf1 ip4:9.9.9.9/x -all") == [
        "permerror", "permerror", "permerror", "permerror", "permerror", "pass", "pass", "pass", "pass", "permerror", "fail"]
    assert spf(spark, "v=spf1 ip6:2001:db8::/32 -all", "v=spf1 ip6:2001:db8::/999 -all", ip="2001:db8::7") == ["pass", "permerror"]


def test_repeated_policy_tags(spark):
    policies = ["v=DMARC1; p=none; p=reject", "v=DMARC1; p=quarantine;;", "v=DMARC1; p=none; P=reject ; aspf=s; aspf", "v=DMARC1; =; p", "v=DMARC1"]
    rows = [(f"_dmarc.d{k}.com", "TXT", p, "ok") for k, p in enumerate(policies)]
    found = dnsauth.dmarc_lookup(spark.createDataFrame([(f"d{k}.com",) for k in range(len(policies))], "domain string"),
                                 spark.createDataFrame(rows, DNS))
    got = {r.domain: (r.policy, r.strict_spf) for r in found.collect()}
    assert [got[f"d{k}.com"] for k in range(len(policies))] == [
        ("reject", False), ("quarantine", False), ("reject", False), (None, False), (None, False)]


def test_stored_findings_that_are_no_json(spark):
    stored = spark.createDataFrame([(k, 1, "f", t, 5, "Low") for k, t in enumerate(["{", "", None, "[1", '{"subject": "Hello"}'])],
                                   "id long, user_id long, filename string, finding_json string, risk_score int, verdict string") \
        .withColumn("created_at", F.current_timestamp())
    assert {r.id: r.subject for r in records.listing(stored).collect()} == {
        0: "(No Subject)", 1: "(No Subject)", 2: "(No Subject)", 3: "(No Subject)", 4: "Hello"}
    assert [r.id for r in records.history(stored, search="hell").collect()] == [4]


def test_messages_reach_a_verdict(spark):
    bad = base64.b64encode(b"\x00\xd8\x00\xd8").decode()
    raws = [f"From: a@b.com\r\nSubject: =?utf-16le?B?{bad}?=\r\nContent-Type: text/plain; charset=utf-16le\r\n"
            f"Content-Transfer-Encoding: base64\r\n\r\n{bad}\r\n",
            "From: a@b.com\r\nContent-Type: text/html; charset=utf-16\r\n\r\n<p>x\r\n",
            "From: \r\nDate: 99999999999\r\nReceived: from [999.999.999.999] by x; 0\r\n\r\n&#99999999999999999999;%zz"]
    files = spark.createDataFrame([(k, f"m{k}.eml", bytearray(r.encode())) for k, r in enumerate(raws)], "msg_id long, path string, content binary")
    messages, _ = mime.parse(files)
    found = analyse(messages.withColumns({"user_id": F.lit(1).cast("bigint"), "created_at": F.current_timestamp()}),
                    as_of="2026-03-05 00:00:00")
    assert sorted(r.msg_id for r in found.collect()) == [0, 1, 2]
