"""Message files from folder to verdict, in batch and as a stream."""

import base64

from pyspark.sql import functions as F

from mailsieve.sources import mail_files, mime
from mailsieve.streaming import arrivals, lookups, ratelimit

NESTED = "\r\n".join([
    "Received: from a.example ([8.8.4.4]) by mx.harbor.com; Tue, 03 Mar 2026", " 08:30:00 +0000",
    "From: =?utf-8?B?" + base64.b64encode("Zoë".encode()).decode() + "?= <zoe@lakeside.com>",
    "To: dana@harbor.com", "Subject: =?iso-8859-1?Q?caf=E9_now?=", "Message-ID: <1@lakeside.com>",
    "Date: Tue, 03 Mar 2026 08:30:00 +0000",
    'Content-Type: multipart/mixed; boundary="out"', "", "preamble",
    "--out", 'Content-Type: multipart/related; boundary="mid"', "",
    "--mid", 'Content-Type: multipart/alternative; boundary="in"', "",
    "--in", "Content-Type: text/plain; charset=iso-8859-1",
    "Content-Transfer-Encoding: quoted-printable", "", "caf=E9 and=", " more",
    "--in", "Content-Type: text/html", "", "<p>hi</p>", "--in--",
    "--mid", "Content-Type: image/png", "Content-ID: <pic>", "Content-Disposition: inline",
    "Content-Transfer-Encoding: base64", "", base64.b64encode(b"\x89PNG123").decode(), "--mid--",
    "--out", "Content-Type: application/octet-stream; name=x",
    "Content-Disposition: attachment; filename*=utf-8''r%C3%A9sum%C3%A9.pdf.exe",
    "Content-Transfer-Encoding: base64", "", base64.b64encode(b"MZ\x90\x00").decode(), "--out--", ""])


def _folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.eml").write_bytes(NESTED.encode("latin-1"))
    (tmp_path / "in" / "deep" / "B.EML").write_bytes(b"From: x@y.org\r\nSubject: s\r\n\r\nplain \xff body")
    (tmp_path / "in" / "c.txt").write_bytes(b"not mail")
    (tmp_path / "in" / "d.eml").write_bytes(b"\r\n\r\n")   # a zero-byte file is never listed
    (tmp_path / "in" / "e.msg").write_bytes(b"\xd0\xcf")
    return str(tmp_path / "in")


def test_nested_message(spark, tmp_path):
    messages, rejects = mime.parse(mail_files.read_folder(spark, _folder(tmp_path)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in messages.collect()}
    assert sorted(rows) == ["B.EML", "a.eml"]
    a, b = rows["a.eml"], rows["B.EML"]
    assert a.from_raw == "Zoë <zoe@lakeside.com>" and a.subject == "café now"
    assert a.body_plain == "café and more" and a.body_html == "<p>hi</p>"
    assert a.received_chain[0].endswith("Tue, 03 Mar 2026 08:30:00 +0000")
    assert [(x.filename, bytes(x.content), x.is_inline) for x in a.attachments] == [
        ("résumé.pdf.exe", b"MZ\x90\x00", False), ("unnamed", b"\x89PNG123", True)]
    assert a.mime_structure.split("\n") == [
        "- multipart/mixed", "  - multipart/related", "    - multipart/alternative",
        "      - text/plain", "      - text/html", "    - image/png", "  - application/octet-stream"]
    assert b.body_plain == "plain � body"
    assert {r.path.rsplit("/", 1)[1]: r.reject_reason for r in rejects.collect()} == {
        "d.eml": "empty message", "e.msg": "unsupported type"}


def _parse_one(spark, tmp_path, lines):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "m.eml").write_bytes("\r\n".join(lines).encode("latin-1"))
    return mime.parse(mail_files.read_folder(spark, str(tmp_path / "one")))[0].first()


def test_boundary_is_never_a_pattern(spark, tmp_path):
    m = _parse_one(spark, tmp_path, [
        "From: a@b.org", 'Content-Type: multipart/mixed; boundary="a\\E("', "", "pre",
        "--a\\E(", "Content-Type: text/plain", "", "hello", "--a\\E(--", "after"])
    assert m.body_plain == "hello"
    assert m.mime_structure == "- multipart/mixed\n  - text/plain"


def test_declared_charsets(spark):
    said = "Ünïcode “quotes” – Привет Ωμέγα ěščř €"
    names = {"windows-1251": "cp1251", "CP1252": "cp1252", "koi8-r": "koi8_r", "iso-8859-7": "iso8859_7", "ISO_8859-2": "iso8859_2",
             "iso-8859-15": "iso8859_15", "utf-16be": "utf-16-be", "utf-8": "utf-8", "latin1": "latin-1", "no-such-set": "utf-8"}
    rows = [(n, bytearray(said.encode(c, "ignore")), said.encode(c, "ignore").decode(c)) for n, c in names.items()]
    d = spark.createDataFrame(rows, "name string, raw binary, want string")
    for r in d.select("name", "want", mime.decode_bytes(F.col("raw"), F.col("name")).alias("got")).collect():
        assert r.got == r.want, r.name
    assert "cp932" not in mime.UPPER_HALVES and "gbk" not in mime.UPPER_HALVES


def test_only_open_boundaries_cut(spark, tmp_path):
    m = _parse_one(spark, tmp_path, [
        "From: a@b.org", "Content-Type: multipart/mixed; boundary=out", "", "--out",
        "Content-Type: text/plain", "", "it says boundary=foo here", "--foo", "hidden text", "-- ", "--foo--",
        "the end", "--out", "Content-Type: text/html", "", "<p>x</p>", "--out-- \t", "epilogue"])
    assert m.body_plain == "it says boundary=foo here\r\n--foo\r\nhidden text\r\n-- \r\n--foo--\r\nthe end"
    assert m.body_html == "<p>x</p>"


def test_arriving_files_are_analysed_once(spark, tmp_path):
    folder, out = _folder(tmp_path), str(tmp_path / "out")
    for _ in range(2):
        arrivals.analyse_arrivals(spark, folder, out, str(tmp_path / "state"),
                                  "2026-03-05 00:00:00").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2
    names = {s.indicator for r in rows for s in r.signals}
    assert "Executable / Suspicious Attachment" in names


def test_rate_limit_equals_a_plain_walk(spark):
    rate, per = 5, 60.0
    d = spark.range(4000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 9)
        .alias("user_id"), F.timestamp_seconds(F.col("id") * F.col("id") * 31 % 20000).alias("ts"))
    got = {r.event_id: r.allowed for r in ratelimit.limited(d, rate, per).collect()}
    buckets = {}
    for r in sorted(d.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        now = r.ts.timestamp()
        tokens, last = buckets.get(r.user_id, (float(rate), now))
        tokens = min(rate, tokens + (now - last) * rate / per)
        assert got[r.event_id] == (tokens >= 1), r
        buckets[r.user_id] = (tokens - 1 if tokens >= 1 else tokens, now)


def test_expired_answers_count_as_absent(spark):
    asked = spark.sql("select 1 id, 'a.com' domain, timestamp'2026-01-02' ts union all "
                      "select 2, 'a.com', timestamp'2026-01-09' union all select 3, 'b.com', timestamp'2026-01-02'")
    held = spark.sql("select 'a.com' domain, '2001-01-01' created, true ok, timestamp'2026-01-05' expires")
    got = {r.id: (r.cached, r.created) for r in lookups.with_valid_answer(asked, held).collect()}
    assert got == {1: (True, "2001-01-01"), 2: (False, None), 3: (False, None)}
