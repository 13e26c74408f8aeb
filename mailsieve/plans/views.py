"""Mail views derived from the tables at hand, in SQL that Spark and DuckDB share.

Each entry is one query; :func:`with_clause` collects what a query needs, in order.
Every view grows with ``documents``, ``events`` or ``pages``; the VALUES lists are
the dimensions that turn their rows into mail.
"""

from __future__ import annotations

import re

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

CRLF = "concat(chr(13), chr(10))"

VIEWS: dict[str, str] = {}

VIEWS["senders"] = """
SELECT * FROM (VALUES
 (0,'GitHub','builds','github.com','','','pass','pass','pass'),
 (1,'Google','alerts','calendar.google.com','','','pass','pass','pass'),
 (2,'Stripe','receipts','stripe.com','','','pass','pass','pass'),
 (3,'HSBC','notice','mail.hsbc.com','','','pass','pass','pass'),
 (4,'Corner Bakery','hello','cornerbakery.example','','','none','none','none'),
 (5,'Dana','dana','riverside.org','','','pass','pass','pass'),
 (6,'Registry','office','nust.edu.pk','desk@portal.nust.edu.pk','','pass','pass','pass'),
 (7,'Tickets','noreply','harbor.com','help@harbor.zendesk.com','','pass','pass','pass'),
 (8,'Newsletter','news','lakeside.com','team@mail.lakeside.com','bounce@em77.sendgrid.net','pass','pass','pass'),
 (9,'PayPal Billing','help','paypa1-billing.com','desk@claims.tk','','fail','fail','fail'),
 (10,'Director','office','firm-treasury.ml','','','none','none','none'),
 (11,'Helpdesk','desk','micros0ft.ru','','','fail','fail','fail'),
 (12,'DocuSign','sign','docusign.files.top','','','fail','fail','fail'),
 (13,'Netflix','info','netflix.com','member.care@gmail.com','','pass','pass','pass'),
 (14,'Adobe','mail','adobe.com','renew@adobe.renewals.icu','','pass','pass','pass'),
 (15,'Pineapple Traders','hi','pineapple-traders.com','','','softfail','none','none')
) AS s(k, display, localpart, domain, reply_to, return_path, spf, dkim, dmarc)"""

VIEWS["phrases_dim"] = """
SELECT * FROM (VALUES
 (0,'Lunch on Tuesday',''),(1,'Please verify account',' Kindly confirm your password here.'),
 (2,'Urgent notice',' You must respond immediately.'),(3,'Treasury',' Arrange a wire transfer before noon.'),
 (4,'Purchase order #77',' The attached invoice lists the items, payment due Monday.'),(5,'Your password expired',' There was an unauthorized login attempt.'),
 (6,'Garden club news',''),(7,'Account notice',' Somebody reported suspicious activity.'),(8,'',' See you soon.')
) AS p(k, subject, phrase)"""

VIEWS["mail"] = """
SELECT d.doc_id AS msg_id, e.user_id AS user_id, e.ts AS created_at,
       concat(s.display,' <',s.localpart,'@',s.domain,'>') AS from_raw,
       concat(s.localpart,'@',s.domain) AS from_addr, s.domain AS from_domain,
       s.reply_to, s.return_path, p.subject, concat(d.text, p.phrase) AS body_plain,
       s.spf, s.dkim, s.dmarc
FROM documents d JOIN events e ON e.event_id = d.doc_id
JOIN senders s ON s.k = d.doc_id % 16
JOIN phrases_dim p ON p.k = d.doc_id % 9"""

VIEWS["mail_log"] = """
SELECT e.event_id AS id, e.user_id, e.ts,
       concat(s.localpart, CAST(e.event_id % 3 AS STRING), '@', s.domain) AS from_addr,
       s.domain AS from_domain
FROM events e JOIN senders s ON s.k = (e.event_id * 7 + e.user_id) % 16"""

VIEWS["hops_dim"] = """
SELECT * FROM (VALUES
 (0,0,'from edge.north.net ([185.10.20.30]) by mx.harbor.com with ESMTPS id q1 for <dana@harbor.com>; Tue, 03 Mar 2026 08:30:40 +0000'),
 (0,1,'from out.claims.tk ([203.0.113.9]) by relay.south.io with SMTP id q2; Tue, 03 Mar 2026 08:30:00 +0000'),
 (1,0,'from relay.north.net ([8.8.4.4]) by mx.harbor.com with ESMTP id q3; Tue, 03 Mar 2026 07:00:00 +0000'),
 (1,1,'from app.riverside.org ([9.9.9.9]) by relay.north.net with ESMTP id q4; Tue, 03 Mar 2026 07:20:00 +0000'),
 (2,0,'from store.local ([10.1.2.3]) by mx.harbor.com with ESMTP id q5; Thu, 05 Mar 2026 09:00:00 +0000'),
 (2,1,'from app.lakeside.com ([64.10.20.30]) by store.local with ESMTP id q6; Tue, 03 Mar 2026 09:00:00 +0000'),
 (3,0,'from solo.north.net ([100.64.7.7]) by mx.harbor.com with SMTP id q7; sometime in March')
) AS h(chain, pos, raw)"""

VIEWS["received"] = """
SELECT d.doc_id AS msg_id, h.pos, h.raw FROM documents d JOIN hops_dim h ON h.chain = d.doc_id % 5"""

VIEWS["snippets"] = """
SELECT * FROM (VALUES
 (0,'<p><a href="https://github.com/teams/list">Teams</a></p>'),
 (1,'<p><a href="http://185.10.20.30/enter">Open file</a></p>'),
 (2,'<p><a href="http://bargains.top/go?target=https://claims.tk/x">www.harbor.com/orders</a></p>'),
 (3,'<p><a href="https://tinyurl.com/q77">gift</a> <a href="javascript:void(0)">y</a></p>'),
 (4,'<form action="https://claims.tk/post"><input type="password" name="secret"></form>'),
 (5,'<meta http-equiv="refresh" content="5;url=http://claims.tk"><iframe src="http://claims.tk/i"></iframe>'),
 (6,'<div style="display:none">quiet preview line</div><p>ver<!-- z -->ify</p>')
) AS a(k, snippet)"""

VIEWS["mail_html"] = """
SELECT g.page_id AS msg_id, concat(g.html, a.snippet) AS body_html
FROM pages g JOIN snippets a ON a.k = g.page_id % 7"""

VIEWS["linked"] = """
SELECT h.msg_id, h.body_html,
       concat('See ', g.url, ' or HTTP://bit.ly/Ab now, also https://example.org/r?a=1&next=https%3A%2F%2Fclaims.tk%2Fy ',
              'and http://paypa1.com/login?goto=https://www.paypa1.com/in') AS body_plain
FROM mail_html h JOIN pages g ON g.page_id = h.msg_id"""

# More markup shapes, one per page, so that every HTML rule meets hits and near misses.
VIEWS["markup_dim"] = """
SELECT * FROM (VALUES
 (0,'<form action="/local"><input name="username"><input name="dob"></form>'),
 (1,'<form action="mailto:a@b.tk"><input name="cvv"><select name="email"></select></form>'),
 (2,'<iframe srcdoc="x"></iframe><object data="f.swf"></object><img src="a.png" onerror="go()">'),
 (3,'<img src="data:image/png;base64,AAAA"><a href="data:text/html,hi">d</a>'),
 (4,'<embed src="data:application/pdf;base64,AA"><img alt="x" src="cid:1">'),
 (5,'<a href="vbscript:run()">v</a><p onclick="a()" onload = "b()">t</p>'),
 (6,'&#112;&#97;&#115;&#115;&#119;&#111;&#114;&#100;&#x61;&#x62;&#112;&#97;&#115;&#115;&#119;&#111;&#114;&#100;&#x61;&#x62;&#8217;'),
 (7,'<style>.pre{display:none} #off{color:red;mso-hide:all}</style><div class="a pre">quiet words<b>more</b></div><i id="off">gone</i>'),
 (8,'<div style="color:#fff">white<span style="background:#000">dark</span></div>'),
 (9,'<table><tr><td width="0">thin</td><td hidden>shy</td></tr></table><!--[if mso]>x<![endif]--><p>one<!-- a -->two</p>'),
 (10,'<div style="Font-Size: 0px; color:red">nil<br>nil</div><p style="opacity:0.5">half</p>')
) AS m(k, markup)"""

VIEWS["markup"] = """
SELECT g.page_id AS msg_id,
       CASE WHEN g.page_id % 2 = 0 THEN concat(g.html, m.markup) ELSE m.markup END AS body_html
FROM pages g JOIN markup_dim m ON m.k = g.page_id % 11"""

VIEWS["traits"] = """
SELECT * FROM (VALUES
 (0,'','','<a0@harbor.com>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (1,'"billing@harbor.com" <office@claims.tk>','','<a1@claims.tk>','Tue, 3 Mar 2026 08:31 GMT','dana@harbor.com'),
 (2,'','List <list@em77.sendgrid.net>','<a2@harbor.com>','03 Mar 2026 08:31:00 -0500 (EST)','dana@harbor.com'),
 (3,'','','','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (4,'','','no-brackets@host','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (5,'','','<x@localhost>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (6,'','Ann <ann@lakeside.com>','<a6@harbor.com>','sometime in March','dana@harbor.com'),
 (7,'','','<a7@192.168.1.4>','','dana@harbor.com'),
 (8,'','','<a8>','Tue, 03 Mar 2026 08:31:00 +0000',''),
 (9,'Ops <ops@185.10.20.30>','','<a9@harbor.com>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (10,'','desk@paypa1-billing.com','<a10@harbor.com>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (11,'"Paypal Support" <care@riverside.org>','','<a11@riverside.org>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com'),
 (12,'Shop <hi@xn--pple-43d.com>','care@xn--pple-43d.com','<a12@xn--pple-43d.com>','Tue, 03 Mar 2026 08:31:00 +0000','dana@harbor.com')
) AS t(k, from_raw, sender_raw, message_id, date, to_raw)"""

VIEWS["letters"] = """
SELECT m.msg_id, m.user_id, m.created_at,
       CASE WHEN t.from_raw <> '' THEN t.from_raw ELSE m.from_raw END AS from_raw,
       t.to_raw, t.sender_raw, m.reply_to AS reply_to_raw, m.return_path AS return_path_raw,
       m.subject, t.message_id, t.date,
       CASE WHEN h.body_html IS NOT NULL AND m.msg_id % 4 = 1 THEN 1
            WHEN m.msg_id % 4 IN (2, 3) THEN CAST(m.msg_id % 4 AS INT) ELSE 0 END AS shape,
       CASE WHEN h.body_html IS NOT NULL AND m.msg_id % 4 = 1 THEN ''
            WHEN m.msg_id % 4 = 3 THEN concat('café ', m.body_plain) ELSE m.body_plain END AS body_plain,
       CASE WHEN m.msg_id % 4 = 0 THEN '' ELSE coalesce(h.body_html, '') END AS body_html,
       m.from_domain AS claimed_domain, m.spf AS claimed_spf, m.dkim AS claimed_dkim,
       m.dmarc AS claimed_dmarc
FROM mail m JOIN traits t ON t.k = m.msg_id % 13
LEFT JOIN mail_html h ON h.msg_id = m.msg_id"""

VIEWS["ar_dim"] = """
SELECT * FROM (VALUES
 (1,0,'mx.harbor.com; spf={spf} smtp.mailfrom=bounce@{dom}; dkim={dkim} header.d={dom}; dmarc={dmarc} (p=reject) header.from={dom}'),
 (2,0,'mx.harbor.com; spf={spf} smtp.mailfrom={dom}; dkim={dkim} header.i=@mail.{dom}'),
 (2,1,'relay.south.io; spf=softfail; dkim=fail; dmarc=fail'),
 (3,0,'mx.harbor.com; dkim=none; spf=neutral; dmarc=permerror'),
 (3,1,'mx.harbor.com; spf=fail; dmarc=fail'),
 (3,2,'mx.harbor.com; arc=none'),
 (4,0,'spf=pass smtp.mailfrom=bounce@other.org; dkim=pass header.i=ann@other.org; dmarc=pass'),
 (5,0,'mx.elsewhere.net; spf=pass (domain of {dom} designates 64.10.20.30 as permitted sender) smtp.mailfrom=a@{dom}; dkim=pass header.d=signer.example; dmarc=fail (p=quarantine)')
) AS a(k, pos, tpl)"""

VIEWS["auth_results"] = """
SELECT l.msg_id, a.pos,
       replace(replace(replace(replace(a.tpl, '{spf}', l.claimed_spf), '{dkim}', l.claimed_dkim),
               '{dmarc}', l.claimed_dmarc), '{dom}', l.claimed_domain) AS raw
FROM letters l JOIN ar_dim a ON a.k = l.msg_id % 6"""

VIEWS["quirks_dim"] = """
SELECT * FROM (VALUES
 (1,0,'X-Mailer','PHPMailer 6.8'),
 (2,0,'X-Spam-Flag','YES'),
 (3,0,'X-PHP-Originating-Script','33:send.php'),
 (4,0,'Message-ID','<second@harbor.com>'),
 (5,0,'Subject','again'),
 (6,0,'User-Agent','Mutt/2.2'),
 (6,1,'X-Originating-IP','[64.10.20.31]'),
 (7,0,'DKIM-Signature','v=1; a=rsa-sha256; d=harbor.com; s=k1; b=abc'),
 (7,1,'DKIM-Signature','v=1; a=rsa-sha256; s=k2; d=lakeside.com.; b=def')
) AS q(k, pos, name, value)"""

VIEWS["header_rows"] = """
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY ord) - 1 AS INT) AS pos,
       name, value
FROM (
  SELECT msg_id, pos AS ord, 'Received' AS name, raw AS value FROM received
  UNION ALL SELECT msg_id, 100 + pos, 'Authentication-Results', raw FROM auth_results
  UNION ALL SELECT msg_id, 200, 'From', from_raw FROM letters
  UNION ALL SELECT msg_id, 201, 'To', to_raw FROM letters
  UNION ALL SELECT msg_id, 202, 'Sender', sender_raw FROM letters
  UNION ALL SELECT msg_id, 203, 'Reply-To', reply_to_raw FROM letters
  UNION ALL SELECT msg_id, 204, 'Return-Path', return_path_raw FROM letters
  UNION ALL SELECT msg_id, 205, 'Subject', subject FROM letters
  UNION ALL SELECT msg_id, 206, 'Message-ID', message_id FROM letters
  UNION ALL SELECT msg_id, 207, 'Date', date FROM letters
  UNION ALL SELECT l.msg_id, 300 + q.pos, q.name, q.value
            FROM letters l JOIN quirks_dim q ON q.k = l.msg_id % 8
) AS x WHERE value <> ''"""

# Payload prefixes in hex; the document's text follows as stored data.
def _zip_head(name: str, flags: int = 0) -> str:
    raw = name.encode()
    return ("504B0304" + "1400" + flags.to_bytes(2, "little").hex() + "00" * 18
            + len(raw).to_bytes(2, "little").hex() + "0000" + raw.hex()).upper()


def _utf16(name: str) -> str:
    return name.encode("utf-16-le").hex().upper()


_OLE = "D0CF11E0A1B11AE1"
VIEWS["attach_dim"] = f"""
SELECT * FROM (VALUES
 (0,'invoice_July.pdf.exe','application/octet-stream','4D5A9000'),
 (1,'notes.txt','text/plain',''),
 (2,'bundle.zip','application/zip','{_zip_head("inner/run.pdf.js", 1) + _zip_head("deep.rar")}'),
 (3,'report.docm','application/octet-stream','{_zip_head("[Content_Types].xml") + _zip_head("word/vbaProject.bin")}'),
 (4,'old.xls','application/vnd.ms-excel','{_OLE + _utf16("Workbook") + _utf16("_VBA_PROJECT")}'),
 (5,'plain.doc','application/msword','{_OLE + _utf16("WordDocument")}'),
 (6,'terms.pdf','application/pdf','255044462D312E34{"/OpenAction << /JS (x) >>".encode().hex().upper()}'),
 (7,'photo.png','image/png','FFD8FFE0'),
 (8,'password_backup.7z','application/x-7z-compressed','377ABCAF271C'),
 (9,'deadbeef0123.bin','application/octet-stream','7F454C46'),
 (10,'locked.docx','application/octet-stream','{_OLE + _utf16("EncryptedPackage")}'),
 (11,'order.zip','application/zip','{_zip_head("readme.txt")}'),
 (12,'link.lnk','application/octet-stream','4C00000001140200')
) AS a(k, filename, mime, prefix)"""

VIEWS["attachments"] = """
SELECT d.doc_id AS msg_id, 0 AS pos, a.filename, a.mime,
       unhex(concat(a.prefix, hex(d.text))) AS content
FROM documents d JOIN attach_dim a ON a.k = d.doc_id % 13
WHERE d.doc_id % 4 IN (2, 3)"""

VIEWS["chain_text"] = """
SELECT * FROM (VALUES
 (0,'Received: from edge.north.net ([185.10.20.30]) by mx.harbor.com with ESMTPS id q1 for <dana@harbor.com>;~ Tue, 03 Mar 2026 08:30:40 +0000~Received: from out.claims.tk ([203.0.113.9]) by relay.south.io with SMTP id q2;~\tTue, 03 Mar 2026 08:30:00 +0000~'),
 (1,'Received: from relay.north.net ([8.8.4.4]) by mx.harbor.com with ESMTP id q3; Tue, 03 Mar 2026 07:00:00 +0000~Received: from app.riverside.org ([9.9.9.9]) by relay.north.net with ESMTP id q4; Tue, 03 Mar 2026 07:20:00 +0000~'),
 (2,'Received: from store.local ([10.1.2.3]) by mx.harbor.com with ESMTP id q5; Thu, 05 Mar 2026 09:00:00 +0000~Received: from app.lakeside.com ([64.10.20.30]) by store.local with ESMTP id q6; Tue, 03 Mar 2026 09:00:00 +0000~'),
 (3,'Received: from solo.north.net ([100.64.7.7]) by mx.harbor.com with SMTP id q7; sometime in March~'),
 (4,'')
) AS c(chain, txt)"""

VIEWS["ar_text"] = """
SELECT * FROM (VALUES
 (0,''),
 (1,'Authentication-Results: mx.harbor.com; spf={spf} smtp.mailfrom=bounce@{dom};~ dkim={dkim} header.d={dom};~ dmarc={dmarc} (p=reject) header.from={dom}~'),
 (2,'Authentication-Results: mx.harbor.com; spf={spf} smtp.mailfrom={dom}; dkim={dkim} header.i=@mail.{dom}~Authentication-Results: relay.south.io; spf=softfail; dkim=fail; dmarc=fail~'),
 (3,'Authentication-Results: mx.harbor.com; dkim=none; spf=neutral; dmarc=permerror~Authentication-Results: mx.harbor.com; spf=fail; dmarc=fail~Authentication-Results: mx.harbor.com; arc=none~'),
 (4,'Authentication-Results: spf=pass smtp.mailfrom=bounce@other.org; dkim=pass header.i=ann@other.org; dmarc=pass~'),
 (5,'Authentication-Results: mx.elsewhere.net; spf=pass (domain of {dom} designates 64.10.20.30 as permitted sender) smtp.mailfrom=a@{dom}; dkim=pass header.d=signer.example; dmarc=fail (p=quarantine)~')
) AS a(k, txt)"""

VIEWS["quirk_text"] = """
SELECT * FROM (VALUES
 (0,''),(1,'X-Mailer: PHPMailer 6.8~'),(2,'X-Spam-Flag: YES~'),
 (3,'X-PHP-Originating-Script: 33:send.php~'),(4,'Message-ID: <second@harbor.com>~'),
 (5,'Subject: again~'),(6,'User-Agent: Mutt/2.2~X-Originating-IP: [64.10.20.31]~'),
 (7,'DKIM-Signature: v=1; a=rsa-sha256; d=harbor.com; s=k1; b=abc~DKIM-Signature: v=1; a=rsa-sha256; s=k2; d=lakeside.com.; b=def~')
) AS q(k, txt)"""


def _line(name: str, column: str) -> str:
    return f"CASE WHEN l.{column} <> '' THEN concat('{name}: ', l.{column}, '~') ELSE '' END"


# Whole messages as they travel.  '~' stands for a line end in the header block and in
# the MIME delimiters; bodies are inserted unchanged.
VIEWS["raw_mail"] = f"""
SELECT l.msg_id, concat('in/', CAST(l.msg_id AS STRING),
                        CASE WHEN l.msg_id % 50 = 7 THEN '.txt' ELSE '.EML' END) AS path,
  CASE WHEN l.msg_id % 50 = 9 THEN '' ELSE concat(
    replace(concat(c.txt,
      replace(replace(replace(replace(a.txt, '{{spf}}', l.claimed_spf), '{{dkim}}', l.claimed_dkim),
              '{{dmarc}}', l.claimed_dmarc), '{{dom}}', l.claimed_domain),
      {", ".join(_line(n, c) for n, c in (
          ("From", "from_raw"), ("To", "to_raw"), ("Sender", "sender_raw"),
          ("Reply-To", "reply_to_raw"), ("Return-Path", "return_path_raw"),
          ("Subject", "subject"), ("Message-ID", "message_id"), ("Date", "date")))},
      q.txt,
      CASE l.shape WHEN 1 THEN 'MIME-Version: 1.0~Content-Type: text/html; charset="utf-8"~'
        WHEN 0 THEN '' ELSE 'MIME-Version: 1.0~Content-Type: multipart/mixed;~ boundary="b1+x"~' END,
      '~'), '~', {CRLF}),
    CASE l.shape WHEN 0 THEN l.body_plain WHEN 1 THEN l.body_html
    WHEN 2 THEN concat(
      replace('preamble~--b1+x~Content-Type: text/plain; charset=utf-8~~', '~', {CRLF}), l.body_plain,
      CASE WHEN l.body_html <> '' THEN concat(
        replace('~--b1+x~Content-Type: text/html; charset=utf-8~Content-Transfer-Encoding: 8bit~~', '~', {CRLF}),
        l.body_html) ELSE '' END)
    ELSE concat(
      replace('--b1+x~Content-Type: multipart/alternative; boundary=b2~~--b2~Content-Type: text/plain; charset="UTF-8"~Content-Transfer-Encoding: quoted-printable~~', '~', {CRLF}),
      concat('caf=C3=', replace('=~', '~', {CRLF}), 'A9 '), replace(substr(l.body_plain, 6), '=', '=3D'),
      CASE WHEN l.body_html <> '' THEN concat(
        replace('~--b2~Content-Type: text/html; charset=utf-8~~', '~', {CRLF}), l.body_html) ELSE '' END,
      replace('~--b2--~', '~', {CRLF})) END,
    CASE WHEN l.shape IN (2, 3) THEN concat(
      replace(concat('~--b1+x~Content-Type: ', f.mime, '; name="', f.filename,
                     '"~Content-Transfer-Encoding: base64~Content-Disposition: attachment; filename="',
                     f.filename, '"~~'), '~', {CRLF}),
      base64(f.content), replace('~--b1+x--~', '~', {CRLF})) ELSE '' END
  ) END AS raw_text
FROM letters l JOIN chain_text c ON c.chain = l.msg_id % 5
JOIN ar_text a ON a.k = l.msg_id % 6
JOIN quirk_text q ON q.k = l.msg_id % 8
LEFT JOIN attachments f ON f.msg_id = l.msg_id"""

# Registration dates per organisation domain; expiry and validity vary.
VIEWS["whois"] = """
SELECT * FROM (VALUES
 ('cornerbakery.example','2026-02-20','Regco',true,'2026-03-12 00:00:00'),
 ('claims.tk','20-Feb-2026','Regco',true,'2026-03-12 00:00:00'),
 ('claims.tk','2026-02-25T10:00:00Z','Regco',true,'2026-03-12 00:00:00'),
 ('firm-treasury.ml','2026-01-10 08:00:00','Tldco',true,'2026-03-12 00:00:00'),
 ('paypa1-billing.com','2026-02-28','Namebay',true,'2026-03-12 00:00:00'),
 ('micros0ft.ru','2025.12.20','Rureg',true,'2026-03-12 00:00:00'),
 ('files.top','2026/02/01','Topreg',true,'2026-03-12 00:00:00'),
 ('bargains.top','15.02.2026','Topreg',true,'2026-03-12 00:00:00'),
 ('riverside.org','2001-05-05','Orgreg',true,'2026-03-12 00:00:00'),
 ('harbor.com','1999-01-01','Comreg',true,'2026-03-04 00:00:00'),
 ('lakeside.com','2027-01-01','Comreg',true,'2026-03-12 00:00:00'),
 ('pineapple-traders.com','unknown','Comreg',false,'2026-03-12 00:00:00'),
 ('example.com','1995-08-14','IANA',true,'2026-03-12 00:00:00'),
 ('nust.edu.pk','2026-01-20','PK',true,'2026-03-12 00:00:00')
) AS w(domain, created, registrar, ok, expires)"""

AS_OF = "2026-03-05 00:00:00"

# DNS answers.  status: ok, nxdomain or temporary.
VIEWS["dns"] = """
SELECT * FROM (VALUES
 ('github.com','TXT','v=spf1 ip4:185.10.0.0/16 include:_spf.relay.example -all','ok'),
 ('_spf.relay.example','TXT','v=spf1 ip4:8.8.4.0/24 include:_deep.relay.example ~all','ok'),
 ('_deep.relay.example','TXT','v=spf1 a:hosts.relay.example ?all','ok'),
 ('hosts.relay.example','A','64.10.20.30','ok'),
 ('calendar.google.com','TXT','v=spf1 redirect=_spf.relay.example','ok'),
 ('stripe.com','TXT','v=spf1 mx -all','ok'),
 ('stripe.com','MX','mx1.stripe.example','ok'),
 ('stripe.com','MX','mx2.stripe.example','ok'),
 ('mx1.stripe.example','A','9.9.9.9','ok'),
 ('mx2.stripe.example','A','185.10.20.30','ok'),
 ('mail.hsbc.com','TXT','v=spf1 ip4:64.10.20.30 ~all','ok'),
 ('riverside.org','TXT','v=spf1 a/24 -all','ok'),
 ('riverside.org','A','8.8.4.77','ok'),
 ('harbor.com','TXT','v=spf1 exists:hosts.relay.example -all','ok'),
 ('lakeside.com','TXT','v=spf1 ip4:1.2.3.4','ok'),
 ('lakeside.com','TXT','other text','ok'),
 ('micros0ft.ru','TXT','v=spf1 ptr +all','ok'),
 ('docusign.files.top','TXT','v=spf1 nonsense:x -all','ok'),
 ('netflix.com','TXT','v=spf1 -all','ok'),
 ('netflix.com','TXT','v=spf1 +all','ok'),
 ('adobe.com','TXT','','temporary'),
 ('nust.edu.pk','TXT','v=spf1 include:missing.example -all','ok'),
 ('missing.example','TXT','','nxdomain'),
 ('em77.sendgrid.net','TXT','v=spf1 ip4:9.9.9.0/24 ?all','ok'),
 ('paypa1-billing.com','TXT','v=spf1 include:docusign.files.top -all','ok'),
 ('cornerbakery.example','TXT','google-site=abc','ok'),
 ('_dmarc.github.com','TXT','v=DMARC1; p=reject; aspf=s','ok'),
 ('_dmarc.google.com','TXT','v=DMARC1; p=none; sp=quarantine; adkim=r','ok'),
 ('_dmarc.stripe.com','TXT','v=DMARC1; p=quarantine','ok'),
 ('_dmarc.hsbc.com','TXT','v=DMARC1; p=reject','ok'),
 ('_dmarc.riverside.org','TXT','v=DMARC1;p=none','ok'),
 ('_dmarc.netflix.com','TXT','','temporary'),
 ('_dmarc.harbor.com','TXT','v=DMARC1; p=reject; adkim=s; aspf=r','ok'),
 ('_dmarc.micros0ft.ru','TXT','v=DMARC1; p=none','ok')
) AS n(name, rdtype, value, status)"""

# Outcome of checking each DKIM signature.
VIEWS["dkim_results"] = """
SELECT d.doc_id AS msg_id, r.idx, r.domain, r.outcome
FROM documents d JOIN (SELECT * FROM (VALUES
 (0,0,'github.com','pass'),(0,1,'relay.example','fail'),
 (1,0,'harbor.com','fail'),(2,0,'stripe.com','temporary'),
 (3,0,'lakeside.com','fail'),(3,1,'mail.hsbc.com','temporary'),
 (4,0,'adobe.com','temporary'),(4,1,'adobe.com','pass')
) AS v(k, idx, domain, outcome)) r ON r.k = d.doc_id % 7"""

# Stored analysis results: two versions of some records, stubs, owners and old scores.
VIEWS["records_log"] = """
SELECT concat('r', CAST(d.doc_id AS STRING)) AS id, e.user_id, e.ts AS created_at, v.version,
       concat('m ', CAST(d.doc_id AS STRING), ' (', d.source, ').eml') AS filename,
       CASE WHEN v.version = 0 THEN 0 ELSE CAST((d.doc_id * 37) % 190 AS INT) END AS risk_score,
       CASE WHEN v.version = 0 THEN 'Pending'
            WHEN (d.doc_id * 37) % 190 >= 90 THEN 'Critical'
            WHEN (d.doc_id * 37) % 190 >= 70 THEN 'High'
            WHEN (d.doc_id * 37) % 190 >= 30 THEN 'Medium' ELSE 'Low' END AS verdict,
       CASE WHEN v.version = 0 THEN '{}'
            WHEN d.doc_id % 3 = 0 THEN concat('{"subject":"', p.subject, '","from_addr":"', s.localpart, '@', s.domain, '","raw_score":5}')
            ELSE concat('{"subject":"', p.subject, '","from_addr":"', s.localpart, '@', s.domain, '"}') END AS finding_json
FROM documents d JOIN events e ON e.event_id = d.doc_id
JOIN (SELECT * FROM (VALUES (0),(1)) AS w(version)) v ON v.version = 0 OR d.doc_id % 10 <> 3
JOIN senders s ON s.k = d.doc_id % 16 JOIN phrases_dim p ON p.k = d.doc_id % 9"""

_SOURCE = re.compile(r"\b(?:FROM|JOIN|from|join)\s+([a-z_0-9]+)\b")


def needed(sql: str) -> list[str]:
    """Views a query reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_SOURCE.findall(text)):
            if word in VIEWS and word not in order:
                visit(VIEWS[word])
                if word not in order:
                    order.append(word)
    visit(sql)
    return order


def with_clause(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it needs (and ``extra`` CTEs, in their order)."""
    extra = extra or {}
    names = needed(sql + " " + " ".join(extra.values()))
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({q.strip()})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)}\n{sql.strip()}" if parts else sql.strip()
