"""A labelled set of messages for measuring accuracy, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attachments, auth, content, evaluation, headers, links, scoring

SCHEMA = ("id string, label string, category string, from_raw string, subject string, "
          "body_plain string, body_html string, reply_to_raw string, sender_raw string, "
          "return_path_raw string, auth string, filename string")

# (id, label, category, from, subject, plain, html, reply-to, sender, return-path, auth, attachment)
CASES = [
    ("code_review", "benign", "developer", "GitHub <robot@github.com>", "Review requested on tern/wing", "Change 18 waits for you: https://github.com/tern/wing/pull/18", "", "", "", "", "pass", ""),
    ("new_device", "benign", "account", "Google <no-reply@accounts.google.com>", "New device", "A new device signed in. Details: https://accounts.google.com/devices", "", "", "", "", "pass", ""),
    ("cloud_bill", "benign", "invoice", "Stripe <billing@stripe.com>", "Invoice 5512", "Invoice #5512 is ready. Payment due on Friday. https://dashboard.stripe.com/i", "", "", "", "", "pass", ""),
    ("order_sent", "benign", "shop", "Amazon <orders@amazon.com>", "Your parcel left", "Parcel 88 left the depot. https://www.amazon.com/track", "", "", "", "", "pass", ""),
    ("money_sent", "benign", "payment", "PayPal <mail@paypal.com>", "You paid the florist", "You paid 12 EUR. https://www.paypal.com/activity", "", "", "", "", "pass", ""),
    ("bank_note", "benign", "bank", "Chase <mail@alerts.chase.com>", "Deposit posted", "A deposit of 20 was posted to your account.", "", "", "", "", "pass", ""),
    ("weekly_mail", "benign", "newsletter", "Garden Weekly <mail@news.gardenweekly.org>", "Bulbs in spring", "", '<p>Bulbs <a href="https://gardenweekly.org/a?next=https://gardenweekly.org/b">more</a></p>', "", "", "", "pass", ""),
    ("reset_link", "benign", "password", "GitHub <robot@github.com>", "Reset link", "We got a password change request. https://github.com/reset/1", "", "", "", "", "pass", ""),
    ("team_deadline", "benign", "business", "Lena <lena@northmill.com>", "Numbers please", "Please send the numbers within 24 hours, immediate action required by the board.", "", "", "", "", "pass", ""),
    ("small_shop", "benign", "newsletter", "Bakery <hello@littlebakery.example>", "Fresh bread", "New loaves this week.", "", "", "", "", "none", ""),
    ("sign_paper", "benign", "signature", "DocuSign <mail@docusign.net>", "Lease to sign", "Please sign: https://app.docusign.net/sign/1", "", "", "", "", "pass", ""),
    ("meeting", "benign", "business", "Tom <tom@quarry.org>", "Minutes", "The minutes of today.", "", "", "", "", "pass", ""),
    ("campus", "benign", "university", "Office <office@nust.edu.pk>", "Form received", "We have your form.", "", "desk@portal.nust.edu.pk", "", "", "pass", ""),
    ("support_reply", "benign", "business", "Northmill <no-reply@northmill.com>", "Ticket 9", "Ticket 9 is open.", "", "help@northmill.com", "", "", "pass", ""),
    ("helpdesk", "benign", "helpdesk", "Quarry <no-reply@quarry.org>", "Request 4", "Thanks for writing.", "", "quarry@quarry.zendesk.com", "", "", "pass", ""),
    ("esp_bounce", "benign", "esp", "Lakeside <news@lakeside.com>", "News in May", "See https://lakeside.com/may", "", "team@mail.lakeside.com", "Lakeside <b@em9.sendgrid.net>", "b@em9.sendgrid.net", "pass", ""),
    ("charity", "benign", "esp", "Shelter <news@shelter.org>", "Thank you", "", '<p>Dear friends <img src="https://cdn.mailchimp.com/p.gif" width="1" height="1"></p>', "", "", "r@mailchimp.com", "pass", ""),
    ("statement", "benign", "esp", "Coinly <mail@coinly.example>", "Statement", "Your statement is in the portal.", "", "", "Coinly <b@eu.amazonses.com>", "b@eu.amazonses.com", "pass", ""),
    ("bank_reply", "benign", "bank", "HSBC <mail@hsbc.com>", "Statement", "Sign in at https://www.hsbc.com", "", "care@secure.hsbc.com", "", "", "pass", ""),
    ("fruit_trade", "benign", "business", "Pineapple Farm <hi@pineapple-farm.com>", "Follow-ups", "Our follow-ups from the fair.", "", "", "", "", "pass", ""),
    ("photo_mail", "benign", "business", "Ida <ida@quarry.org>", "Picture", "The picture you wanted.", "", "", "", "", "pass", "picture.jpg"),
    ("fake_wallet", "malicious", "phishing", "PayPal Care <care@paypa1-safety.com>", "Account limited", "", '<p>Please verify your account and confirm your password <a href="http://185.20.30.40/in">here</a></p>', "care@wallet.tk", "", "", "fail", ""),
    ("boss_wire", "malicious", "bec", "Director <boss@northmill-office.ml>", "Quiet favour", "Arrange a wire transfer today for invoice #77. Respond immediately.", "", "", "", "", "none", ""),
    ("fake_desk", "malicious", "phishing", "Help Desk <desk@micros0ft-desk.ru>", "Password expired", "Your password expired after an unauthorized login attempt. Enter credentials at http://micros0ft-desk.ru/x", "", "", "", "", "fail", ""),
    ("dropper", "malicious", "malware", "Billing <bills@parts-supply.tk>", "Overdue", "See the attached invoice #31 and arrange the wire transfer.", "", "", "", "", "none", "bill_31.pdf.exe"),
    ("fake_sign", "malicious", "spoofing", "DocuSign <mail@d0cusign.xyz>", "Papers wait", "Verify your account to read them: http://d0cusign.xyz/read", "", "", "", "", "fail", ""),
    ("reply_trap", "malicious", "phishing", "Netflix <mail@netflix.com>", "Confirm password", "Confirm your password at http://netflix-renewal.tk/now within 24 hours.", "", "member@gmail.com", "", "", "pass", ""),
    ("brand_trap", "malicious", "phishing", "Adobe <mail@adobe.com>", "Verify account", "", '<p>Verify account, enter credentials <a href="http://adobe-login.icu/x">now</a></p>', "desk@adobe-login.icu", "", "", "pass", ""),
]


def labelled_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, SCHEMA)


def judged(cases: DataFrame) -> DataFrame:
    """Verdicts of labelled messages; claims are taken as given, chains as unremarkable."""
    none = F.expr("cast(array() as array<string>)")
    exe = F.when(F.col("filename").endswith(".exe"), F.unhex(F.lit("4D5A90"))) \
        .otherwise(F.unhex(F.lit("FFD8FFE0")))
    file = F.array(F.struct("filename", exe.alias("content")))
    d = cases.withColumns({
        "msg_id": F.col("id"), "to_raw": F.lit("reader@quarry.org"), "cc_raw": F.lit(""),
        "bcc_raw": F.lit(""), "message_id": F.lit("<1@quarry.org>"),
        "date": F.lit("Sat, 01 Aug 2026 12:00:00 +0000"), "received_chain": none,
        "authentication_results": none, "spf": F.col("auth"), "dkim": F.col("auth"),
        "dmarc": F.col("auth"), "spf_details": F.lit(""), "dkim_details": F.lit(""),
        "dmarc_details": F.lit(""), "auth_inconsistencies": none, "hop_count": F.lit(3),
        "headers": F.expr("cast(array() as array<struct<pos:int,name:string,value:string>>)"),
        "has_body": F.lit(True),
        "attachments": F.when(F.col("filename") != "", file).otherwise(F.expr(
            "cast(array() as array<struct<filename:string,content:binary>>)"))})
    d = scoring.with_trust(headers.header_findings(headers.with_identity(d)))
    d = attachments.with_attachments(content.with_match_text(links.with_links(d)))
    d = d.withColumn("signals", F.concat(
        links.link_signals(), headers.identity_signals(), content.content_signals(),
        auth.auth_signals(), headers.header_signals(), attachments.attachment_signals()))
    return scoring.verdicts(d, keep=("label", "category")) \
        .withColumn("malicious", F.col("label") == "malicious")


def measure(spark: SparkSession) -> DataFrame:
    return evaluation.accuracy(evaluation.confusion(judged(labelled_messages(spark))))
