"""Dates as mail and registries write them, and how delays are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let, strip, text

# Zone names of RFC 2822.
NAMED_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_mail_date(value) -> Column:
    """RFC 2822 date to a timestamp; a missing zone is read as UTC, junk is NULL."""
    names = F.create_map(*[F.lit(x) for kv in NAMED_ZONES.items() for x in kv])

    def decide(v):
        raw = v["raw"]
        date = F.regexp_extract(raw, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1)
        clock = F.regexp_extract(raw, r"^\d{1,2} [A-Za-z]{3} \d{4} (\d{1,2}:\d{2}(?::\d{2})?)", 1)
        seconds = F.when(F.length(clock) <= 5, F.lit(":00")).otherwise(F.lit(""))
        zone = F.upper(F.regexp_extract(raw, r" ([+-]\d{4}|[A-Za-z]{1,5})$", 1))
        offset = F.when(zone.rlike(r"^[+-]"), zone) \
            .otherwise(F.coalesce(F.try_element_at(names, zone), F.lit("+0000")))
        whole = F.concat(F.initcap(date), F.lit(" "), clock, seconds, F.lit(" "), offset)
        return F.when((date != "") & (clock != ""),
                      F.try_to_timestamp(whole, F.lit("d MMM yyyy H:mm:ss Z")))

    bare = F.regexp_replace(text(value), r"\([^()]*\)", " ")
    bare = F.regexp_replace(strip(bare), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    return let(decide, raw=strip(F.regexp_replace(bare, r"\s+", " ")))


def parse_registry_date(value) -> Column:
    """Registration date in any of the formats registries use."""
    raw = strip(text(value))
    attempts = [F.try_to_timestamp(raw.substr(1, n), F.lit(fmt)) for n, fmt in (
        (19, "yyyy-MM-dd HH:mm:ss"), (19, "yyyy-MM-dd'T'HH:mm:ss"), (10, "yyyy-MM-dd"),
        (11, "d-MMM-yyyy"), (10, "d.M.yyyy"), (10, "yyyy.M.d"), (10, "yyyy/M/d"))]
    zoned = F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"),
                               F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(zoned, *attempts)


def seconds_between(earlier, later) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def delay_label(seconds, hop_number) -> Column:
    s = F.floor(F.abs(col(seconds))).cast("bigint")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(col(hop_number) <= 1, F.lit("Origin"))
        .when(col(seconds) < 0, F.format_string("-%ds ⚠️", s))
        .when(s < 60, F.format_string("+%ds", s))
        .when(s < 3600, F.format_string("+%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("+%dh %dm", hours, F.floor((s % 3600) / 60)))
    )
