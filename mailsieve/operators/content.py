"""Wording rules over subject and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.base import compact
from ..functions.scores import signal
from ..functions.text import first_phrase, match_text, normalise

FAMILY = "message content"


def with_match_text(messages: DataFrame) -> DataFrame:
    """Add the texts that wording rules read, each also in lower case."""
    d = messages.withColumns({"subject_text": normalise("subject"),
                              "match_text": match_text("body_plain", "body_html")})
    return d.withColumns({"subject_lower": F.lower("subject_text"),
                          "match_lower": F.lower("match_text")})


def phrase_hits(families=None) -> dict[str, Column]:
    """family -> first matching phrase (pattern order; body before subject) or NULL.

    ``families`` may replace the built-in rules; same shape as the fixed values.
    """
    out = {}
    for family, _, _, _, patterns in fv.PHRASE_FAMILIES if families is None else families:
        out[family] = F.coalesce(*[
            first_phrase(words, pattern, ("match_text", "match_lower"),
                         ("subject_text", "subject_lower")) for words, pattern in patterns])
    return out


def keyword_hits(words=None) -> Column:
    body, subject = F.col("match_lower"), F.col("subject_lower")
    return compact(*[F.when(F.contains(body, F.lit(w)) | F.contains(subject, F.lit(w)), F.lit(w))
                     for w in (fv.SUSPICIOUS_KEYWORDS if words is None else words)])


def keyword_signal(keywords=None) -> Column:
    """Signal of the keywords found, or NULL."""
    found = keyword_hits(keywords)
    name, weight, strength = fv.KEYWORD_INDICATOR
    return F.when(F.size(found) > 0, signal(name, weight, strength, F.array_join(found, ", "), FAMILY))


def content_signals(families=None, keywords=None) -> Column:
    """Signals of the wording rules.  Expects :func:`with_match_text` columns."""
    hits = phrase_hits(families)
    signals = [keyword_signal(keywords)]
    for family, indicator, w, s, _ in fv.PHRASE_FAMILIES if families is None else families:
        signals.append(F.when(hits[family].isNotNull(),
                              signal(indicator, w, s, hits[family], FAMILY)))
    return compact(*signals)
