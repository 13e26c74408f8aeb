"""Score mapping, risk buckets, signal records and saturation.

Signals of one message live in an ``array<struct>`` on the message's own row, so
damping, capping and summing need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import among, col, string_array, text
from . import fixed_values as fv

SIGNAL = ("struct<indicator:string,family:string,weight:int,original_weight:int,"
          "strength:string,severity:string,evidence:string>")
SIGNALS = f"array<{SIGNAL}>"


def severity_of(weight) -> Column:
    w = col(weight)
    return (F.when(w >= 30, F.lit("Critical")).when(w >= 20, F.lit("High"))
            .when(w >= 10, F.lit("Medium")).otherwise(F.lit("Low")))


def family_of(indicator) -> Column:
    """Evidence family of an indicator name: first family with a matching needle."""
    name = F.lower(text(indicator))
    chain = None
    for family, needles in fv.FAMILY_NEEDLES:
        hit = F.contains(name, F.lit(needles[0]))
        for needle in needles[1:]:
            hit = hit | F.contains(name, F.lit(needle))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain.otherwise(fv.DEFAULT_FAMILY)


def signal(indicator, weight, strength, evidence, family: str, severity=None) -> Column:
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)
    w = value(weight).cast("int")
    return F.struct(
        value(indicator).alias("indicator"),
        F.lit(family).alias("family"),
        w.alias("weight"),
        w.alias("original_weight"),
        value(strength).alias("strength"),
        (severity_of(w) if severity is None else value(severity)).alias("severity"),
        F.coalesce(value(evidence), F.lit("")).alias("evidence"))


def no_signals() -> Column:
    return F.expr(f"cast(array() as {SIGNALS})")


def display_score(raw) -> Column:
    """Unbounded weight total to 0-100: identity, compressed 4:1, then asymptotic."""
    r = F.greatest(col(raw), F.lit(0)).cast("double")
    span = (fv.COMPRESSED_DISPLAY - fv.LINEAR_CEILING) / (fv.COMPRESSED_CEILING - fv.LINEAR_CEILING)
    return (
        F.when(r <= fv.LINEAR_CEILING, r)
        .when(r <= fv.COMPRESSED_CEILING,
              F.bround(fv.LINEAR_CEILING + (r - fv.LINEAR_CEILING) * span))
        .otherwise(F.least(F.lit(99.0), F.bround(
            fv.COMPRESSED_DISPLAY + 10 * (1 - F.lit(float(fv.COMPRESSED_CEILING)) / r))))
    ).cast("int")


def risk_bucket(display) -> Column:
    d = col(display)
    return (F.when(d >= fv.CRITICAL_FROM, F.lit("Critical")).when(d >= fv.HIGH_FROM, F.lit("High"))
            .when(d >= fv.MEDIUM_FROM, F.lit("Medium")).otherwise(F.lit("Low")))


def dampened(signals, trusted) -> Column:
    """Soft indicators of an authenticated trusted sender weigh nothing."""
    quiet = F.transform(col(signals), lambda s: F.when(
        among(s["indicator"], fv.DAMPENED_INDICATORS),
        s.withField("weight", F.lit(0))).otherwise(s))
    return F.when(col(trusted), quiet).otherwise(col(signals))


def take_within(signals, budget: int, most: int) -> Column:
    """Strongest ``most`` signals, cut to a shared weight budget; spent ones are dropped."""
    ranked = F.slice(by_weight(signals), 1, most)
    spent = F.transform(ranked, lambda s, i: F.aggregate(
        F.slice(ranked, F.lit(1), i), F.lit(0), lambda a, x: a + x["weight"]))
    cut = F.zip_with(ranked, spent, lambda s, used: s.withField(
        "weight", F.greatest(F.lit(0), F.least(s["weight"], F.lit(budget) - used))))
    return F.filter(cut, lambda s: s["weight"] > 0)


def by_weight(signals) -> Column:
    """Signals by falling weight, earlier position first among equals."""
    numbered = F.transform(col(signals), lambda s, i: F.struct(
        (-s["weight"]).alias("w"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def saturated(signals) -> Column:
    """Cap every evidence family, strongest signal first; order is preserved.

    One fold over the weight-ranked signals carries what each family has used.
    """
    families = list(fv.FAMILY_CAPS)
    caps = F.array(*[F.lit(v) for v in fv.FAMILY_CAPS.values()])
    names = string_array(families)
    ranked = F.array_sort(F.transform(col(signals), lambda s, i: F.struct(
        (-s["weight"]).alias("w"), i.alias("i"),
        F.array_position(names, s["family"]).cast("int").alias("f"))))

    def step(acc, x):
        left = F.element_at(acc["left"], x["f"])
        allowed = F.greatest(F.lit(0), F.least(-x["w"], left))
        return F.struct(
            F.transform(acc["left"], lambda v, j: F.when(j + 1 == x["f"], v - allowed).otherwise(v))
            .alias("left"),
            F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), allowed.alias("a"))))
            .alias("out"))

    start = F.struct(caps.alias("left"),
                     F.expr("cast(array() as array<struct<i:int,a:int>>)").alias("out"))
    allowed = F.array_sort(F.aggregate(ranked, start, step, lambda acc: acc["out"]))
    return F.zip_with(col(signals), allowed, lambda s, a: s.withField("weight", a["a"]))


def total_weight(signals) -> Column:
    return F.aggregate(col(signals), F.lit(0), lambda acc, s: acc + s["weight"])


def active(signals, strength: str | None = None) -> Column:
    def keep(s):
        cond = s["weight"] > 0
        return cond if strength is None else cond & (s["strength"] == strength)
    return F.filter(col(signals), keep)


def gate(display, strong_families, strong_weight) -> tuple[Column, Column]:
    """(risk level, machine reason); High needs two independent strong families."""
    d, fams, sw = col(display), col(strong_families), col(strong_weight)
    n = F.size(fams)
    bucket = risk_bucket(d)
    promoted = (n >= fv.MIN_STRONG_FAMILIES) & (d >= fv.PROMOTE_FROM)
    level = (
        F.when(promoted & (d >= fv.CRITICAL_FROM), F.lit("Critical"))
        .when(promoted, F.lit("High"))
        .when(bucket.isin("Low", "Medium"), bucket)
        .otherwise(F.lit("Medium")))
    reason = (
        F.when(promoted, F.concat(F.lit("corroborated:families="), n))
        .when(bucket.isin("Low", "Medium"), F.concat(F.lit("band:"), bucket))
        .when((n == 1) & F.array_contains(fams, "authentication"),
              F.concat(F.lit("demoted:authentication-only:weight="), sw))
        .otherwise(F.concat(F.lit("demoted:uncorroborated:weight="), sw,
                            F.lit(":families="), n)))
    return level, reason


def confidence(factors) -> tuple[Column, Column]:
    """(score or NULL, label) from array<struct<name, applicable, satisfied>>."""
    applicable = F.filter(col(factors), lambda f: f["applicable"])
    held = F.size(F.filter(applicable, lambda f: f["satisfied"]))
    missing = F.transform(F.filter(applicable, lambda f: ~f["satisfied"]), lambda f: f["name"])
    span = fv.CONFIDENCE_CEILING - fv.CONFIDENCE_FLOOR
    score = F.when(held > 0, F.bround(
        fv.CONFIDENCE_FLOOR + span * held.cast("double") / F.size(applicable)).cast("int"))
    label = None
    for floor, name in fv.CONFIDENCE_LABELS:
        label = F.when(score >= floor, name) if label is None else label.when(score >= floor, name)
    label = F.when(F.size(missing) > 0, F.concat(
        label, F.lit(" - limited by missing "), F.array_join(missing, ", "))).otherwise(label)
    return score, F.when(held > 0, label).otherwise(F.lit("Insufficient evidence"))


def contribution(weight, total) -> Column:
    return F.when((col(total) > 0) & (col(weight) > 0),
                  F.bround(F.lit(100.0) * col(weight) / col(total), 1)).otherwise(F.lit(0.0))


def contribution_label(weight) -> Column:
    return F.when(F.coalesce(col(weight), F.lit(0)) <= 0, F.lit("CAPPED")) \
        .otherwise(F.concat(F.lit("+"), col(weight).cast("string")))


def confidence_label(score, label) -> Column:
    shown = F.when(text(label) == "", F.lit("Unknown")).otherwise(text(label))
    return F.concat(F.coalesce(F.concat(col(score).cast("string"), F.lit("%")), F.lit("N/A")),
                    F.lit(" ("), shown, F.lit(")"))


def trust_level(score) -> Column:
    return F.lit(100) - F.least(F.greatest(F.coalesce(col(score), F.lit(0)), F.lit(0)), F.lit(100))


def verdict_headline(level) -> Column:
    return (F.when(col(level).isin("High", "Critical"), F.lit("MALICIOUS"))
            .when(col(level) == "Medium", F.lit("SUSPICIOUS")).otherwise(F.lit("CLEAN")))
