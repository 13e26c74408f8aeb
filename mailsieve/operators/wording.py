"""Wording rules as a table, found in one pass over each text by an automaton of their words.

A rule is a row (family, indicator, weight, strength, pos, words, pattern).  An Aho-Corasick automaton
over the words of all rules reads a text once, whatever the number of rules, and names the rules all of
whose words are there; only these are verified by their regular expressions, on the message's own row.
No body is shuffled and no message meets a rule whose words it lacks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, let, text
from ..functions.scores import signal
from .scale import durable, prefix_sums

RULES = "family string, indicator string, weight int, strength string, pos int, words array<string>, pattern string"
RULE_BYTES = 16 << 20      # of rules that one automaton holds; more of them go in rounds
FAMILY = "message content"

_CANDIDATES = ("array<struct<family:string,rules:array<struct<indicator:string,weight:int,strength:string,"
               "pattern:string,plain:string,body:boolean,subject:boolean>>>>")
_HIT = "struct<family:string,indicator:string,weight:int,strength:string,evidence:string>"


def checked(rules: DataFrame) -> DataFrame:
    """Rules as they are applied: words in lower case without nulls and blanks, repeated rows once.

    A blank pattern counts as none.  Reading the result evaluates every pattern once, so that one that is no
    regular expression fails here, before any message is read.
    """
    words = F.array_distinct(F.filter(F.transform(F.coalesce("words", F.expr("cast(array() as array<string>)")), F.lower),
                                      lambda w: w.isNotNull() & (w != "")))
    return rules.select(
        "family", "indicator", F.col("weight").cast("int"), "strength", F.col("pos").cast("int"), words.alias("words"),
        blank_to_null("pattern").alias("pattern")).distinct() \
        .withColumn("pattern", F.concat(F.lit("(?iU)"), "pattern")) \
        .withColumn("usable", F.coalesce(F.expr("regexp_count('', pattern)"), F.lit(0)) >= 0)


def rounds(rules: DataFrame, most: int = RULE_BYTES) -> Iterator[list]:
    """The rules in order of ``pos`` (null last, then by family and pattern), in lists of at most ``most``
    bytes (a longer rule is a list of its own)."""
    size = sum(F.octet_length(text(c)) for c in ("family", "indicator", "strength", "pattern")) \
        + F.octet_length(F.array_join("words", "")) + 16
    sized = checked(rules).withColumn("bytes", size)
    order = [F.asc_nulls_last("pos"), "family", "pattern", "words", "indicator", "weight", "strength"]
    if (sized.agg(F.sum("bytes")).first()[0] or 0) <= most:
        yield sized.orderBy(*order).collect()
        return
    place = [F.coalesce("pos", F.lit(2 ** 31 - 1)).alias("at"), *[text(c).alias(f"o_{c}") for c in ("family", "pattern")],
             F.xxhash64("words", "indicator", "weight", "strength").alias("o_rest")]
    ordered = sized.select("*", *place, F.lit(0).alias("all"))
    dealt = durable(prefix_sums(ordered, ["all"], ["at", "o_family", "o_pattern", "o_rest"], {"before": F.col("bytes")})
                    .withColumn("round", F.floor((F.col("before") - F.col("bytes")) / most)))
    for number in range(dealt.agg(F.max("round")).first()[0] + 1):
        some = dealt.where(F.col("round") == number).orderBy(*order).collect()
        if some:
            yield some


def finder(rules: list) -> Callable[[str | None, str | None], list]:
    """A function that names, by family, the rules all of whose words are in a body or in a subject (both in
    lower case).  Each rule waits under that one of its words which the fewest rules ask for, so a word in most rules costs nothing."""
    from ahocorasick import Automaton
    common = Counter(w for r in rules for w in r.words)
    waiting, free, automaton = defaultdict(list), [], Automaton()
    for at, r in enumerate(rules):
        if r.words:
            waiting[min(r.words, key=lambda w: (common[w], -len(w), w))].append(at)
        elif r.pattern is not None:
            free.append(at)
    for word in common:
        automaton.add_word(word, word)
    if common:
        automaton.make_automaton()
    needed = [frozenset(r.words) for r in rules]

    def present(value: str | None) -> set[int]:
        if not value:
            return set(free)
        seen = {word for _, word in automaton.iter(value)} if common else set()
        return {at for word in seen for at in waiting.get(word, ()) if needed[at] <= seen}.union(free)

    def find(body: str | None, subject: str | None) -> list:
        in_body, in_subject = present(body), present(subject)
        families: dict = {}
        for at in sorted(in_body | in_subject):
            r = rules[at]
            families.setdefault(r.family, []).append({
                "indicator": r.indicator, "weight": r.weight, "strength": r.strength, "pattern": r.pattern,
                "plain": " ".join(r.words), "body": at in in_body, "subject": at in in_subject})
        return [{"family": f, "rules": found} for f, found in families.items()]

    return find


def _candidates(rules: list):
    """Arrow function (lower-cased body, lower-cased subject) -> candidate rules by family."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType
    kind = to_arrow_type(DataType.fromDDL(_CANDIDATES))

    @F.arrow_udf(_CANDIDATES)
    def named(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find = finder(rules)
        for bodies, subjects in batches:
            yield pa.array([find(b.as_py(), s.as_py()) for b, s in zip(bodies, subjects)], type=kind)

    return named


def _first_hit(family: Column) -> Column:
    """The first rule of a family whose expression matches, body before subject; NULL without one."""
    def evidence(r):
        found = [F.when(r[place], F.nullif(F.call_function("regexp_extract", F.col(words), r["pattern"], F.lit(0)), F.lit("")))
                 for place, words in (("body", "match_text"), ("subject", "subject_text"))]
        return F.when(r["pattern"].isNull(), r["plain"]).otherwise(F.coalesce(*found))

    def hit(r):
        return let(lambda m: F.when(m["e"].isNotNull(), F.struct(
            family["family"].alias("family"), r["indicator"].alias("indicator"), r["weight"].alias("weight"),
            r["strength"].alias("strength"), m["e"].alias("evidence"))), e=evidence(r))

    return F.aggregate(family["rules"], F.lit(None).cast(_HIT), lambda first, r: F.coalesce(first, hit(r)))


def with_wording_hits(messages: DataFrame, rules: DataFrame, most: int = RULE_BYTES) -> DataFrame:
    """Add ``wording_hits``: of each family of ``rules`` the first rule (by ``pos``) that a message matches.

    ``messages`` has the columns of ``content.with_match_text``; a column ``wording_hits`` of its own is replaced, others stay.
    A rule matches where all of its words occur in the body, or all in the subject, whatever their case, and its
    pattern matches there (without a pattern the words suffice and are the evidence).  A rule without words is tried on
    every text, one with neither words nor pattern matches nothing.  Of equal ``pos`` the smaller (family, pattern) comes
    first; a null ``pos`` comes last; a null family is a family; repeated rules count once.  No rules, null or empty
    texts give an empty array.  Texts are read whole, in time linear in their length and hits.  Rules beyond ``most``
    bytes go in rounds, each with a reliable checkpoint, so neither the driver nor a task holds more of them.
    """
    d = messages.withColumn("wording_hits", F.expr(f"cast(array() as array<{_HIT}>)"))
    for number, some in enumerate(rounds(rules, most)):
        if number:
            d = durable(d)
        named = _candidates(some)
        d = d.withColumn("_named", named("match_lower", "subject_lower"))
        new = F.array_compact(F.transform("_named", _first_hit))
        if number:
            known = F.transform("wording_hits", lambda h: F.coalesce(F.concat(F.lit("f"), h["family"]), F.lit("n")))
            new = F.filter(new, lambda h: ~F.array_contains(known, F.coalesce(F.concat(F.lit("f"), h["family"]), F.lit("n"))))
        d = d.withColumn("wording_hits", F.concat("wording_hits", new) if number else new).drop("_named")
    return d


def wording_signals() -> Column:
    """Signals of the hits, in the order of their families' first candidates."""
    return F.transform("wording_hits", lambda h: signal(
        h["indicator"], F.coalesce(h["weight"], F.lit(0)), h["strength"], h["evidence"], FAMILY))


def fixed_rules(spark) -> DataFrame:
    """The built-in families as such a table."""
    from ..functions import fixed_values as fv
    rows = [(family, indicator, weight, strength, words, pattern)
            for family, indicator, weight, strength, patterns in fv.PHRASE_FAMILIES for words, pattern in patterns]
    return spark.createDataFrame([(*r[:4], pos, *r[4:]) for pos, r in enumerate(rows)], RULES)
