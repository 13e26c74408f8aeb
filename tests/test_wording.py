"""Wording rules from a table: the automaton against the literal form and against all pairs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import fixed_values as fv
from mailsieve.operators import content, wording
from mailsieve.plans.analysis import analyse
from mailsieve.plans.message_queries import mail_messages
from mailsieve.plans.tables import letters
from mailsieve.plans.views import AS_OF

from .conftest import SF

TEXTS = "k int, match_text string, subject_text string, wording_hits string"


def texts(spark, rows):
    d = spark.createDataFrame([(i, *r, "theirs") for i, r in enumerate(rows)], TEXTS)
    return d.withColumns({"match_lower": F.lower("match_text"), "subject_lower": F.lower("subject_text")})


def hits(d):
    return {r.k: [tuple(h) for h in r.wording_hits] for r in d.select("k", "wording_hits").collect()}


def brute_force(rules, rows):
    """Every rule against every text."""
    out = {}
    last = 2 ** 31
    for k, (body, subject) in enumerate(rows):
        found, named = {}, []
        for family, indicator, weight, strength, _, words, pattern in sorted(
                rules, key=lambda r: (last if r[4] is None else r[4], r[0] or "", "" if r[6] is None else r[6])):
            words = list(dict.fromkeys(w.lower() for w in words or [] if w))
            if not words and not pattern:
                continue
            holds = [t for t in (body, subject) if all(w in (t or "").lower() for w in words)]
            if not holds:
                continue
            if family not in named:
                named.append(family)
            evidence = " ".join(words) if not pattern else next(
                (m[0] for t in holds if t is not None and (m := re.search(f"(?i){pattern}", t)) and m[0]), None)
            if evidence and family not in found:
                found[family] = (family, indicator, weight, strength, evidence)
        out[k] = [found[f] for f in named if f in found]
    return out


def random_case(seed):
    r = random.Random(seed)
    letters_ = "ab c"
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(30)]
    rules = [(f"f{r.randrange(40)}", f"i{n % 7}", n % 9, "weak", n, r.sample(words, r.randrange(3)),
              r.choice([None, "", r"\b" + r.choice(words) + r"\b", r.choice(words) + r"\s+" + r.choice(words)])) for n in range(150)]
    rows = [("".join(r.choice(letters_ + "B") for _ in range(r.randrange(40))), "".join(r.choice(letters_) for _ in range(r.randrange(9))))
            for _ in range(200)]
    return rules, rows + [(None, None), ("", ""), (None, "abc ab"), ("ABC AB", None)]


def test_random_rules_against_all_pairs(spark):
    rules, rows = random_case(7)
    table = spark.createDataFrame(rules + rules[:20], wording.RULES)
    got = hits(wording.with_wording_hits(texts(spark, rows), table))
    want = brute_force(rules, rows)
    assert got == want
    assert sum(map(len, want.values())) > 1000


def test_rounds_give_the_same_hits(spark):
    rules, rows = random_case(8)
    table = spark.createDataFrame(rules, wording.RULES)
    parts = list(wording.rounds(table, 1000))
    assert len(parts) > 3 and sum(map(len, parts)) == len(rules)
    assert [r.pos for part in parts for r in part] == [r[4] for r in rules]
    got = hits(wording.with_wording_hits(texts(spark, rows), table, 1000))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute_force(rules, rows).items()}


def test_nulls_ties_and_empty_tables(spark):
    rules = [(None, "n", None, None, 1, None, "b+"), ("x", "late", 1, "weak", None, ["a"], None), ("x", "tie b", 1, "weak", 5, [None, "", "A"], "a."),
             ("x", "tie a", 1, "weak", 5, ["a"], "a"), ("none", "i", 1, "weak", 0, None, None), ("none", "i", 1, "weak", 0, [], " *")]
    rows = [("abb", None), (None, None), ("", "A"), ("zz", "zz")]
    table = spark.createDataFrame(rules, wording.RULES)
    assert hits(wording.with_wording_hits(texts(spark, rows), table)) == {
        0: [(None, "n", None, None, "bb"), ("x", "tie a", 1, "weak", "a")], 1: [], 2: [("x", "tie a", 1, "weak", "A")], 3: []}
    none = wording.with_wording_hits(texts(spark, rows), table.limit(0))
    assert hits(none) == {i: [] for i in range(4)}
    assert wording.with_wording_hits(texts(spark, rows).limit(0), table).count() == 0
    assert none.columns.count("wording_hits") == 1
    weights = wording.with_wording_hits(texts(spark, rows), table).select("k", wording.wording_signals().alias("s")).where("k = 0").first().s
    assert [x.weight for x in weights] == [0, 1]


def test_a_broken_pattern_fails_before_any_message(spark):
    table = spark.createDataFrame([("x", "i", 1, "weak", 1, ["a"], "(unclosed")], wording.RULES)
    with pytest.raises(Exception, match="PATTERN"):
        wording.with_wording_hits(texts(spark, [("b", "b")]), table)


def test_built_in_rules_as_a_table_give_the_same_verdicts(spark, tmp_path):
    letters(spark, SF).withColumn("created_at", F.timestamp_seconds("msg_id")).write.parquet(str(tmp_path / "mail"))
    mail = spark.read.parquet(str(tmp_path / "mail"))
    shown = ("msg_id", "raw_score", "score", "signals")
    left = analyse(mail, AS_OF, rules=wording.fixed_rules(spark)).select(*shown).collect()
    assert sorted(left) == sorted(analyse(mail, AS_OF).select(*shown).collect()) and len(left) == mail.count()
    own = spark.createDataFrame([("greeting", "Greeting", 40, "strong", 0, ["see", "soon"], r"\bsee\s+you\s+soon\b")], wording.RULES)
    seen = [s for r in analyse(mail, AS_OF, rules=own, keywords=[]).select("signals").collect() for s in r.signals]
    names = {s.indicator for s in seen}
    assert "Greeting" in names and not names & ({f[1] for f in fv.PHRASE_FAMILIES} | {fv.KEYWORD_INDICATOR[0]})
    assert sum(s.indicator == "Greeting" for s in seen) == mail.where("body_plain LIKE '%See you soon%'").count()


def test_many_rules_and_long_texts_on_the_messages_own_row(spark):
    rules = [(f"f{n}", "i", 1, "weak", n, ["common", f"word{n}x"], rf"\bword{n}x\b") for n in range(20000)]
    d = content.with_match_text(mail_messages(spark, SF))
    table = spark.createDataFrame(rules, wording.RULES)
    found = wording.with_wording_hits(d, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    before = d._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange", "Join", "Generate"):
        assert plan.count(word) == before.count(word), word
    assert plan.count("ArrowEvalPython") == 1
    long = "common " * 300_000 + "word77x " + "word19999x"
    started = time.time()
    got = hits(wording.with_wording_hits(texts(spark, [(long, "")] * 4), table))
    assert got == {k: [("f77", "i", 1, "weak", "word77x"), ("f19999", "i", 1, "weak", "word19999x")] for k in range(4)}
    assert time.time() - started < 60
