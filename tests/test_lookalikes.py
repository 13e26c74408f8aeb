import random

from pyspark.sql import functions as F

from mailsieve.functions import fixed_values as fv
from mailsieve.functions import identity
from mailsieve.operators import lookalikes


def fixed(spark):
    brands = spark.createDataFrame([(b, i) for i, b in enumerate(fv.BRANDS)], "brand string, pos int")
    return brands, spark.createDataFrame([(d,) for d in fv.BRAND_OWNED_DOMAINS], "domain string")


def edited(r, word):
    for _ in range(r.randrange(4)):
        at = r.randrange(len(word) + 1)
        word = r.choice([word[:at] + word[at + 1:], word[:at] + r.choice("abce0135-éß") + word[at:], word[:at] + r.choice("xyz18@") + word[at + 1:]])
    return word


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_equals_the_literal_form(spark):
    r = random.Random(3)
    hosts = [edited(r, r.choice(fv.BRANDS)) + r.choice([".com", ".co.uk", "-login.ru", ".example.org", ""]) for _ in range(600)]
    hosts += [f"{r.choice(['mail', 'secure'])}.{edited(r, b)}-{r.choice(fv.BRANDS)}.net" for b in fv.BRANDS]
    hosts += fv.BRAND_OWNED_DOMAINS + [f"a.{b}.org" for b in fv.BRANDS] + [None, "", ".", "..", "a", "-", "..PayPa1..com.", "p" * 5000 + ".com"]
    rows = spark.createDataFrame([(k, h, "x", 1) for k, h in enumerate(hosts + hosts[:50])], "k int, domain string, brand string, pos int")
    brands, owned = fixed(spark)
    got = lookalikes.lookalikes(rows, brands.union(brands.withColumn("pos", F.col("pos") + 100)), owned)
    assert got.columns == ["k", "domain", "brand", "pos", "imitated"]
    want = rows.withColumn("imitated", identity.lookalike_brand("domain"))
    left, right = ({x.k: (x.domain, x.imitated) for x in d.collect()} for d in (got, want))
    assert len(left) == len(hosts) + 50 and left == right
    assert 100 < sum(v[1] is not None for v in left.values()) < len(left)


def test_many_brands_against_all_pairs(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abc") for _ in range(r.choice([3, 5, 6, 7, 63, 64]))) for _ in range(400)})
    order = {b: r.randrange(50) for b in names}
    labels = [edited(r, r.choice(names)) for _ in range(300)]
    brands = spark.createDataFrame([*order.items(), (None, 1), ("", 0)], "brand string, pos int")
    rows = spark.createDataFrame([(x + ".test",) for x in labels], "domain string")
    got = {x.domain: x.imitated for x in lookalikes.lookalikes(rows, brands).collect()}
    for label in labels:
        folded = label.translate(str.maketrans("01358@", "olesba", "-"))
        near = [(order[b], b) for b in names if label != b and (folded == b or (
            5 <= len(b) <= 63 and min(len(label), len(folded)) <= 65
            and any(abs(len(w) - len(b)) <= 2 and 1 <= distance(w, b) <= 2 for w in (label, folded))))]
        words = {x for w in label.split("-") for x in (w, w.translate(str.maketrans("01358@", "olesba")))}
        token = [(order[b], b) for b in names if len(b) >= 6 and b in words]
        want = None if label in order or not label else min(near)[1] if near else min(token)[1] if token else None
        assert got[label + ".test"] == want, label


def test_empty_tables_and_plan(spark):
    brands, owned = fixed(spark)
    rows = spark.createDataFrame([("paypa1.com",)], "domain string")
    assert lookalikes.lookalikes(rows, brands.limit(0), owned).collect()[0].imitated is None
    assert lookalikes.lookalikes(rows.limit(0), brands, owned.limit(0)).count() == 0
    found = lookalikes.lookalikes(rows, brands, owned)
    assert found.collect()[0].imitated == "paypal"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
