import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import langid

SOUNDS = {"aa": "ka ta na pa ma".split(), "bb": "shi ri mi ki ü".split(), "cc": "zor gub xun éd".split()}


def text(lang: str, seed: int, words: int = 40) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(words))


def test_held_out_accuracy_and_rejection(spark):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ... !?", "cc"), (903, text("bb", 7), None), (904, "½ ²", "aa"),
             (905, "ka" * 500, "aa"), (906, "\U0001f600", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    langs, net = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    assert langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.predict(docs, langs, net).collect()}
    assert len(got) == len(rows)
    held = [r.doc_id for r in docs.where(langid.is_held_out(F.col("doc_id")) & (F.col("doc_id") < 240)).collect()]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {900, 901, 902, 904, 906}
    assert got[903].lang_pred == "bb" and got[905].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in langid.predict(docs.repartition(7), langs, net).collect()}
    assert all(abs(again[i] - r.score) < 1e-5 for i, r in got.items())


def test_nothing_to_learn(spark, empty):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    langs, net = langid.train(docs)
    assert langs == [] and langid.predict(docs, langs, net).first().lang_pred == "und"
    assert langid.predict(empty, langs, net).count() == 0


def test_more_than_64_languages_are_learned(spark):
    """70 languages; six of them have fewer documents than any other."""
    r = random.Random(5)
    own = {f"l{k:02d}": ["".join(r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiou") for _ in range(2)) for _ in range(6)] for k in range(70)}
    rows = []
    for lang, sounds in own.items():
        for _ in range(20 if lang >= "l64" else 30):
            words = ["".join(r.choice(sounds) for _ in range(r.randint(1, 3))) for _ in range(40)]
            rows.append((len(rows), " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, net = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    assert langs == sorted(own)
    got = langid.predict(docs, langs, net).where(langid.is_held_out(F.col("doc_id"))).collect()
    rare = [x for x in got if x.lang >= "l64"]
    print(len(got), np.mean([x.lang_pred == x.lang for x in got]), len(rare), np.mean([x.lang_pred == x.lang for x in rare]))
    assert np.mean([x.lang_pred == x.lang for x in got]) > 0.95 and np.mean([x.lang_pred == x.lang for x in rare]) > 0.9


def test_sample_is_bounded_in_total(spark):
    docs = spark.createDataFrame([(i, f"ka{i} word", f"l{i % 100}") for i in range(3000)] + [(i, "12", "l200") for i in range(3000, 3020)]
                                 + [(4000, "ka", "l200")], "doc_id long, text string, lang string")
    found = [lang for lang, _ in langid.sample(docs, docs_all=1000)]
    assert len(set(found)) == 101 and found.count("l200") == 1 and len(found) <= 1000


def test_gradients_equal_differences():
    net = langid.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = langid._table([b"abc", b"bca"]), np.array([0, 2]), np.array([1.0, 2.0])

    def loss():
        p = net.labels(x)[0]
        return -(np.log(p[:, np.arange(2), y]) * w).sum() / (len(x) * len(y))
    g = net.gradients(x, y, w)
    for name in net.p:
        flat, at = net.p[name].reshape(-1), int(np.abs(g[name]).argmax())
        kept = flat[at]
        flat[at] = kept + 1e-3
        up = loss()
        flat[at] = kept - 1e-3
        down = loss()
        flat[at] = kept
        assert (up - down) / 2e-3 == pytest.approx(g[name].reshape(-1)[at], rel=2e-2, abs=1e-4), name
