"""The stages against brute force, each on its predecessor's rows."""


import corpus_pipeline as cp
from mailsieve.llm import common, queries
from pyspark.sql import functions as F

from .conftest import corpus, prose
from .test_neardup import brute_force
from .test_repeats import bytes_removed
from .test_secrets import base


def test_stages(spark, tmp_path):
    rows = [(i, t, "en" if i % 4 else None, "src", 0, "extra") for i, t in corpus()]
    rows += [(8000 + i, prose(500 + i, 80) + f" password=abcdef{i:04d} end", "en", None, None, None) for i in range(4)]
    rows += [(None, "a row without id", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    stages = dict(cp.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]

    one = common.stage_table(cp.language(spark, docs, ""))
    assert one.columns == cp.COLUMNS
    first = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(i for i, _ in first if i is not None) == sorted(
        i for i, t, *_ in rows if i is not None and t and any(map(str.isalpha, t)))
    assert (None, "a row without id") in first and one.where("lang is null").count() == 0

    two = common.stage_table(cp.near_duplicates(spark, one, ""))
    want = brute_force([r for r in first if r[0] is not None])
    second = [(r.doc_id, r.text) for r in two.collect()]
    assert sorted(second, key=str) == sorted([(i, t) for i, t in first if i is None or want[i][1] == i], key=str)

    three = common.stage_table(cp.repeated_passages(spark, two, ""))
    cut = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in bytes_removed([r for r in second if r[0] is not None], 200)}
    third = {r.doc_id: (r.text, r.n_chars) for r in three.collect() if r.doc_id is not None}
    assert third == {i: (t, len(t)) for i, t in cut.items()} and three.count() == two.count()

    four = common.stage_table(cp.redact_secrets(spark, three, ""))
    assert four.columns == cp.COLUMNS and four.count() == three.count()
    for r in four.where("doc_id is not null").collect():
        before = third[r.doc_id][0]
        if base(before):
            assert "[SECRET]" in r.text and not base(r.text)
        elif "[SECRET]" not in r.text:
            assert r.text == before

    five = cp.pack(spark, four, "")
    assert five.where("piece = 0").count() == four.count()
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_run_over_written_documents(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in corpus() if len(t or "") < 10_000]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 20


def test_near_copies_from_80_percent_go(spark):
    rows = []
    for n, changed in enumerate([(20, 70, 120, 170, 220), (10, 60, 110, 160, 210), (40, 80, 120, 160, 200, 240), tuple(range(10, 250, 30))]):
        words = [f"w{n}x{i}" for i in range(250)]
        copy = [f"changed{w}" if i in changed else w for i, w in enumerate(words)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_force(rows, 80)
    assert want != brute_force(rows, 85)
    left = {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, _ in rows if want[i][1] == i} == {0, 2, 4, 5, 6, 7}


def test_language_stage_without_usable_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, "s", 1) for i, t in corpus() if len(t or "") < 10_000] + [(None, "a row without id", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    lettered = sorted((t for _, t, *_ in rows if t and any(map(str.isalpha, t))))
    held_out = docs.withColumn("lang", F.when(cp.langid.is_held_out(F.col("doc_id")), "en"))
    assert held_out.where("lang is not null").count() > 0
    for some in docs, held_out:
        got = cp.language(spark, some, "").collect()
        assert sorted(r.text for r in got) == lettered
        assert {r.doc_id for r in got if r.lang} == {r.doc_id for r in some.where("lang is not null").collect() if r.text in lettered}
    assert cp.language(spark, docs.limit(0), "").count() == 0


def test_language_stage_keeps_a_language_called_und(spark):
    rows = [(i, "ka ta na pa ma" if i % 2 else "shi ri mi ki", "und" if i % 2 else "aa", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.language(spark, docs, "").count() == 60


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
