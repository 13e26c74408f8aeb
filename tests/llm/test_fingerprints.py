import hashlib

from mailsieve.llm import fingerprints as fp

from .conftest import corpus, prose


def test_edited_texts_and_likeness(spark, docs):
    rows = sorted((i, t or "") for i, t in corpus())
    got = {r.doc_id: r for r in fp.compare(docs).collect()}
    assert len(got) == len(rows)
    seen = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if after == text:
            assert r.near_next == 1
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint == fp.EMPTY
    assert got[70].near_edited > 0.1 and got[70].near_next == 0


def test_order_and_occurrences_count(spark):
    words = prose(4, 200).split()
    turned = words[100:] + words[:100]
    texts = {1: " ".join(words), 2: " ".join(turned), 3: " ".join(words[:190] + ["other"] * 10), 4: "a b c d e " * 40, 5: "a b c d e " * 20,
             6: "\t" + "\n".join(words) + " "}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: r.fingerprint for r in fp.fingerprints(table, ["doc_id"], ["text"]).collect()}

    def like(a, b):
        return sum(made[a][k:k + 8] == made[b][k:k + 8] for k in range(0, 128, 8)) / 16
    assert like(1, 6) == 1
    assert like(1, 3) > like(1, 2)
    assert like(4, 5) < 1


def test_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    r = fp.compare(one).first()
    assert r.near_next == 1 and r.n_chars == 15
    assert fp.compare(empty).count() == 0
    twice = spark.createDataFrame([(7, "b"), (7, "a"), (8, None)], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_chars) for x in fp.compare(twice).collect()) == [(7, 1), (8, 0)]
