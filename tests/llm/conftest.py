import random

import pytest

SYLLABLES = "ba be bi co cu da do fa ge hi jo ka li mo nu pa re si to vu we za tion ment ßen éta".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(w + r.choice(["", "", "", ",", ".\n"]) for w in out)


def corpus() -> list[tuple]:
    """Documents with copies, near copies, shared passages and awkward rows."""
    passage, base = prose(1, 80), prose(2, 400)
    near = base.split(" ")
    near[200] = "changed"
    near[10] = "also"
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, "one two three"), (5, base), (6, base), (7, " ".join(near)),
            (8, base.upper()), (9, "x" * 5000), (10, "ab " * 900), (11, "日本語 　 Ωmega \U0001f600 é"), (12, "é" * 150)]
    rows += [(20 + i, prose(100 + i, 60) + " " + passage + " " + prose(200 + i, 50)) for i in range(6)]
    rows += [(40 + i, prose(300 + i, 30 + 7 * i)) for i in range(20)]
    rows += [(70, prose(9, 30_000)), (2000, prose(1, 120)), (5000, base), (-3, passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with a row without id and extra columns whose names clash with inner ones."""
    rows = [(i, t, "en", k, "x", 1) for k, (i, t) in enumerate(corpus())] + [(None, "no id at all", None, 0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, unit int, kept string, n_words int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
