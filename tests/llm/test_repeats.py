"""Substring and suffix-array dedup against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from mailsieve.llm import repeats, substrings, suffixes

from .conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows_removed(rows, window):
    first, out = {}, []
    for i, text in sorted(rows):
        ws = WORD.findall(text)
        dead = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first.setdefault(tuple(ws[k:k + window]), i) < i:
                dead[k:k + window] = [True] * window
        out.append((i, len(ws), sum(dead), " ".join(w for w, d in zip(ws, dead) if not d)))
    return sorted(out)


def bytes_removed(rows, length):
    raws = [(i, t.encode()) for i, t in sorted(rows)]
    count = Counter(raw[k:k + length] for _, raw in raws for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        dead = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if count[raw[k:k + length]] > 1:
                dead[k:k + length] = True
        starts, ends = repeats.runs(dead)
        out.append((i, len(raw), int(dead.sum()), list(zip(starts.tolist(), ends.tolist())),
                    np.frombuffer(raw, np.uint8)[~dead].tobytes()))
    return sorted(out)


ROWS = [(i, t or "") for i, t in corpus()]


@pytest.mark.parametrize("window", [50, 3])
def test_substrings(docs, window):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs, window).collect())
    assert got == windows_removed(ROWS, window)


@pytest.mark.parametrize("length", [200, 30, 12])
def test_suffixes(docs, length):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept))
                 for r in suffixes.dedup(docs, length).collect())
    assert got == bytes_removed(ROWS, length)


def test_small_chunks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rows = ROWS + [(5, dict(ROWS)[5]), (3, "word"), (3, "another")]
    rows = [r for r in rows if len(r[1]) < 20_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs, 20).collect())
    assert got == windows_removed(rows, 20)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.dedup(docs, 40).collect())
    assert got == sorted((a, b, c, e) for a, b, c, _, e in bytes_removed(rows, 40))


def test_texts_lose_cut_code_points(spark):
    docs = spark.createDataFrame([(1, "é" * 20 + "tail"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.texts(suffixes.dedup(docs, 12)).collect()}
    assert got[1].endswith("tail") and got[2] == ""


def test_empty_tables(empty):
    assert substrings.dedup(empty).count() == 0
    assert suffixes.dedup(empty).count() == 0


def test_gaps_of_any_size():
    values = np.unique(np.array([0, 1, 2**48 - 2, 2**48 - 1, 2**48, 2**63, 2**64 - 1, 5, 2**62], dtype=np.uint64))
    assert (repeats.unpack(repeats.pack(values)) == values).all()
    assert len(repeats.unpack(repeats.pack(values[:0]))) == 0
    some = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    assert (repeats.unpack(repeats.pack(some)) == some).all()


@pytest.mark.parametrize("period", suffixes.COVERS)
def test_covers_hold_every_difference(period):
    cover = suffixes.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_a_high_bucket_packs_no_more_than_its_values():
    border = np.uint64(0xFF00000000000000)
    some = border + np.arange(1, 1001, dtype=np.uint64) * np.uint64(1 << 40)
    assert (repeats.unpack(repeats.pack(some)) == some).all()
    assert len(repeats.pack(some)) <= 8 * len(some)
    edges = np.array([(1 << 48) - 1, (1 << 48), (1 << 49) - 1, (1 << 64) - 1], np.uint64)
    assert (repeats.unpack(repeats.pack(edges)) == edges).all()
    assert (repeats.unpack(repeats.pack(edges[:1])) == edges[:1]).all()
