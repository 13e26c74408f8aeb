from collections import Counter, defaultdict

import numpy as np
import pytest

from mailsieve.llm import neardup
from mailsieve.llm.components import components

from .conftest import corpus, prose
from .test_repeats import WORD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, percent=85):
    sets = defaultdict(set)
    for i, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders, least = defaultdict(list), {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for i, own in sorted(sets.items()):
        for k, n in Counter(k for x in own for k in holders[x]).items():
            if 100 * n >= percent * (len(own) + len(sets[k]) - n):
                a, b = sorted((root(i), root(k)))
                least[b] = a
        for x in own:
            holders[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(seed: int, many: int, words: int, edits: int) -> list[str]:
    r = np.random.default_rng(seed)
    base = prose(seed, words).split(" ")
    out = []
    for k in range(many):
        own = list(base)
        for at in r.integers(0, len(own), edits):
            own[at] = f"w{seed}x{k}y{at}"
        out.append(" ".join(own))
    return out


def check(spark, docs, rows):
    want = brute_force(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_equal_brute_force(spark, docs):
    check(spark, docs, corpus())


@pytest.mark.parametrize("small", [1024, 8])
def test_large_nodes_branch_and_meet_in_blocks(spark, monkeypatch, small):
    """Groups around the threshold, larger than a node and a block may be."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", small)
    texts = family(1, 60, 200, 3) + family(2, 40, 150, 2) + family(3, 25, 300, 6) + ["a b", "a b", "A B", ""]
    rows = [(1000 * (k % 7) + k, t) for k, t in enumerate(texts)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_repeated_ids_and_empty_table(spark, empty):
    rows = [(1, "x y z a b c"), (1, "x y z a b c"), (2, None), (3, "X y z a b c")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 2), (3, 1)]
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 50), (60, 61), (61, 60), (None, 3), (70, 72), (71, 72), (100, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 60: 60, 61: 60, 70: 70, 71: 70, 72: 70}


def test_estimate_misses_no_similar_pair():
    r = np.random.default_rng(5)
    for _ in range(200):
        common, own = r.integers(1, 2**63, 170, dtype=np.uint64), r.integers(1, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(np.r_[common, own[:15]]), np.unique(np.r_[common, own[15:30]])
        tokens = np.stack([neardup.sketch_of(a), neardup.sketch_of(b)])
        assert neardup.loosely_alike(np.array([len(a), len(b)]), tokens, 85)[0, 1]
