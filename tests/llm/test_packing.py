import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from mailsieve.llm import bpe, packing

from .conftest import corpus


def test_pieces_and_places(spark, docs):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    capacity = 256
    got = packing.pack(docs, bpe.default_vocabulary(), capacity).collect()
    want = []
    for i, text in corpus() + [(None, "no id at all")]:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes()))
                 for k in range(0, len(ids), capacity)]

    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=lambda r: (r[0] or -99, *r[1:])) == \
        sorted(want, key=lambda r: (r[0] or -99, *r[1:]))
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(held) <= 1.02 * total / capacity + 1


def test_plan_equals_one_by_one_best_fit():
    r = random.Random(3)
    for capacity in (10, 64, 500):
        lengths = [min(capacity, int(r.expovariate(3 / capacity)) + 1) for _ in range(2000)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.plan(counts, capacity)
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((capacity if fit is None else fit) - n)
        used = {s for _, many, first, _ in runs for s in range(first, first + many)}
        assert sum(many for _, many, _, _ in runs) == len(lengths)
        assert len(used) <= len(gaps) * 1.01 + 1


def test_empty_table(empty):
    assert packing.pack(empty, bpe.default_vocabulary()).count() == 0
