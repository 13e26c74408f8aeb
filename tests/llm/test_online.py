import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from mailsieve.llm import bpe, online

from .conftest import corpus


def power(n: int) -> bool:
    return n & (n - 1) == 0


def plain_levels(sizes, capacity):
    """Sum-of-squares placement by trying every level and adding up all squares."""
    level, out = defaultdict(int), []
    for size in sizes:
        best = None
        for at in [h for h in range(capacity - size, 0, -1) if level[h]] + [0]:
            after = dict(level)
            if at:
                after[at] -= 1
            after[at + size] = after.get(at + size, 0) + 1
            total = sum(n * n for h, n in after.items() if h < capacity and not power(h))
            if best is None or total < best[0]:
                best = (total, at)
        at = best[1]
        if at:
            level[at] -= 1
        if at + size < capacity:
            level[at + size] += 1
        out.append(at)
    return out


@pytest.mark.parametrize("capacity", [7, 32, 100])
def test_levels_equal_plain_sums_of_squares(capacity):
    r = random.Random(capacity)
    sizes = [min(capacity - 1, int(r.expovariate(4 / capacity)) + 1) for _ in range(400)]
    windows, got = online.Windows(capacity, 0, 10**9), []
    for k, size in enumerate(sizes):
        got.append(windows.best_level(size))
        windows.add(k, b"\1\0\0\0" * size)
    assert got == plain_levels(sizes, capacity)


def check_packing(rows, ids, capacity):
    """Every id in one piece, windows gapless, each full or a power of two."""
    pieces, held = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, tokens, seq, offset in rows:
        pieces[doc_id].append((start, length, crc, tokens))
        held[seq].append((offset, length))
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        at = 0
        for start, length, crc, tokens in sorted(own):
            part = np.array(ids[doc_id][start:start + length], "<u4").tobytes()
            assert (start, crc, tokens) == (at, zlib.crc32(part), len(ids[doc_id]))
            at += length
        assert at == len(ids[doc_id])
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and power(at)
    return held


@pytest.mark.parametrize("most", [3, 10**9])
def test_bounded_memory_and_whole_documents(most):
    r, capacity = random.Random(5), 64
    ids = {k: [r.randrange(1000) for _ in range(1 + int(r.expovariate(1 / 15)))] for k in range(3000)}
    windows, most_held = online.Windows(capacity, 0, most), 0
    for k, x in ids.items():
        windows.add(k, np.array(x, "<u4").tobytes())
        most_held = max(most_held, windows.open)
    windows.complete()
    rows = windows.rows
    held = check_packing(rows, ids, capacity)
    if most == 3:
        assert most_held <= 3
    else:
        cut = {d for d, _, length, _, tokens, _, _ in rows if length < tokens <= capacity}
        assert len(cut) < 0.01 * len(ids)
        assert len(held) <= sum(map(len, ids.values())) / capacity + 7


def test_windows_of_one_size_are_completed():
    """Documents that never complete one another are cut at the end instead of padded."""
    ids = {k: [7] * 1500 for k in range(100)}
    windows = online.Windows(2048, 0)
    for k, x in ids.items():
        windows.add(k, np.array(x, "<u4").tobytes())
    windows.complete()
    held = check_packing(windows.rows, ids, 2048)
    assert len(held) <= 100 * 1500 // 2048 + 12


def test_pieces_of_a_corpus(spark, docs):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus() + [(None, "no id at all")]}
    rows = [tuple(r) for r in online.pack(docs, bpe.default_vocabulary(), 256).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    check_packing(rows, ids, 256)


def test_repeated_rows_and_empty_table(spark, docs, empty):
    assert online.pack(empty, bpe.default_vocabulary()).count() == 0
    twice = spark.createDataFrame([(1, "a few words"), (1, "a few words"), (None, None)], "doc_id long, text string")
    rows = online.pack(twice, bpe.default_vocabulary()).collect()
    known = [r for r in rows if r.doc_id == 1]
    assert sum(r.length for r in known) == 2 * known[0].doc_tokens
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id is None] == [(1, 1)]
