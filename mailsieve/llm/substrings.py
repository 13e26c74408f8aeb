"""Substring dedup by Rabin-Karp hashes of fixed-length token windows.

Every window of every document is hashed (a polynomial over word hashes, rolled by prefix sums);
Spark counts the hashes by unit of documents (see ``repeats``).  A window whose hash
starts in a document with a smaller id is removed; removed windows merge into maximal intervals.

Hashes have 64 bits: among n different windows about n^2 / 2^65 pairs meet by chance (less than one for
the 10^9 windows of some gigabytes of text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix
from .repeats import answers, chunks, contains, covered, runs, shared, sorted_docs, with_units

WINDOW = 50
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_random = np.random.default_rng(50)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid one after another: hash, start and end of each word, and words of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[raw]
    starts, ends = runs(inside)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(texts), np.int64)
    place = np.arange(len(raw), dtype=np.int64)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = _BYTE[raw] * _PLACE[place & 4095] + (place >> 12).astype(np.uint64)
    value[~inside] = 0
    hashed = mix(np.add.reduceat(mix(value), starts) + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashed, starts, ends, np.diff(np.searchsorted(starts, limits), prepend=0)


def window_hashes(hashed: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window and the index of its first word; windows stay within a text."""
    if len(hashed) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _powers(_BASE, len(hashed)), dtype=np.uint64)])
    rolled = (sums[window:] - sums[:-window]) * _powers(_BASE_INVERSE, len(hashed) - window + 1)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashed))     # words from here to the text's end
    first = np.flatnonzero(left[:len(rolled)] >= window)
    return mix(rolled[first]), first


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove words under windows that also start in a document with a smaller id.

    Takes ``doc_id, text``; returns ``doc_id, n_words, n_removed, kept`` (kept words joined by one
    space).  Null or empty texts have no words; rows without id are left out; rows that repeat an
    id do not count against each other; extra columns are ignored.
    """
    units = with_units(docs)

    def distinct(texts: list[bytes]) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for a, b in chunks(texts):
            hashed, _, _, counts = words(texts[a:b])
            found.append(np.unique(window_hashes(hashed, counts, window)[0]))
        return np.unique(np.concatenate(found))

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(group: pa.Table, others: pa.Table) -> pa.Table:
        ids, texts = sorted_docs(group)
        theirs = answers(others)
        number = np.unique(ids, return_inverse=True)[1]
        found, owners, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for a, b in chunks(texts):
            hashed, _, _, counts = words(texts[a:b])
            rolled, first = window_hashes(hashed, counts, window)
            found.append(rolled)
            firsts.append(first)
            owners.append(np.repeat(number[a:b], counts)[first])
        found, owners = np.concatenate(found), np.concatenate(owners)
        _, where, which = np.unique(found, return_index=True, return_inverse=True)
        gone = contains(theirs, found) | (owners > owners[where][which] if len(found) else False)
        out: list[tuple] = []
        at = 0
        for (a, b), first in zip(chunks(texts), firsts):
            _, starts, ends, counts = words(texts[a:b])
            lost = first[gone[at:at + len(first)]]
            at += len(first)
            dead = covered(len(starts), lost, lost + window)
            joined, word = b" ".join(texts[a:b]) + b" ", 0
            for i, n in enumerate(counts.tolist()):
                own = slice(word, word + n)
                keep = ~dead[own]
                kept = b" ".join([joined[s:e] for s, e in zip(starts[own][keep].tolist(), ends[own][keep].tolist())])
                out.append((ids[a + i], n, n - int(keep.sum()), kept.decode("utf-8")))
                word += n
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) \
            if out else schema.empty_table()

    return units.groupBy("unit").cogroup(shared(units, distinct, first_keeps=True).groupBy("unit")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")
