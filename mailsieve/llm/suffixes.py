"""Suffix-array dedup: bytes under strings of a given length that start more than once.

The suffixes are sorted blockwise, and only those that can tie for so long.

1. A difference cover samples the positions of every document: any two positions have a common
   small distance to samples, so two equal strings hold a pair of samples with equal blocks.  The
   cover ranks (here: is a sample's block shared) are computed first, across all documents.
2. A suffix that no shared sample follows closely cannot tie and is left out.  The others are
   dealt into buckets by the least-hashed gram of their string, the anchor: neighbouring
   suffixes mostly have one anchor, so a bucket gets a stretch of text for about a hundred suffixes.
3. A bucket is sorted at a time.  The text behind the anchors and, mirrored, the text before
   them are sorted as suffixes, with the lengths that neighbours share; a long tie between two
   suffixes of any offset is settled by these two ranks, not by comparing text again.

All comparisons are of bytes; hashes only choose what meets.  Memory is bounded by a unit of
documents or by a bucket, which holds every distinct stretch once however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, partitions
from .repeats import answers, chunks, contains, covered, shared, sorted_docs, with_units

LENGTH = 200
# Perfect difference sets, by period; every residue is one difference of two elements.
COVERS = {
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    91: [0, 1, 3, 9, 27, 49, 56, 61, 77, 81],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
}
GRAM = 16
#: Buckets for each shuffle partition.
BUCKETS = 16
_R = np.uint64(0xD6E8FEB86659FD93)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def _period(length: int) -> int:
    return max(v for v in COVERS if 3 * v <= 2 * length)


class _Text:
    """Texts laid one after another, with rolling hashes of any block."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.raw)
        base = np.full(n, _R, np.uint64)
        base[:1] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(self.raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.cumprod(base), out=self.sums[1:])
        base[:] = _R_INVERSE
        base[:1] = 1
        self.back = np.cumprod(base)

    def block_hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.back[at])

    def gram_hashes(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[:len(self.sums) - size])

    def samples(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cover samples of texts long enough: place, its text and the hash of its block."""
        v = _period(length)
        block = length - v + 1
        most = int(self.sizes.max(initial=0))
        pattern = (np.arange(0, most + v, v)[:, None] + np.array(COVERS[v])).ravel()
        many = np.where(self.sizes >= length, np.searchsorted(pattern, self.sizes - block, side="right"), 0)
        owner = np.repeat(np.arange(len(many)), many)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = pattern[nth] + self.starts[owner]
        return place, owner, self.block_hashes(place, block)


def _anchors(text: _Text, length: int) -> np.ndarray:
    """For each position, hash (upper half) and place (lower half) of the leftmost least-hashed
    gram of the string that starts there."""
    gram = min(GRAM, length // 4)
    least = (text.gram_hashes(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(text.raw) - gram + 1, dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = wide - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def _first_difference(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 50_000):
        a, b = rows[at - 1:at + 49_999], rows[at:at + 50_000]
        differ = a[:len(b)] != b
        out[at:at + len(b)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _ranked(keys: list[int], parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of (anchor, part), and the bytes each shares with its predecessor."""
    laid = b"".join([k.to_bytes(4, "big") + p.ljust(width, b"\0") for k, p in zip(keys, parts)])
    rows = np.frombuffer(laid, np.uint8).reshape(len(keys), width + 4)
    order = np.argsort(np.frombuffer(laid, f"S{width + 4}"), kind="stable")
    return order, _first_difference(rows[order])


def tied_suffixes(keys: list[int], texts: list[bytes], anchors: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """For distinct stretches (anchor hash, text, place of the anchor, times it occurs): which offsets
    before the anchor start a string that occurs again.  Columns are offsets."""
    g, wide = len(texts), length - min(GRAM, length // 4) + 1
    windows = np.array([len(t) - length + 1 for t in texts], np.int64)
    out = np.zeros((g, wide + 1), bool)
    at = anchors.tolist()
    left, left_shared = _ranked(keys, [t[:a][::-1] for t, a in zip(texts, at)], wide)
    right, right_shared = _ranked(keys, [t[a:] for t, a in zip(texts, at)], length)
    before, behind = np.empty(g, np.int64), np.empty(g, np.int64)
    for offset in range(int(anchors.max()) + 1):
        own = np.flatnonzero((anchors - windows + 1 <= offset) & (offset <= anchors))
        if not len(own):
            continue
        before[left] = np.cumsum(left_shared < 4 + offset)
        behind[right] = np.cumsum(right_shared < 4 + length - offset)
        _, which, times = np.unique(before[own] * (g + 1) + behind[own], return_inverse=True, return_counts=True)
        out[own, offset] = (times[which] > 1) | (many[own] > 1)
    return out


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove every byte under a string of ``length`` bytes that also starts elsewhere.

    Takes ``doc_id, text``; returns ``doc_id, n_bytes, n_removed, n_spans, spans, kept``: maximal removed
    runs (start, end exclusive, in bytes) and the remaining bytes.  Strings never cross documents
    and are judged on the input.  Null or empty texts and texts shorter than ``length`` stay whole;
    rows without id are left out; repeated rows are copies of each other; extra columns are ignored.
    """
    units = with_units(docs)
    buckets = BUCKETS * partitions(docs.sparkSession)
    period = _period(length)

    def sample_hashes(texts: list[bytes]) -> np.ndarray:
        """Distinct block hashes of a unit's cover samples."""
        found = [np.zeros(0, np.uint64)]
        for a, b in chunks(texts):
            found.append(np.unique(_Text(texts[a:b]).samples(length)[2]))
        return np.unique(np.concatenate(found))

    stretch = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("place", pa.int32()), ("content", pa.binary()),
                         ("unit", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def stretches(group: pa.Table, others: pa.Table) -> pa.Table:
        """Stretches of suffixes that may tie, and spans that tie within the unit already."""
        texts, theirs = sorted_docs(group)[1], answers(others)
        unit = group.column("unit")[0].as_py() if group.num_rows else None
        cut = [(a, _Text(texts[a:b])) for a, b in chunks(texts)]
        hashed = [t.samples(length) for _, t in cut]
        every = np.concatenate([h for _, _, h in hashed] or [np.zeros(0, np.uint64)])
        _, which, times = np.unique(every, return_inverse=True, return_counts=True)
        tied = contains(theirs, every) | (times[which] > 1 if len(every) else False)
        seen: dict[bytes, list] = {}
        at, places = 0, []
        for k, ((first, text), (place, owner, _)) in enumerate(zip(cut, hashed)):
            some = tied[at:at + len(place)]
            at += len(place)
            place, owner = place[some], owner[some]
            begin = np.maximum(place - period + 1, text.starts[owner])
            end = np.minimum(place, text.starts[owner] + text.sizes[owner] - length) + 1
            begin, end = begin[end > begin], end[end > begin]
            if not len(begin):
                continue
            own = np.flatnonzero(covered(len(text.raw), begin, end))
            least = _anchors(text, length)[own]
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 1) | (np.diff(anchor) != 0)]))
            last = np.append(new[1:], len(own)) - 1
            owner = np.searchsorted(text.starts, own[new], side="right") - 1
            while (empty := text.sizes[owner] == 0).any():
                owner[empty] -= 1
            for s, e, a, h, o in zip(own[new].tolist(), own[last].tolist(), anchor[new].tolist(),
                                     (least[new] >> np.uint64(32)).tolist(), owner.tolist()):
                content = text.raw[s:e + length]
                start = s - int(text.starts[o])
                entry = seen.get(content)
                if entry is None:
                    seen[content] = [h, a - s, first + o, start, 1]
                else:
                    if entry[4] == 1:
                        places.append((entry[2], entry[3], entry[3] + len(content)))
                    entry[4] += 1
                    places.append((first + o, start, start + len(content)))
        rows = [(h * buckets >> 32, h, p, content, unit, row if n == 1 else None, start, start + len(content))
                for content, (h, p, row, start, n) in seen.items()]
        rows += [((unit + row) % buckets, None, None, None, unit, row, start, end) for row, start, end in _merged(places)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), stretch)], schema=stretch) \
            if rows else stretch.empty_table()

    span = pa.schema([("unit", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def sort_bucket(group: pa.Table) -> pa.Table:
        done, origins, index = [], [], {}
        keys, anchors, many = [], [], []
        for r in zip(*(group.column(c).to_pylist() for c in ("anchor", "place", "content", "unit", "row", "start", "end"))):
            h, place, content, unit, row, start, end = r
            if content is None:
                done.append((unit, row, start, end))
                continue
            k = index.setdefault(content, len(index))
            if k == len(keys):
                keys.append(h)
                anchors.append(place)
                many.append(0)
                origins.append([])
            many[k] += 1 if row is not None else 2
            if row is not None:
                origins[k].append((unit, row, start, end))
        if keys:
            place = np.array(anchors, np.int64)
            tied = tied_suffixes(keys, list(index), place, np.array(many), length)
            edges = np.diff(np.pad(tied, ((0, 0), (1, 1))).view(np.int8), axis=1)
            for k, low, high in zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1]):
                for unit, row, start, _ in origins[k]:
                    done.append((unit, row, start + int(place[k] - high) + 1, start + int(place[k] - low) + length))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), span)], schema=span) \
            if done else span.empty_table()

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def remove(group: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts = sorted_docs(group)
        lost: dict[int, list] = {}
        for row, start, end in zip(*(spans.column(c).to_pylist() for c in ("row", "start", "end"))):
            lost.setdefault(row, []).append((row, start, end))
        out = []
        for row, (doc_id, text) in enumerate(zip(ids, texts)):
            cuts = _merged(lost.get(row, []))
            kept, at = [], 0
            for _, start, end in cuts:
                kept.append(text[at:start])
                at = end
            kept = b"".join([*kept, text[at:]])
            out.append((doc_id, len(text), len(text) - len(kept), len(cuts), [{"start": s, "end": e} for _, s, e in cuts], kept))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), result)], schema=result) \
            if out else result.empty_table()

    ties = shared(units, sample_hashes, first_keeps=False)
    spans = (units.groupBy("unit").cogroup(ties.groupBy("unit")).applyInArrow(
        stretches, "bucket int, anchor long, place int, content binary, unit long, row int, start long, end long")
        .groupBy("bucket").applyInArrow(sort_bucket, "unit long, row int, start long, end long"))
    return units.groupBy("unit").cogroup(spans.groupBy("unit")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


def texts(deduped: DataFrame) -> DataFrame:
    """``doc_id, text``: the remaining bytes as text; bytes of a code point that was cut go."""
    def run(batches):
        for batch in batches:
            kept = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])
    return deduped.select("doc_id", "kept").mapInArrow(run, "doc_id long, text string")


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, end) spans with those that touch or overlap made one."""
    out: list[tuple[int, int, int]] = []
    for row, start, end in sorted(spans):
        if out and out[-1][0] == row and start <= out[-1][2]:
            if end > out[-1][2]:
                out[-1] = (row, out[-1][1], end)
        else:
            out.append((row, start, end))
    return out
