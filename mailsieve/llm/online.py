"""Sum-of-squares online packing.

Documents come one after another; a task keeps an array with the number of open windows at each
fill level.  A document goes to the level where the sum of the squares of these numbers is least
afterwards, so no level piles up and later documents find what completes them.  A window at a
power of two needs no padding and one that is full is closed: neither is counted in the sum.

Documents longer than a window give full windows and a rest, which is placed.  When the input of a
task ends, or when it holds ``OPEN`` open windows, those that would be padded are run together and
cut anew at the window's size; the last of them is cut into powers of two, so nothing is padded.

Each task packs its own partition in one pass; memory is bounded by the open windows (at most
``OPEN`` of 4 bytes a token) and no row leaves its task.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import stage_table

#: Windows a task holds open; past it those that would be padded are completed by cutting.
OPEN = 4096
_CLOSED = 1 << 30
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows of one task.  A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, capacity: int, first_id: int, most: int = OPEN):
        self.capacity, self.next_id, self.most = capacity, first_id, most
        self.counted = [h for h in range(1, capacity) if h & (h - 1)]           # fills that a window is padded at
        self.padded = set(self.counted)
        self.level = [0] * (capacity + 1)                                       # open windows at each fill
        # change of the sum of squares by one window more or less at a fill
        self.more, self.less = np.zeros(capacity + 1, np.int32), np.full(capacity + 1, _CLOSED, np.int32)
        self.more[self.counted] = 1
        self.less[0] = 0
        self.held: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        """Place one document."""
        tokens, window = len(ids) // 4, 4 * self.capacity
        for at in range(0, len(ids), window):
            part = (doc_id, at // 4, ids[at:at + window], tokens)
            if len(part[2]) == window:
                self._close([part])
            else:
                self._place(part)

    def best_level(self, size: int) -> int:
        """The fill whose window the piece joins (0: a new one); ties go to the fullest."""
        last = self.capacity - size
        change = self.more[size:] + self.less[:last + 1]
        return last - int(change[::-1].argmin())

    def _count(self, fill: int, change: int) -> None:
        n = self.level[fill] = self.level[fill] + change
        self.open += change
        if fill in self.padded:
            self.more[fill] = 2 * n + 1
            self.less[fill] = 1 - 2 * n if n else _CLOSED
        else:
            self.less[fill] = 0 if n else _CLOSED

    def _place(self, part: tuple) -> None:
        size = len(part[2]) // 4
        at = self.best_level(size)
        if at:
            pieces = self.held[at].pop()
            self._count(at, -1)
        else:
            pieces = []
        pieces.append(part)
        if at + size == self.capacity:
            self._close(pieces)
            return
        self.held[at + size].append(pieces)
        self._count(at + size, 1)
        if self.open >= self.most:
            self.complete()

    def complete(self) -> None:
        """Close every open window; those that would be padded are run together and cut anew."""
        loose: list[tuple] = []
        for fill in range(self.capacity, 0, -1):
            for pieces in self.held[fill]:
                if fill in self.padded:
                    loose += pieces
                else:
                    self._close(pieces)
            if self.held[fill]:
                self._count(fill, -len(self.held[fill]))
                self.held[fill] = []
        left = sum(len(p[2]) for p in loose) // 4
        window: list[tuple] = []
        room = size = self._next_size(left)
        for doc_id, start, ids, tokens in loose:
            while ids:
                part, ids = ids[:4 * room], ids[4 * room:]
                window.append((doc_id, start, part, tokens))
                start, room = start + len(part) // 4, room - len(part) // 4
                if not room:
                    self._close(window)
                    left -= size
                    window, room = [], self._next_size(left)
                    size = room

    def _next_size(self, left: int) -> int:
        """Tokens of the next window when so many are left: all it can hold, or the greatest power of two."""
        return self.capacity if left >= self.capacity else 1 << left.bit_length() >> 1

    def take(self) -> pa.RecordBatch:
        """Rows of the windows closed since the last call."""
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA) \
            if rows else pa.RecordBatch.from_pylist([], schema=SCHEMA)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, most_open: int = OPEN) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens, in one pass without shuffle.

    Takes ``doc_id, text``; a document is its ids and one ``end_id``.  Returns a row for each piece: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset``; sequences are filled from 0 without holes, and
    each is full or holds a power of two.  A null or empty text is the end id alone; rows without id are packed
    like others; repeated rows are packed once each; of a very long text only its rest stays open; an
    empty table gives no rows.  Other columns are ignored.

    Sequences are numbered by partition.  The result is written once, and all pieces of a sequence
    come from one task, so a task that is run again after a lost executor changes nothing.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = bpe.encoder(path), 1000
        windows = Windows(capacity, TaskContext.get().partitionId() << 40, most_open)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                texts = [t or "" for t in batch.column("text").slice(at, step).to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").slice(at, step).to_pylist(), enc.encode_many(texts)):
                    windows.add(doc_id, ids + end)
                yield windows.take()
        windows.complete()
        yield windows.take()

    if sys.byteorder != "little":
        raise RuntimeError("token ids are laid out for little-endian machines")
    return stage_table(docs.select("doc_id", "text").mapInArrow(run, DDL))
