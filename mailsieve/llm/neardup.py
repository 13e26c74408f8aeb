"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles and a sketch of ``SKETCH`` minwise tokens.  In each of
``TREES`` independent trees a node picks one sketch position, by its path, and its documents
branch by the token they hold there; nodes of at most ``SMALL`` documents are compared exhaustively by
size and sketch, larger ones branch again.  A pair of similarity 0.85 stays together in
one branching with probability 0.85, so twelve trees miss it at depth one with 0.15 ** 12.

A compared node gives only stars of its clusters, not its pairs.  Clusters of all nodes are joined
to loose components, and inside these all links are confirmed on full sets: blocks of at most
``BLOCK`` documents meet in pairs of blocks, whose intersections are counted in a task.  No link
between different sets is skipped there.  Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, remembered, stage_table
from .components import components
from .repeats import chunks
from .substrings import window_hashes, words

SHINGLE = 5
SIMILARITY = 85      # percent
SKETCH = 128
TREES = 12
DEPTH = 8
SMALL = 1024
BLOCK = 1024
#: Standard deviations of a sketch's estimate below which a pair is still confirmed.
SLACK = 4.75
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.default_rng(85)
_TIMES = _random.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_PLUS = _random.integers(1, 1 << 63, SKETCH, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, none has none."""
    raw = [(t or "").encode("utf-8").translate(_FOLD) for t in texts]
    for a, b in chunks(raw):
        hashed, _, _, counts = words(raw[a:b])
        rolled, first = window_hashes(hashed, counts, size)
        ends = np.cumsum(counts)
        cuts = np.searchsorted(first, np.concatenate([[0], ends]))
        for i, n in enumerate(counts.tolist()):
            if n >= size:
                yield np.unique(rolled[cuts[i]:cuts[i + 1]])
            elif n:
                short = hashed[ends[i] - n:ends[i]]
                yield mix(np.array([hash_of_short(short)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def hash_of_short(hashed: np.ndarray) -> int:
    out = len(hashed)
    for h in hashed.tolist():
        out = (out * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return out


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        tokens = (shingles[at:at + 4096, None] * _TIMES + _PLUS) >> np.uint64(32)
        out = np.minimum(out, tokens.min(0).astype(np.uint32))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, sketch``: size, identity and minwise tokens of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("neardup", dict)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):        # few texts at a time are Python objects
                batch = whole.slice(at, 500)
                sizes, first, second, tokens = [], [], [], []
                for s in shingle_sets(batch.column("text").to_pylist()):
                    sizes.append(len(s))
                    first.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)), initial=np.uint64(len(s))).view(np.int64)))
                    tokens.append(sketch_of(s).astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()),
                    "set_a": pa.array(first, pa.int64()), "set_b": pa.array(second, pa.int64()), "sketch": pa.array(tokens, pa.binary())})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def _token(position: Column) -> Column:
    return F.substring(F.col("sketch"), position * 4 + 1, F.lit(4))


def _stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(first, other) for the clusters of a symmetric link matrix."""
    out, open_ = [], linked.any(1)
    while open_.any():
        root = int(open_.argmax())
        reached, front = np.zeros(len(linked), bool), np.array([root])
        reached[root] = True
        while len(front):
            new = linked[front].any(0) & ~reached
            reached |= new
            front = np.flatnonzero(new)
        out += [(root, k) for k in np.flatnonzero(reached).tolist() if k != root]
        open_ &= ~reached
    return out


def loosely_alike(sizes: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that size and sketch cannot tell from similar ones."""
    j = percent / 100
    least = int(np.floor(SKETCH * (j - SLACK * (j * (1 - j) / SKETCH) ** 0.5)))
    out = np.zeros((len(sizes), len(sizes)), bool)
    order = np.argsort(sizes, kind="stable")
    ranked, held = sizes[order], np.ascontiguousarray(tokens[order])
    ends = np.searchsorted(ranked * percent, ranked * 100, side="right")
    for i, end in enumerate(ends.tolist()):
        if end > i + 1:
            near = i + 1 + np.flatnonzero((held[i + 1:end] == held[i]).sum(1) >= least)
            out[order[i], order[near]] = True
    return out | out.T


def _compare_node(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        tokens = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH)
        pairs = _stars(loosely_alike(group.column("n_shingles").to_numpy(), tokens, percent))
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in pairs], pa.int64()),
                         "b": pa.array([int(ids[k]) for _, k in pairs], pa.int64())})
    return run


def loose_edges(nodes: DataFrame, percent: int = SIMILARITY, trees: int = TREES) -> DataFrame:
    """Stars of clusters that the trees' small nodes hold, from rows of ``doc_id, n_shingles, sketch``."""
    def pick(path: Column) -> Column:
        return F.pmod(path, F.lit(SKETCH)).cast("int")

    at_root = F.explode(F.array([F.xxhash64(F.lit(t)) for t in range(trees)]))
    here = nodes.select("doc_id", "sketch", at_root.alias("path"))
    found, depth = [], 0
    while True:
        depth += 1
        branched = stage_table(here.select("doc_id", F.xxhash64("path", _token(pick(F.col("path")))).alias("path")))
        sizes = branched.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        sized = branched.join(sizes, "path")
        last = depth == DEPTH
        small = sized.where(F.lit(True) if last else F.col("size") <= SMALL)
        found.append(small.select("doc_id", "path", "size"))
        large = sizes.where(F.col("size") > SMALL)
        if last or large.isEmpty():
            break
        # a node picks 100 / percent positions on average: of a similar pair's branches one stays whole
        first, second = (F.xxhash64("path", F.lit(k)) for k in (1, 2))
        deeper = F.explode(F.when(F.pmod(F.xxhash64("path", F.lit(0)), F.lit(1000)) < round(1e5 / percent) - 1000,
                                  F.array(first, second)).otherwise(F.array(first)))
        here = sized.where(F.col("size") > SMALL).select("doc_id", deeper.alias("path")).join(
            nodes.select("doc_id", "sketch"), "doc_id")
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    met = _blocks(members, F.col("path"), SMALL).join(nodes, "doc_id")
    return met.select("path", "pair", "doc_id", "n_shingles", "sketch").groupBy("path", "pair").applyInArrow(
        _compare_node(percent), "a long, b long")


def _blocks(members: DataFrame, key: Column, size: int) -> DataFrame:
    """Adds ``pair``: a group of over ``size`` rows is dealt into blocks, and each row goes to the pairs
    of blocks that hold its own; every two rows of a group meet in a pair."""
    many = F.ceil(F.col("size") * 2 / size)
    block = F.when(F.col("size") <= size, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", key), many))
    count = F.when(F.col("size") <= size, F.lit(1)).otherwise(many)
    others = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda o: F.greatest(o, F.col("_block")) * count + F.least(o, F.col("_block")))
    # with two blocks or more, a block alone is part of every pair that holds it
    own = F.filter(others, lambda p: (count == 1) | (F.floor(p / count) != p % count))
    return members.withColumn("_block", block.cast("long")).withColumn("pair", F.explode(own)).drop("_block")


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are similar, by full intersections; columns of shared elements come in slices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, rows = elements[order], rows[order]
    new = np.concatenate([[True], elements[1:] != elements[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, rows = column[often], rows[often]
    column = np.cumsum(np.diff(column, prepend=-1) > 0) - 1
    both = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        own, where = np.unique(rows[a:b], return_inverse=True)
        x = np.zeros((len(own), 2048), np.float32)
        x[where, column[a:b] - at] = 1
        both[np.ix_(own, own)] += x @ x.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = 100 * both.astype(np.float64) >= percent * union
    np.fill_diagonal(linked, False)
    return linked


def _confirm(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_pylist()
        sets = list(shingle_sets(group.column("text").to_pylist()))
        pairs = _stars(exact_links(sets, percent)) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()),
                         "b": pa.array([ids[k] for _, k in pairs], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, trees: int = TREES) -> DataFrame:
    """Components of documents linked by ``100 * intersection >= percent * union`` of their shingles.

    Takes ``doc_id, text``; returns ``doc_id, n_shingles, component_id, kept``.  Null and empty texts, and
    those without words, have no shingles and stand alone; rows without id are left out;
    repeated rows are in one component; an empty table gives no rows; extra columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    made = stage_table(sketches(texts))
    own = ["n_shingles", "set_a", "set_b"]
    alike = made.where("n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("node"))
    nodes = stage_table(made.join(alike.select("node", *own), own).where(F.col("doc_id") == F.col("node"))
                        .select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"]))
    loose = stage_table(components(loose_edges(nodes, percent, trees)))
    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = loose.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "size")
    held = texts.dropDuplicates(["doc_id"]) if docs_repeat(made) else texts
    # members grow with the corpus: a sorted join at every size, never a broadcast of them
    met = _blocks(held.join(members.hint("merge"), "doc_id"), F.col("component"), BLOCK)
    links = met.groupBy("component", "pair").applyInArrow(_confirm(percent), "a long, b long")
    final = components(links)
    placed = made.join(alike, own, "left").join(final, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"),
                         (component == F.col("doc_id")).alias("kept"))


def docs_repeat(made: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return not made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()
