"""Merkle manifests: a tree of digests for each group of rows, and a tree over the groups' roots.

A node knows its tree and its place on its level.  On every level the node in slot zero of a run
computes the places of its siblings (slot offsets; for runs of two that is place XOR 1), meets
them by an equijoin of the level with itself, and emits the parent.  A tree is done when its only
run holds one node.  Proofs go down the same way: what a parent proves and the siblings of a slot
are what the child proves.

All joins are on (tree, place), which no two nodes share, so a tree that holds a third of all rows is
spread like any other; a run is at most ``FANOUT`` rows.  Levels are written as stage tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.scale import prefix_sums

from .common import stage_table

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<left:string,right:string>>"


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: for each field its UTF-8 byte count, a colon and its value; ``-`` for null."""
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-"))
                              for t in (f.cast("string") for f in fields)]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _level_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """Runs of a level (``tree, at, digest`` and payload): ``tree, at`` of the parent and its children in order."""
    heads = nodes.where(F.col("at") % fanout == 0).select(
        "tree", F.explode(F.sequence(F.col("at"), F.col("at") + (fanout - 1))).alias("at"))
    rest = F.struct(*[c for c in nodes.columns if c not in ("tree", "at")])
    met = heads.join(nodes.select("tree", "at", rest.alias("node")), ["tree", "at"])
    return met.groupBy("tree", F.floor(F.col("at") / fanout).alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("at", "node"))).alias("run")) \
        .select("tree", F.col("parent").alias("at"), F.col("run.node").alias("children"))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of parents over ``tree, at, digest`` and payload, lowest first.

    ``leaves`` must be a stored table; ``at`` counts from 0 without gaps within a tree.  A level's rows are
    ``tree, at, digest, children, done``; ``done`` marks a tree whose only node of the level below
    is its root, and its digest is that root.
    """
    levels: list[DataFrame] = []
    below = leaves
    while True:
        kids = F.col("children.digest")
        done = (F.col("at") == 0) & (F.size("children") == 1)
        level = stage_table(_level_up(below, fanout).select(
            "tree", "at", F.when(done, kids[0]).otherwise(_digest(F.array_join(kids, ""))).alias("digest"),
            "children", done.alias("done")))
        levels.append(level)
        below = level.where(~F.col("done")).select("tree", "at", "digest")
        if below.isEmpty():
            return levels


def prove(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``tree``, what ``above`` carries for it, ``path`` and the leaf's fields as ``leaf``, for every leaf.

    ``above`` has one row for each tree: ``tree, path`` and columns to carry along.  ``path`` lists, from the
    leaf's level to the top, the sibling digests to the left and to the right, joined.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    paths = None                                   # of the nodes that this level's rows are
    for n, level in reversed(list(enumerate(levels))):
        rows = level.where("done").join(above, "tree")
        if paths is not None:
            rows = rows.unionByName(level.where(~F.col("done")).join(paths, ["tree", "at"]))
        spread = rows.select("tree", "at", *carried, "done", "path", F.col("children.digest").alias("digests"),
                                         F.posexplode("children").alias("slot", "child"))
        left = F.array_join(F.slice("digests", F.lit(1), F.col("slot")), "")
        right = F.array_join(F.slice("digests", F.col("slot") + 2, F.lit(fanout)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        path = F.when(F.col("done"), F.col("path")).otherwise(F.concat(step, F.col("path")))
        if n:
            paths = spread.select("tree", (F.col("at") * fanout + F.col("slot")).alias("at"), *carried, path.alias("path"))
        else:
            return spread.select("tree", *carried, path.alias("path"), F.col("child").alias("leaf"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: _digest(F.concat(s.left, acc, s.right)))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path in order."""
    return _digest(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return prefix_sums(rows, by, order, {"_n": F.lit(1)}).withColumn("at", F.col("_n") - 1).drop("_n")


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], altered: dict[str, Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """Manifest of ``rows``: a tree for each value of ``group`` (null is one), leaves ascending by ``order``, and
    a tree over their roots, ordered by group, null first.

    Returns for every row ``order``'s column, ``leaf, subroot, root, path`` and ``altered_leaf``, the digest of
    the row with the columns of ``altered`` in place of its own.  Rows with null in ``order`` come first; rows equal
    there are ordered by their leaf digest, so repeated rows are interchangeable and each keeps its place.
    Only digests are shuffled, whatever the length of texts.  An empty table has no rows.
    Other columns are ignored.
    """
    own, other = [F.col(f) for f in fields], [(altered or {}).get(f, F.col(f)) for f in fields]
    leaves = rows.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        F.col(order).alias("key"), leaf_digest(own).alias("digest"), leaf_digest(other).alias("altered"))
    placed = stage_table(_numbered(leaves, ["tree"], ["key", "digest"]))
    levels = grow(placed, fanout)
    roots = functools.reduce(DataFrame.unionByName, [
        lv.where("done").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("name"), "digest") for lv in levels])
    over = grow(stage_table(_numbered(roots, ["tree"], ["name"])), fanout)
    last = over[-1].first()                         # one row: the root of all
    root = F.lit(last.digest if last is not None else None).cast("string")
    nothing = rows.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(_PATH).alias("path"))
    above = stage_table(prove(over, nothing, fanout).select(
        F.col("leaf.name").alias("tree"), F.col("leaf.digest").alias("subroot"), "path"))
    return prove(levels, above, fanout).select(
        F.col("leaf.key").alias(order), F.col("leaf.digest").alias("leaf"), F.col("leaf.altered").alias("altered_leaf"),
        "subroot", root.alias("root"), "path")


def verify(docs: DataFrame, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """Manifest of documents by source, checked against rows some of which were tampered with.

    Where ``tampered`` holds, the text's A-Z are lower-cased before the check (a null stays, so such
    a row still verifies, as does a text without capitals).  Returns ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``.  See ``manifest`` for nulls, ties, repeated rows, long texts and empty tables.
    """
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs.select(*FIELDS), "source", "doc_id", FIELDS, {"text": text}, fanout)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        fold(F.col("altered_leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def _up_sql(name: str, base: str) -> str:
    return f"""{name}(tree, lvl, pos, digest, n) AS (
  {base}
  UNION ALL
  SELECT tree, lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, n, pos // {FANOUT})"""


def _field_sql(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: each character is followed by seven empty steps
_CRC = """CASE WHEN doc_id IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384) ELSE xor(a, x) // 2 END)) END"""

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
    sha256({' || '.join(map(_field_sql, FIELDS))}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({' || '.join(map(_field_sql, FIELDS[:-1]))} || {_field_sql(_LOWER)}) END AS other
  FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM d),
{_up_sql('up', "SELECT tree, 0, pos, leaf, n FROM p")},
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_up_sql('top', "SELECT 'all', 0, pos, subroot, n FROM s")},
nodes AS (
  SELECT tree, lvl, pos, digest, n FROM up UNION ALL SELECT tree, lvl + 1000, pos, digest, n FROM top WHERE tree = 'all'),
runs AS (
  SELECT tree, lvl, pos // {FANOUT} AS parent, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // {FANOUT}),
f(id, lvl, pos, tree, acc, other, proof) AS (
  SELECT id, 0, pos, tree, leaf, coalesce(other, leaf), '' FROM p
  UNION ALL
  SELECT * FROM (
    SELECT f.id, f.lvl + 1, f.pos // {FANOUT}, f.tree,
      sha256(array_to_string(r.digests, '')),
      sha256(array_to_string(list_concat(list_concat(r.digests[1:f.pos % {FANOUT}], [f.other]), r.digests[f.pos % {FANOUT} + 2:]), '')),
      f.proof || array_to_string(list_concat(r.digests[1:f.pos % {FANOUT}], r.digests[f.pos % {FANOUT} + 2:]), '')
    FROM f JOIN runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.parent = f.pos // {FANOUT}
    UNION ALL
    SELECT f.id, 1000, s.pos, 'all', f.acc, f.other, f.proof
    FROM f JOIN s ON s.tree = f.tree JOIN up ON up.tree = f.tree AND up.lvl = f.lvl AND up.n = 1)),
e AS (SELECT f.id, f.other, f.proof, f.acc FROM f JOIN top ON f.tree = 'all' AND top.lvl + 1000 = f.lvl AND top.n = 1)
SELECT p.doc_id, p.leaf, s.subroot, e.acc AS root, sha256(e.proof) AS proof_sha256, e.other AS folded_root,
  e.other = e.acc AS verified
FROM p JOIN e ON e.id = p.id JOIN s ON s.tree = p.tree
"""
