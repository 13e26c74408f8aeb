"""Chat formatting over reply trees, in DataFrame operations only.

A tree is a table of nodes with their parents.  Root-to-leaf paths come from iterated
self-joins: jump tables of 1, 2, 4 ... replies, each the join of the one before with itself, and then the
ancestors of every leaf, doubling the reach each round.  So a chain of n turns takes about
2 log2(n) joins, and what is made is no more than the paths themselves.  Branches of a
conversation are ranked by the sum of their nodes' scores.

The template writes a turn as ``### role: text</turn>`` and a line feed.  Inside texts and
roles ``\\``, ``#`` and ``<`` (in roles ``:`` too) are written as ``\\\\``, ``\\h``, ``\\l`` (and ``\\c``),
so no control string can occur there and every turn can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

HEAD, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


def chain(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as a tree without branches, in order of turn (ties: by role,
    then text).  Rows without conv_id belong to no conversation and go; a null text or
    role is empty.  Every turn scores 1."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node",
                           F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                           "role", "text", F.lit(1.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """All (conv_id, leaf, node, up): the nodes on each root-to-leaf path and their distance to the leaf.

    Takes ``conv_id, node, parent``, node unique within its conversation.  A parent that does not exist
    counts as none; nodes on a cycle hang on no root, and their doubling ends with the node count.
    """
    edges = nodes.where(F.col("parent").isNotNull()).select("conv_id", "node", F.col("parent").alias("to"))
    jumps, many = [stage_table(edges)], nodes.count()
    while 2 ** len(jumps) <= many:
        last = jumps[-1]
        longer = stage_table(last.join(
            last.select("conv_id", F.col("node").alias("to"), F.col("to").alias("further")), ["conv_id", "to"])
            .select("conv_id", "node", F.col("further").alias("to")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    found = (nodes.select("conv_id", "node")
             .join(edges.select("conv_id", F.col("to").alias("node")).distinct(), ["conv_id", "node"], "left_anti")
             .select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k in reversed(range(len(jumps))):
        found = stage_table(found.unionByName(found.join(jumps[k], ["conv_id", "node"]).select(
            "conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + 2 ** k).alias("up"))))
    return found


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")),
                              F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """A doubled backslash parts what is left into pieces that hold only the other escapes."""
    def plain(p):
        p = F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
        return F.replace(p, F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """One conversation for each chosen path: ``conv_id, branch, score, formatted, loss_spans``.

    The ``best`` branches of each conversation are kept, by sum of ``score`` (ties: smaller leaf).
    ``loss_spans`` are the code points (start, end exclusive) of the escaped texts to learn from.
    An empty table gives no rows; other columns are ignored.
    """
    nodes = stage_table(nodes.select("conv_id", "node", "parent", "role", "text", "score"))
    steps = paths(nodes).join(nodes, ["conv_id", "node"]).where(F.col("node").isNotNull())
    turn = F.struct((-F.col("up")).alias("at"), "role", "text")
    branches = steps.groupBy("conv_id", "leaf").agg(
        F.sum("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    rank = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    chosen = branches.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best)
    heads = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(ROLE_END)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    laid = chosen.withColumns({"_heads": heads, "_bodies": bodies})
    sizes = F.zip_with("_heads", "_bodies", lambda h, b: (F.length(h) + F.length(b) + len(TURN_END)).cast("long"))
    starts = F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out")),
                         lambda a, n: F.struct((a["sum"] + n).alias("sum"),
                                               F.concat(a["out"], F.array(a["sum"])).alias("out")))["out"]
    begins = F.zip_with(starts, "_heads", lambda s, h: s + F.length(h))
    spans = F.zip_with(begins, F.arrays_zip("turns", "_bodies"), lambda s, x: F.struct(
        s.alias("start"), (s + F.length(x["_bodies"])).alias("end"), (x["turns"]["role"] == LEARNED).alias("learn")))
    return laid.select(
        "conv_id", "branch", "score",
        F.array_join(F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(TURN_END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]),
                    lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of (role, text)."""
    whole = F.split(formatted, TURN_END, -1)
    turns = F.slice(whole, F.lit(1), F.size(whole) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, F.lit(len(HEAD) + 1), F.length(t)), ROLE_END, 1)).alias("role"),
        unescape(F.substring(t, F.length(F.substring_index(t, ROLE_END, 1)) + len(ROLE_END) + 1,
                             F.length(t))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what can be read back from ``format_paths``."""
    turns = read_back(F.col("formatted"))
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted.withColumn("_learned", learned).select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars")))


CHECK_TEXT = "\\### Assistant: </turn> ok"

ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '{CHECK_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CHECK_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(regexp_replace(role, '[^\\\\#<:]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
