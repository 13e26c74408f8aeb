import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from mailsieve.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, digest string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests, fanout):
    """Root and each leaf's list of (left, right) by plain loops."""
    paths = [[] for _ in digests]
    at, level = list(range(len(digests))), digests
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = level[at[k] // fanout * fanout:][:fanout]
            p.append(("".join(run[:at[k] % fanout]), "".join(run[at[k] % fanout + 1:])))
            at[k] //= fanout
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute_force(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = climb([x[2] for x in groups[name]], fanout)
    root, tops = climb([trees[n][0] for n in names], fanout)
    out = []
    for name, top in zip(names, tops):
        for (_, _, own, r), path in zip(groups[name], trees[name][1]):
            path = path + top
            doc_id, text = r[0], r[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf((*r[:4], text))
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((doc_id, own, trees[name][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def rows():
    out = [(i, f"s{i % 3}" if i % 7 else "hot", "en", i, f"Text Number {i}") for i in range(700)]
    out += [(5000, None, None, None, None), (5005, None, "de", 0, ""), (5010, "lone", "fr", 3, "ÄÉ É日本 \U0001f600"),
            (None, "hot", "en", 1, "No Id"), (None, "hot", "en", 1, "No Id"), (12, "s0", "en", 12, "again"),
            (12, "s0", "en", 12, "again"), (-3, "", "en", 4, "Empty Name"), (6000, "hot", "en", 1, "Ab " * 200_000)]
    return out + [(7000 + i, f"many{i}", "en", 1, "Q") for i in range(40)]


def spark_rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA).repartition(5)


def asked(spark, data, fanout=16):
    found = merkle.verify(spark_rows(spark, data), queries.tampered(), fanout).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, found.collect()), key=str)


def test_equals_brute_force(spark):
    assert asked(spark, rows()) == brute_force(rows())


def test_binary_trees(spark):
    assert asked(spark, rows()[690:720], 2) == brute_force(rows()[690:720], 2)


def test_small_tables(spark):
    assert asked(spark, []) == []
    one = [(3, None, "en", 1, "Alone")]
    assert asked(spark, one) == brute_force(one)
    assert asked(spark, one)[0][1:4] == (leaf(one[0]),) * 3
    assert asked(spark, rows()[:17]) == brute_force(rows()[:17])


def test_tampering_shows(spark):
    got = {r[0]: r[6] for r in asked(spark, rows()) if r[0] is not None}
    for r in rows():
        if r[0] not in (None, 12):
            changed = zlib.crc32(str(r[0]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r[4] or "")
            assert got[r[0]] is not changed


def test_reference_sql(spark, tmp_path):
    data = [r for r in rows() if r[0] != 6000]
    spark_rows(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.ORACLE})").fetchall()
    assert sorted(found, key=str) == brute_force(data)


def test_hot_tree_is_spread(spark):
    one = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"),
                                     F.col("id").alias("n_chars"), F.lit("same").alias("text"))
    found = merkle.verify(one, F.lit(False))
    assert found.where("verified").count() == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
