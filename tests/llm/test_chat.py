import duckdb
from pyspark.sql import functions as F

from mailsieve.llm import chat

TEXTS = ["\\### Assistant: </turn> ok", "a\\h\\l\\c b \\\\ # < :", "</turn>\n### user: x", "", None, "é\U0001f600\n\n", "\\", "###", "plain"]


def test_digest_equals_sql(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", TEXTS[(c + t) % len(TEXTS)], 1) for c in range(9) for t in range(c + 1)]
    rows += [(50, t, "assistant" if t % 3 else "system: #<\\", f"turn {t}", 1) for t in range(70)]
    rows += [(60, 0, None, "no role", 1), (60, 0, "user", "same turn", 1), (60, 0, "user", "same turn", 1), (None, 0, "user", "nowhere", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    got = chat.digest(chat.format_paths(chat.chain(turns))).toPandas()
    con = duckdb.connect()
    frame = turns.toPandas().drop(columns="node")
    con.register("conversations", frame)
    want = con.sql(chat.ORACLE).df()
    want = want[want.conv_id != -7]
    names = sorted(want.columns)
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist()))


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame([
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 3, "user", "more", 0.5), (1, 5, 2, "user", "tie a", 1.0), (1, 6, 2, "user", "tie b", 1.0),
        (2, 9, 7, "user", "parent is missing", 1.0)],
        "conv_id long, node long, parent long, role string, text string, score double")
    got = chat.format_paths(nodes, best=2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    said = {(r.conv_id, r.branch): (r.score, [t.text for t in r.turns]) for r in got}
    assert said == {(1, 1): (3.0, ["root", "good", "tie a"]), (1, 2): (3.0, ["root", "good", "tie b"]),
                    (2, 1): (1.0, ["parent is missing"])}


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_paths(chat.chain(none))).count() == 0
