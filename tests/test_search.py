import json
import random

import pytest

from mailsieve.operators import records, search

ROW = "id string, user_id int, filename string, verdict string, finding_json string, record string, field string"


def made(seed=4, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcÄß _%") for _ in range(r.randrange(12)))
    rows = [(f"r{k}", k % 5, r.choice([None, word()]), r.choice(["Low", "High"]), r.choice([
        None, "no json", "{}", json.dumps({"subject": word(), "from_addr": word()})]), "theirs", "theirs") for k in range(n)]
    rows += [(None, 1, "abcabc", "Low", None, None, None)] * 2 + rows[:20] + [("long", 1, "x" * 50000 + "needle", "Low", "{}", "", "")]
    return rows + [(f"hot{k}", k, "common.eml", "Low", "{}", None, None) for k in range(300)]


def tuples(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_equals_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(made(), ROW)
    folder = str(tmp_path)
    search.build(rows, folder, 16)
    for term in ("abc", " BCA", "äß", "ÄSS", "abcab", "a%b", "abc%abc", "ab_", "\\_ab", "a", "", None, "needle", "missing", "common", "xxx"):
        got, want = search.search(spark, folder, rows.schema, term), records.history(rows, search=term)
        assert got.columns == want.columns and tuples(got) == tuples(want), term
    got = search.search(spark, folder, rows.schema, "abc", user_id=1, risk_level="Safe")
    assert tuples(got) == tuples(records.history(rows, 1, "Safe", "abc")) and got.count() > 0


def test_rare_terms_open_few_files(spark, tmp_path):
    rows = spark.createDataFrame(made(), ROW)
    folder = str(tmp_path)
    search.build(rows, folder, 16)
    opened = {t: len(search.search(spark, folder, rows.schema, t).inputFiles()) for t in ("a", "common", "needle", "missing")}
    assert opened["needle"] == 1 and opened["missing"] == 0
    assert opened["a"] == 16 and opened["common"] > opened["needle"]


def test_empty_tables_and_missing_builds(spark, tmp_path):
    rows = spark.createDataFrame([], ROW)
    search.build(rows, str(tmp_path / "none"), 4)
    for term in ("abc", "a"):
        found = search.search(spark, str(tmp_path / "none"), rows.schema, term)
        assert found.count() == 0 and found.columns == rows.columns
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        search.search(spark, str(tmp_path / "never"), rows.schema, "abc")
