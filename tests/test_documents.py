"""Maintenance of document collections."""

from pyspark.sql import functions as F

from lexmill.operators import documents as D


def test_upsert_with_nulls_in_the_first_column(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (3, "y", "c")], "k int, p string, q string")
    new = spark.createDataFrame([(1, None, "z"), (2, None, "b"), (4, None, "d")], "k int, p string, q string")
    found = {r["k"]: (r["p"], r["q"], r["change"]) for r in D.upsert(old, new, "k", ["p", "q"]).collect()}
    assert found == {1: (None, "z", "updated"), 2: ("x", "b", "unchanged"), 3: ("y", "c", "kept"), 4: (None, "d", "new")}


def test_merge_spans(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 10, 12), (1, 13, 14), (None, 5, 6)], "k int, a int, b int")
    found = sorted((r["k"] or 0, r["a"], r["b"], r["n"]) for r in D.merge_spans(spans, ["k"], "a", "b").collect())
    assert found == [(0, 5, 6, 1), (1, 0, 12, 3), (1, 13, 14, 1)]


def test_candidates_are_not_capped(spark):
    left = spark.createDataFrame([(1, "common title")], "id int, title string")
    right = spark.range(1200).selectExpr("cast(id as int) id", "'common title' title")
    assert D.ngram_candidates(left, right).count() == 1200


def test_longer_titles_make_no_pairs(spark):
    rows = [(1, "abcdefgh"), (2, "abcdefghi"), (3, "abcdefgh"), (4, "abcdefghij"), (5, "abcdefg"), (6, None), (7, "abcdefgx"), (8, "")]
    titles = spark.createDataFrame(rows, "id int, title string")
    found = {r["id"]: r["n_longer"] for r in D.longer_titles(titles, 8).collect()}
    assert found == {1: 2, 2: 1, 3: 2}
    # 30,000 short titles and as many longer ones are 900 million pairs; no row of them is made
    many = spark.range(60_000).selectExpr("id", "if(id % 2 = 0, 'common title', 'common title, longer') title")
    plan = D.longer_titles(many, 8)
    assert plan.agg(F.sum("n_longer")).first()[0] == 30_000 * 30_000
    assert "startswith" not in plan._jdf.queryExecution().toString().lower()
