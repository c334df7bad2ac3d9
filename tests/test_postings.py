"""Search over postings against a scan of the texts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import postings as P

KIND = "doc_id long, title string, number string, issuer string, text string, keywords string, day date, number_year int, in_year int, tier int, is_official int"


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["增值税", "税", "契税", "优惠", "abc", "ABCD", "aaaa", "x", "é", "🙂", "%", "_", "'", '"', "\n", "关税 ", "the "]
    some = lambda k: rng.choice([None, "", "".join(rng.choices(words, k=rng.randrange(1, k)))])
    rows = [(i, some(5), some(4), some(3), some(40) if i % 9 else "填" * 4095 + "增值税" + "x" * 4090 + "契税aaaaaa", some(4), datetime.date(2000 + i % 7, 1, 2), rng.choice([None, 2001, 2002]), i % 4, rng.choice([0, 1, 2, 9]), rng.choice([None, 0, 1, 1])) for i in range(n)]
    return rows, spark.createDataFrame(rows, KIND)


def times(text, term):
    text = (text or "").lower()
    return sum(text.startswith(term, i) for i in range(len(text)))


def plain(rows, terms, like):
    """doc_id -> for each term its hits by column; only documents in which every term has one."""
    out = {}
    for r in rows:
        cells = [r[1], None, None, r[4], None] if like else r[1:6]
        hits = [[times(x, t.lower()) for x in cells] for t in terms]
        if all(any(h) for h in hits):
            out[r[0]] = hits
    return out


QUERIES = [["增值税"], ["增值税", "abc"], ["aaaa"], ["abcd", "关税 the"], ["契税"], ["税", "a"], ["%"], ["'"], ['"a'], ["填填填填增"], ["填填增值税xxx"], ["no such"], ["a" * 500], ["🙂é"]]


@pytest.mark.parametrize("generations", [1, 2])
def test_same_hits_as_a_scan(spark, tmp_path, generations):
    rows, frame = documents(spark)
    path = f"file://{tmp_path}/index"
    P.append(frame, path, 0)
    if generations == 2:
        changed, new = documents(spark, 20, seed=2)
        gone = spark.createDataFrame([(30,), (31,), (5,), (999,)], "doc_id long")
        for _ in range(2):  # a replay changes nothing
            P.append(new.filter("doc_id != 5"), path, 1, gone)
        rows = [r for r in [*changed, *rows[20:]] if r[0] not in (30, 31, 5)]
    for terms in QUERIES if generations == 1 else QUERIES[:4]:
        q = P.Search(terms, everything=True, limit=50, sort="date_asc")
        want = plain(rows, q.words, q.mode == "like")
        found = P.search(spark, path, q).collect()
        ids = sorted(want, key=lambda i: (2000 + i % 7, i))
        assert [r["doc_id"] for r in found] == (ids[:50] or [None]), terms
        assert {r["total"] for r in found} == {len(ids)} and {r["hint"] for r in found} == {None if ids[:50] == ids and ids else "more" if ids else "no_hits"}
        assert {r["mode"] for r in found} == {"like" if any(len(t) < 3 for t in terms) else "phrases"}


def test_relevance_paging_and_filters(spark, tmp_path):
    import math

    rows, frame = documents(spark)
    path = f"file://{tmp_path}/index"
    P.append(frame.unionByName(frame.limit(5)), path, 0)
    q = P.Search(["增值税", "abc"], limit=50, everything=True)
    want = plain(rows, q.words, False)
    size = {r[0]: sum(max(len(x or "") - 2, 0) for x in r[1:6]) for r in rows}
    mean = sum(size.values()) / len(rows)
    score = dict.fromkeys(want, 0.0)
    for t in range(2):
        held = {r[0] for r in rows if any(times(x, q.words[t]) for x in r[1:6])}
        idf = max(math.log((len(rows) - len(held) + 0.5) / (len(held) + 0.5)), 1e-6)
        for i, hits in want.items():
            tf = sum(n * w for n, w in zip(hits[t], P.WEIGHTS.values(), strict=True))
            score[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
    order = sorted(want, key=lambda i: (-round(score[i], 6), rows[i][9], -rows[i][6].toordinal(), -i))
    assert [(r["doc_id"], r["score"]) for r in P.search(spark, path, q).collect()] == [(i, pytest.approx(score[i], abs=2e-6)) for i in order]
    pages = [P.search(spark, path, P.Search(q.terms, limit=2, offset=at, everything=True)).collect() for at in range(0, len(order), 2)]
    assert [r["doc_id"] for p in pages for r in p] == order and [p[0]["has_more"] for p in pages] == [True] * (len(pages) - 1) + [False]
    assert [r["place"] for p in pages for r in p] == list(range(1, len(order) + 1))
    official = P.search(spark, path, P.Search([], where=F.col("day") >= "2003-01-01", limit=500, offset=-3, sort="number_desc")).collect()
    ids = [r[0] for r in rows if r[10] != 0 and r[6].year >= 2003]
    ids.sort(key=lambda i: (rows[i][7] is None, -(rows[i][7] or 0), -rows[i][8], -i))
    assert [r["doc_id"] for r in official] == ids[:50] and official[0]["mode"] == "filter" and official[0]["total"] == len(ids)
    like = P.search(spark, path, P.Search(["税", "ab"], limit=50, everything=True)).collect()
    assert [r["score"] for r in like] == sorted((r["score"] for r in like), reverse=True) and {r["score"] for r in like} <= {0.0, 1.0}


def test_no_text_is_read(spark, tmp_path):
    _, frame = documents(spark)
    path = f"file://{tmp_path}/index"
    P.append(frame, path, 0)
    plan = P.search(spark, path, P.Search(["增值税"], everything=True))._jdf.queryExecution().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("text" not in line.split("Location")[0] for line in scans)
    assert any("PartitionFilters: [part" in line.replace("isnotnull(part#", "part") or "part#" in line.split("PartitionFilters")[1].split("]")[0] for line in scans if "postings" in line)
    assert any("In(gram" in line for line in scans) or any("EqualTo(gram" in line for line in scans)
    none = f"file://{tmp_path}/none"
    P.append(frame.filter("false"), none, 0)
    assert [(r["doc_id"], r["total"], r["hint"]) for r in P.search(spark, none, P.Search(["增值税"])).collect()] == [(None, 0, "no_hits")]


def test_a_block_is_posted_where_it_is():
    import pyarrow as pa

    texts = ["aaaab", "x\0\0", "🙂税", "", "abcabc"]
    cols = {"doc_id": pa.array([1, 2, 3, 4, 5], pa.int64()), "field": pa.array([3] * 5, pa.int32()), "block": pa.array([0] * 5, pa.int64()), "x": texts, "n": pa.array([5, 3, 2, 0, 4], pa.int32())}
    found = {}
    for b in P._gram_places([pa.RecordBatch.from_pydict(cols)]):
        for r in b.to_pylist():
            assert (r["doc_id"], r["gram"]) not in found
            found[r["doc_id"], r["gram"]] = r["places"]
    want = {}
    for i, (t, n) in enumerate(zip(texts, cols["n"].to_pylist(), strict=True), 1):
        for at in range(n):
            want.setdefault((i, t[at : at + 3]), []).append(at + 1)
    assert found == want


def test_postings_are_rows_of_grams_not_of_documents(spark, tmp_path):
    """Copies of a text add places, not rows, to the index, and nothing but texts is shuffled for it."""
    rows, frame = documents(spark, 400)
    text = "增值税优惠 the abcabc" * 3
    same = frame.withColumn("text", F.lit(text))
    P.append(same, f"file://{tmp_path}/index", 0)
    held = spark.read.schema(P._POSTINGS).parquet(f"file://{tmp_path}/index/postings").filter("field = 3")
    grams = {text[i : i + 3] for i in range(len(text))}
    assert held.select("gram").distinct().count() == len(grams) and held.count() <= len(grams) * 4
    assert held.agg(F.sum(F.size("postings.places"))).first()[0] == 400 * len(text) and held.agg(F.sum(F.size("postings.docs"))).first()[0] == 400 * len(grams)
    hits = P.occurrences(spark, f"file://{tmp_path}/index", ["abcab", "the", "惠 "]).filter("field = 3").groupBy("term").agg(F.count("*").alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"))
    assert {r["term"]: (r["docs"], r["least"], r["most"]) for r in hits.collect()} == {0: (400, 3, 3), 1: (400, 3, 3), 2: (400, 3, 3)}
