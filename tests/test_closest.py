"""The best partial matches, block against block, against a full scan."""

import random

from pyspark.sql import functions as F

from lexmill.operators import closest, fuzzy, relations
from lexmill.operators.fuzzy import partial_ratio


def some_titles(rng, n):
    words = ["增值税", "税", "印发", "办法", "企业", "所得", "问题", "aaa", "ab", "x1", "The", "ouwhe", "rend", "Of", "Of"]
    titles = {rng.choice(["国家税务总局关于", "关于", ""]) + "".join(rng.choices(words, k=rng.randrange(1, 9))) + rng.choice(["的公告", "有关问题的通知", ""]) for _ in range(n)}
    return sorted(titles | {f"国家税务总局关于公布失效废止文件目录的公告{rng.randrange(10**5)}" for _ in range(n // 3)} | {"a" * 8, "a" * 25, "b", "ab" * 14, "a😀bc的公告" * 12})


def test_the_two_best_are_those_of_a_full_scan(spark):
    rng = random.Random(6)
    rights, lefts = some_titles(rng, 170), set()
    for t in rng.sample(rights, 120):
        at = rng.randrange(len(t) + 1)
        lefts.add(t[:at] + rng.choice(["", "", "税", "q"]) + t[at + rng.randrange(3) :])
    lefts = sorted({*lefts, "b", "ab", "aaaab", "财税〔2017〕1号"} - {""})
    a = [(t, rng.randrange(4), rng.choice([75, 88, 90, 92, 95])) for t in lefts]
    b = [(t, rng.choice([0, 0, 1, 2]), k) for k, t in enumerate(rng.sample(rights, len(rights)))]
    scores = {(x, y): 100 if x == y else partial_ratio(x, y) if closest.shares_key(x, y) else 0 for x in lefts for y in rights}
    want = {x: sorted((-scores[x, y], k, y) for y, marks, k in b if not bars & marks and scores[x, y] >= least)[:2] for x, bars, least in a}
    rank = {y: k for y, _, k in b}
    frames = spark.createDataFrame(a, "a string, bars int, least int"), spark.createDataFrame(b, "b string, marks int, rank long")
    for block in (30, 10_000):
        found = {x: [] for x in lefts}
        for r in closest.closest_titles(*frames, block=block).collect():
            found[r["a"]].append((-r["score"], rank[r["b"]], r["b"]))
        assert {x: sorted(y)[:2] for x, y in found.items()} == want
    assert sum(len(x) for x in want.values()) > 100
    assert closest.closest_titles(frames[0].filter("false"), frames[1]).count() == 0


def test_scores_of_many_are_those_of_each():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choices("abcd😀", k=rng.randrange(1, 30)))
        texts = [a[: rng.randrange(len(a))] + "".join(rng.choices("abcd😀", k=70)) for _ in range(5)]
        texts = [t[:60] for t in texts]
        for least in (70, 88, 95):
            assert closest.scores_of(a, texts, least) == [closest.scorer(a)(t, least) for t in texts] == [x if (x := partial_ratio(a, t)) >= least else 0 for t in texts]


def test_mentions_write_no_row_for_each_pair(spark, monkeypatch):
    """Titles that all are close to what is mentioned, as those of catalogues are, which differ in their numbers."""
    written, real = [], closest.materialize

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    for module in (closest, fuzzy, relations):
        monkeypatch.setattr(module, "materialize", counted)
    title = "国家税务总局关于公布失效废止文件目录的公告{}"
    docs = spark.createDataFrame([(i, title.format(10_000 + i)) for i in range(400)], "doc_id long, key string")
    said = [title.format(10_000 + i).replace("布失", "") for i in range(0, 400, 5)]
    mentions = spark.createDataFrame([(1000 + i, k, 88, False) for i, k in enumerate(said)], "src long, key string, least int, acts boolean")
    found = {r["key"]: (r["dst"], r["score"]) for r in relations.best_titles(mentions, docs).collect()}
    scores = {k: [(-partial_ratio(k, title.format(10_000 + i)), i) for i in range(400)] for k in said[::20]}
    assert {k: found[k] for k in scores} == {k: (min(x)[1], -min(x)[0]) for k, x in scores.items()}
    assert len(found) == 80 and all(dst is not None for dst, _ in found.values())
    assert max(written) < 15_000  # n-grams of the titles, some 35 each; the pairs are 32,000
    assert docs.filter(F.col("key").isin(said)).isEmpty()
