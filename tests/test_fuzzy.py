"""Best partial matches against a full scan."""

import random

import pytest

from lexmill.operators import fuzzy
from lexmill.operators.fuzzy import close_titles, fuzzy_match, partial_ratio


def test_short_titles_match_as_in_a_full_scan(spark):
    left = {1: "tax act", 2: "vat", 3: "rules of the water board", 4: "customs code", 5: "fees law 12", 6: "no such thing at all"}
    right = {1: "the tax act of 1990", 2: "vat", 3: "water board rules", 4: "on the customs codes and what goes with them", 5: "see fees law 12 and the others named there", 6: "rules of the water boards", 7: "a vat"}
    want = {}
    for i, a in left.items():
        score, j = max((partial_ratio(a, b), -j) for j, b in right.items())
        if score >= 88:
            want[i] = (-j, score)
    frames = [spark.createDataFrame(list(x.items()), "id int, title string") for x in (left, right)]
    assert len(want) == 5 and {r["left_id"]: (r["right_id"], r["score"]) for r in fuzzy_match(*frames).collect()} == want


def plain_gate(a, b):
    """Whether the two share what blocking asks for."""
    n = 0 if len(a) < 6 else 10 if len(a) >= 12 and len(b) >= 20 else 5
    return n == 0 or any(a[i : i + n] in b for i in range(len(a) - n + 1))


@pytest.mark.parametrize("hot", [0, 3, 200])
def test_close_titles_are_those_of_a_full_scan(spark, hot):
    rng = random.Random(9)
    words = ["增值税", "税", "关于", "印发", "办法", "通知", "企业", "所得", "公告", "的", "问题", "aaa", "aaaaaa", "ab", "x1", "国家税务总局关于"]
    rights = ["国家税务总局关于" + "".join(rng.choices(words, k=rng.randrange(1, 9))) + str(rng.randrange(100)) for _ in range(150)] + ["".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)]
    rights += ["a" * 8, "a" * 25, "b", "ab", "abab" * 6, "", None]
    lefts = []
    for t in rng.sample(rights[:-2], 130):
        cut = list(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(cut) + 1)
            cut[at : at + rng.randrange(2)] = rng.choice(["", "税", "q"])
        lo = rng.choice([0, 0, 3])
        lefts.append("".join(cut)[lo : rng.choice([4, 9, 16, 99])])
    lefts += ["a" * 9, "b", "", None, "aaaaab", "aaaa" * 8]
    want = {(a, b): n for a in set(lefts) if a for b in set(rights) if b and plain_gate(a, b) and (n := partial_ratio(a, b)) >= 88}
    frames = [spark.createDataFrame([(t,) for t in x], "title string") for x in (lefts, rights)]
    found = {(r["a"], r["b"]): r["score"] for r in close_titles(*frames, hot=hot).collect()}
    assert found == want and len({a for a, _ in want if len(a) >= 12}) > 20
    assert close_titles(frames[0].filter("false"), frames[1]).count() == 0


def test_partial_ratio_passes_over_no_window():
    from lexmill.operators.fuzzy import _common, ratio_from

    rng = random.Random(1)
    for _ in range(2000):
        a, b = sorted(("".join(rng.choices("abcd", k=rng.randrange(1, 8))), "".join(rng.choices("abcdef", k=rng.randrange(1, 14)))), key=len)
        spans = {(max(0, s), min(len(b), s + len(a))) for s in range(1 - len(a), len(b))}
        assert partial_ratio(a, b) == max(int(200 * _common(a, b[s:e]) / (len(a) + e - s)) for s, e in spans)
        want = partial_ratio(a, b)
        assert all(ratio_from(a, b, least) == (want if want >= least else 0) for least in (70, 80, 88, 92, 100))
    for _ in range(300):
        a = "".join(rng.choices("abcdefghij", k=30))
        cut = list("".join(rng.choices("abcdefghij", k=40)) + a + "".join(rng.choices("abcdefghij", k=rng.randrange(40))))
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(cut))
            cut[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        want = partial_ratio(a, "".join(cut))
        assert all(ratio_from(a, "".join(cut), least) == (want if want >= least else 0) for least in (75, 88, 95))


def test_whole_titles_against_every_pair(spark):
    rng = random.Random(8)
    some = lambda k: "".join(rng.choices("abc", k=rng.randrange(1, k)))
    a, b = ({some(30) for _ in range(150)} for _ in "ab")
    a, b = a | {x[1:] for x in b if len(x) > 12} | {"", "😀b"}, b | {x + "cc" for x in a} | {"a😀bc"}
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "title string")
    found = [(r["a"], r["b"]) for r in fuzzy.whole_titles(frame(a), frame(b)).collect()]
    want = {(x, y) for x in a for y in b if x and y and (x in y or (y in x and (len(y) >= 5 or len(x) < 6)))}
    assert len(found) == len(set(found)) and set(found) == want


def test_close_titles_either_way(spark):
    rng = random.Random(3)
    some = lambda: "国家税务总局关于" + "".join(rng.choices("增值税所得印发办法", k=rng.randrange(1, 30)))
    rights = [some() for _ in range(120)] + ["ab", "x1 y", None]
    lefts = [t[: rng.randrange(3, 40)] + rng.choice(["", "税", "q"]) for t in rights[:80]] + ["b", "增值税"]
    want = {(a, b): n for a in set(lefts) for b in set(rights) if b and plain_gate(a, b) and (n := partial_ratio(a, b)) >= 88}
    frames = [spark.createDataFrame([(t,) for t in x], "title string") for x in (lefts, rights)]
    for most in (0, 10_000_000):
        found = [((r["a"], r["b"]), r["score"]) for r in close_titles(*frames, hot=3, most=most).collect()]
        assert len(found) == len(want) and dict(found) == want


def test_few_lefts_write_no_row_for_each_key(spark, monkeypatch):
    rng, written, real = random.Random(4), [], fuzzy.materialize
    cited = "".join(rng.choices("abcdefgh ", k=120))
    rights = [f"{cited} {k} " + "".join(rng.choices("abcdefgh ", k=50)) for k in range(300)]

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "materialize", counted)
    left, right = (spark.createDataFrame([(t,) for t in x], "title string") for x in ([cited[:40] + cited[44:]], rights))
    assert close_titles(left, right).count() == 300 and max(written) == 300
