"""The best partial matches of titles, found block against block: pairs are counted and scored where they are made, and no row
is written for any that is not among the best."""

from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexmill.operators.fuzzy import _grams, ratio_from
from lexmill.plans.storage import discard, materialize

#: Titles of a block at most; a task holds one of either side.
BLOCK = 50_000
#: Sizes of the n-grams that are counted before a pair is scored, and 64-bit words of a title's set of each.
COUNTED, WORDS = (2, 3, 4), 4
#: Pairs of a left that are tried for a first score, and how many of them are scored.
TRIED, SCORED = 100, 4
#: Rights of a left that are scored one by one before the bound is looked at again, and from how many on they are scored together.
FIRST, MANY = 8, 16


@lru_cache(100_000)
def lost_at(q: int, least: int, n: int) -> int:
    """How many of its q-grams, each as often as it has them, a text of n characters may lack, at most, and still match a window
    of a longer one at `least`: with w characters in the window and c in common, q for each that is not in common and q - 1
    for each between."""
    w = np.arange(1, n + 1)
    c = -(-least * (n + w) // 200)
    return int((q * (n - c) + (q - 1) * (w - c))[c <= w].max(initial=0))


def shares_key(a: str, b: str) -> bool:
    """Whether two titles share what close_titles asks for."""
    n = 0 if len(a) < 6 else 10 if len(a) >= 12 and len(b) >= 20 else 5
    return n == 0 or any(a[i : i + n] in b for i in range(len(a) - n + 1))


def _codes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the hashes of all q-grams of texts, in order."""
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row, n = np.repeat(np.arange(len(texts)), size), max(0, len(c) - q + 1)
    code = np.zeros(n, np.uint64)
    for k in range(q):
        code = (code ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    inner = row[:n] == row[q - 1 : q - 1 + n]
    return row[:n][inner], code[inner]


def gram_sets(texts: list[str]) -> np.ndarray:
    """A row of words for each text: for each of COUNTED the bits of its n-grams, of one that it has k times of k of them. A text
    that lacks k n-grams of another lacks k of its bits at most, as equal ones have equal bits."""
    out = np.zeros((len(texts), len(COUNTED) * WORDS), np.uint64)
    for at, q in enumerate(COUNTED):
        row, code = _codes(texts, q)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        bit = ((code + nth.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(64 * WORDS)
        np.bitwise_or.at(out, (row, at * WORDS + (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _counts(sets: np.ndarray) -> np.ndarray:
    """How many bits a row has of each of COUNTED."""
    return np.bitwise_count(sets).reshape(len(sets), len(COUNTED), WORDS).sum(axis=2, dtype=np.int64)


class _Index:
    """The rows of texts by the n-grams that they hold."""

    def __init__(self, texts: list[str], rows: np.ndarray, n: int):
        row, code = _codes([texts[i] for i in rows.tolist()], n)
        order = np.argsort(code, kind="stable")
        self.n, self.code, self.row = n, code[order], rows[row[order]]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the spans of `row` of those that share an n-gram with it."""
        row, code = _codes(texts, self.n)
        low, high = (np.searchsorted(self.code, code, side) for side in ("left", "right"))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        some = high > low
        for i, *span in zip(row[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            out[i].append(span)
        return out


def best_two(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of left (a, bars, least) and right (b, marks, rank) the pairs (a, b, score): for each left the two best rights at `least`
    or more without a mark that it bars, by score, then the lower rank."""
    lefts, rights = left.column("a").to_pylist(), right.column("b").to_pylist()
    bars, marks = left.column("bars").to_pylist(), right.column("marks").to_pylist()
    least, rank = left.column("least").to_pylist(), right.column("rank").to_pylist()
    of_a, of_b = gram_sets(lefts), gram_sets(rights)
    held_a, held_b = _counts(of_a), _counts(of_b)
    size = np.array([len(b) for b in rights], np.int64)
    lengths, which = np.unique(size, return_inverse=True)
    lost = lru_cache(None)(lambda t, n: np.array([lost_at(q, t, n) for q in COUNTED]))
    needed = lru_cache(None)(lambda t: held_b - np.array([lost(t, n) for n in lengths.tolist()]).reshape(-1, len(COUNTED))[which])
    long, short, every = np.flatnonzero(size >= 20), np.flatnonzero(size < 20), np.arange(len(rights))
    index = lru_cache(None)(lambda name, n: _Index(rights, {"long": long, "short": short, "every": every}[name], n))
    # what close_titles asks for: 10 characters with long rights, 5 with short ones, 5 with any for lefts under 12
    shared: list[list[tuple[_Index, list]]] = [[] for _ in lefts]
    for keys, some in (((("long", 10), ("short", 5)), [i for i, a in enumerate(lefts) if len(a) >= 12]), ((("every", 5),), [i for i, a in enumerate(lefts) if 6 <= len(a) < 12])):
        for key in keys if some else ():
            for i, spans in zip(some, index(*key).spans([lefts[i] for i in some]), strict=True):
                shared[i].append((index(*key), spans))
    seen, rows = np.zeros(len(rights), bool), []
    for i, a in enumerate(lefts):
        n, t = len(a), least[i]
        for key, spans in shared[i]:
            for low, high in spans:
                seen[key.row[low:high]] = True
        hits = np.flatnonzero(seen) if n >= 6 else every
        seen[hits] = False
        if not len(hits):
            continue
        bits = np.bitwise_count(of_b[hits] & of_a[i])
        common = (bits.view(np.uint32) * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int64) if WORDS == 4 else _counts(of_b[hits] & of_a[i])  # four bytes at once
        fits = lambda t: (common >= np.where((size[hits] >= n)[:, None], held_a[i] - lost(t, n), needed(t)[hits])).all(axis=1)  # noqa: B023, E731
        good = np.flatnonzero(fits(t))
        good = hits[good[np.argsort(-common[good].sum(axis=1), kind="stable")]]
        top, score = [], scorer(a)

        def take(js: list[int], found: list[int]) -> None:
            nonlocal top, t  # noqa: B023
            for j, x in zip(js, found, strict=True):
                if x >= t and not bars[i] & marks[j] and shares_key(a, rights[j]):  # noqa: B023
                    top = sorted([*top, (-x, rank[j], j)])[:2]
                    t = -top[1][0] if len(top) == 2 else t

        for j in good[:FIRST].tolist():
            take([j], [score(rights[j], t)])
        rest = good[FIRST:]
        if t > least[i] and len(rest):  # fewer can be as good as the two
            rest = rest[np.isin(rest, hits[fits(t)])]
        for m in np.unique(size[rest]).tolist():
            js = rest[size[rest] == m].tolist()
            take(js, scores_of(a, [rights[j] for j in js], t) if len(js) >= MANY and n <= min(m, 63) else [score(rights[j], t) for j in js])
        rows += [(a, rights[j], -s) for s, _, j in top]
    return pa.table({"a": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.string()), "score": pa.array([r[2] for r in rows], pa.int32())})


def scores_of(a: str, texts: list[str], least: int) -> list[int]:
    """ratio_from of a text of up to 63 characters and texts of one length, its own or more, all at once."""
    n, m, k = len(a), len(texts[0]), len(texts)
    letters = sorted(set(a))
    own = np.array([sum(1 << i for i, c in enumerate(a) if c == x) for x in letters], np.uint64)
    codes = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(k, m).T
    at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
    at = np.where(codes[at] == c, own[at], np.uint64(0))
    full, best, fewest = np.uint64((1 << n) - 1), np.zeros(k, np.int64), -(-least * n // (200 - least))
    for first in range(fewest - n, m - fewest + 1):
        s, e = max(0, first), min(m, first + n)
        row = np.full(k, full)
        for p in range(s, e):
            hit = row & at[p]
            row = ((row + hit) | (row - hit)) & full
        np.maximum(best, 200 * (n - np.bitwise_count(row).astype(np.int64)) // (n + e - s), out=best)
    return np.where(best >= least, best, 0).tolist()


def scorer(a: str):
    """ratio_from for one text against many, each with a `least` of its own."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    n, full = len(a), (1 << len(a)) - 1

    def score(b: str, least: int) -> int:
        if len(b) < n:
            return scorer(b)(a, least)
        if a in b:
            return 100
        best, fewest = 0, -(-least * n // (200 - least))  # of so many characters a window has as many in common at least
        first = fewest - n
        while first <= len(b) - fewest:
            s, e = max(0, first), min(len(b), first + n)
            row = full
            for c in b[s:e]:
                hit = row & at.get(c, 0)
                row = ((row + hit) | (row - hit)) & full
            common, size = n - row.bit_count(), n + e - s
            best = max(best, 200 * common // size)
            first += max(1, -(-max(least, best + 1) * size // 200) - common)
        return best if best >= least else 0

    return score


def likely_titles(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(a, b, score): for each left that shares five characters in a row with any right, or has under six itself, a row with
    one or more of the close rights that share its rarest 5-grams, or with nulls; what a search for the best begins from."""
    lefts = materialize(left.select(F.col("title").alias("a")).filter("a != ''").distinct().withColumn("i", F.monotonically_increasing_id()))
    rights = materialize(right.select(F.col("title").alias("b")).filter("b != ''").distinct().withColumn("j", F.monotonically_increasing_id()))
    keyed = lambda side, x, i: side.select(i, F.explode(F.transform(_grams(F.col(x), 5), lambda g: F.xxhash64(g))).alias("g"))
    seen = keyed(rights, "b", "j").groupBy("g").agg(F.count("*").alias("n"))
    rising = Window.partitionBy("i").orderBy("n", "g")
    of_a = keyed(lefts, "a", "i").join(seen.hint("merge"), "g").withColumn("upto", F.sum("n").over(rising)).withColumn("nth", F.row_number().over(rising))
    of_a = materialize(of_a.filter(f"nth = 1 or upto <= {TRIED}").select("i", "g", "upto"))
    pairs = of_a.filter(f"upto <= {10 * TRIED}").join(keyed(rights, "b", "j").hint("merge"), "g").groupBy("i", "j").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "j"))).filter(f"nth <= {SCORED}").select("i", "j")

    @F.udf(IntegerType(), useArrow=True)
    def scored(a: str, b: str) -> int:
        return 100 if a == b else ratio_from(a, b, least) if shares_key(a, b) else 0

    found = pairs.join(rights.hint("merge"), "j").join(lefts.hint("merge"), "i").select("i", "b", scored("a", "b").alias("score")).filter(F.col("score") >= least)
    every = of_a.select("i").unionByName(lefts.filter("length(a) < 6").select("i")).distinct()
    out = materialize(every.join(lefts.hint("merge"), "i").join(found.hint("merge"), "i", "left").select("a", "b", "score"))
    discard(lefts, rights, of_a)
    return out


def closest_titles(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, score): of left (a, bars, least) and right (b, marks, rank), distinct and none empty, the pairs of close_titles
    with a score of `least` or more, equal titles too, without a mark that the left bars (bits of two numbers): for each
    left the two best by score, then the lower rank, and some others.

    Either side is dealt into blocks of up to `block` titles, and a task takes one of each, so it holds no more however
    long the tables are; each title is sent to as many tasks as the other side has blocks. In the task the rights of an index
    that share what close_titles asks for are counted by the bits of their n-grams, of which a pair that good shares all but a
    few, and what is left is scored, from the most shared on, with two found as the bound of what follows.
    """
    n, m = left.count(), right.count()
    if not n or not m:
        return left.limit(0).select("a", F.col("a").alias("b"), F.lit(0).alias("score"))
    cells = max(3 * left.sparkSession.sparkContext.defaultParallelism, ceil(n / block) * ceil(m / block))
    of_right = min(cells, max(ceil(m / block), round(sqrt(cells * m / n))))
    of_left = max(ceil(n / block), ceil(cells / of_right))
    deal = lambda x, k: F.pmod(F.xxhash64(x), F.lit(k))
    sent = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select("a", F.col("bars").cast("int").alias("bars"), F.col("least").cast("int").alias("least"), deal("a", of_left).alias("mine"), sent(of_right).alias("other"))
    b = right.select("b", F.col("marks").cast("int").alias("marks"), "rank", deal("b", of_right).alias("mine"), sent(of_left).alias("other"))
    a = a.select("a", "bars", "least", (F.col("mine") * of_right + F.col("other")).alias("cell")).repartition(of_left * of_right, "cell")  # by bytes they would be one task's
    b = b.select("b", "marks", "rank", (F.col("other") * of_right + F.col("mine")).alias("cell")).repartition(of_left * of_right, "cell")
    return materialize(a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(best_two, "a string, b string, score int"))
