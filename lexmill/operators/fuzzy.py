"""Best partial match of titles over blocked candidates."""

from functools import lru_cache, reduce
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexmill.plans.storage import BROADCAST_BYTES, discard, materialize, measured_bytes

#: Titles that hold an n-gram beyond which the n-gram alone is no key.
HOT_GRAM = 200


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with rows as bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str | None, b: str | None) -> int:
    """Best score 0..100 of the shorter text against any window of the longer, by common subsequences."""
    a, b = sorted((a or "", b or ""), key=len)
    if not a:
        return 0
    if a in b:
        return 100
    n, letters = len(a), set(a)
    best = 0
    for first in range(1 - n, len(b)):
        s, e = max(0, first), min(len(b), first + n)
        # the window one to the left holds all but such a last character, or the one without such a first character
        if (b[e - 1] if e == first + n else b[s]) in letters:
            best = max(best, int(200 * _common(a, b[s:e]) / (n + e - s)))
    return best


def lost_bigrams(least: int) -> float:
    """What share of its length a text may lose in distinct bigrams, at most, and still match a window of another at `least`
    or more, being the shorter of the two.

    With L characters in x, w in the window and c in common, 2c >= t (L + w) and c <= w, so w >= tL / (2 - t). A bigram of
    x is lost to a character of x that is not in common (two each) or to one of the window's between (one each):
    2 (L - c) + (w - c), which is greatest at an end of the range of w.
    """
    t = least / 100
    return max((2 - 1.5 * t) + (1 - 1.5 * t) * w for w in (t / (2 - t), 1.0))


def ratio_from(a: str, b: str, least: int) -> int:
    """partial_ratio where it is `least` or more, else 0.

    From one window to the next the common subsequence grows by one at most, so a window that is k short of what would
    count lets the next k - 1 be passed over.
    """
    a, b = sorted((a, b), key=len)
    if not a:
        return 0
    if a in b:
        return 100
    n, best, first = len(a), 0, 1 - len(a)
    while first < len(b):
        s, e = max(0, first), min(len(b), first + n)
        common, size = _common(a, b[s:e]), n + e - s
        best = max(best, int(200 * common / size))
        first += max(1, -(-max(least, best + 1) * size // 200) - common)
    return best if best >= least else 0


def ratios_from(least: int):
    """partial_ratio of pairs where it is `least` or more, else 0; pairs that share too few bigrams are passed over."""
    share = lost_bigrams(least)

    @F.pandas_udf(IntegerType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        parts = lru_cache(10_000)(lambda x: frozenset(x[i : i + 2] for i in range(len(x) - 1)))

        def one(x: str, y: str) -> int:
            short = x if len(x) <= len(y) else y
            few = len(parts(x) & parts(y)) < len(parts(short)) - floor(len(short) * share + 1e-9)
            return 0 if few else ratio_from(x, y, least)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    return ratios


def _grams(x: Column, n: int, block: int = 256) -> Column:
    """The distinct n-grams of characters. They are cut from blocks of a long text, as finding a place in a text means
    counting its characters from the start."""

    def of_block(k: Column) -> Column:
        cut = F.substring(x, k * block + 1, F.lit(block + n - 1))
        places = F.sequence(F.lit(1), F.least(F.lit(block), F.length(x) - (n - 1) - k * block))
        return F.transform(F.array(cut), lambda c: F.transform(places, lambda i: F.substring(c, i, F.lit(n))))[0]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - n) / block).cast("int")), of_block)
    return F.when(F.length(x) >= n, F.array_distinct(F.flatten(blocks))).otherwise(F.array().cast("array<string>"))


def _lost(x: Column, least: int) -> Column:
    return F.floor(F.length(x) * lost_bigrams(least) + 1e-9).cast("int")


def _keys(x: Column, long: bool) -> Column:
    """The keys of a title on either side: a 10-gram with rights of 20 characters or more, a 5-gram with shorter ones, and
    with all rights for lefts of 6 to 11. Shorter lefts have the one key that all rights have."""
    tag = lambda t, n: F.transform(_grams(x, n), lambda g: F.concat(F.lit(t), g))
    none = F.array().cast("array<string>")
    size = F.length(x)
    if long:
        return F.concat(F.when(size >= 20, F.concat(tag("l", 10), tag("m", 5))).otherwise(tag("s", 5)))
    return F.concat(F.when(size >= 12, tag("l", 10)).when(size >= 6, tag("m", 5)).otherwise(none), F.when(size >= 6, tag("s", 5)).otherwise(F.array(F.lit(""))))


def _contained(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x, y): the titles of x that other ones of y contain. A title is looked up by the one of its n-grams that the fewest
    of y have; where one of them stands in none, neither does the title."""
    size = F.length("x")
    x = x.select("x", F.when(size >= 10, 10).when(size >= 5, 5).otherwise(size).alias("n"))
    sizes = sorted(r["n"] for r in x.select("n").distinct().collect())  # of 1 to 5 and 10
    grams = lambda c, n: F.transform(_grams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    if not sizes:
        return x.select("x", F.col("x").alias("y"))
    of_y = materialize(y.select("y", F.explode(F.concat(*[grams("y", n) for n in sizes])).alias("g")).select("y", "g.n", "g.gram"))
    of_x = reduce(DataFrame.unionByName, [x.filter(F.col("n") == n).select("x", F.explode(grams("x", n)).alias("g")) for n in sizes]).select("x", "g.n", "g.gram")
    seen = of_y.groupBy("n", "gram").agg(F.count("*").alias("times"))
    rarest = of_x.join(seen.hint("merge"), ["n", "gram"], "left").groupBy("x", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("least"))
    rarest = rarest.filter("least.times > 0").select("x", "n", F.col("least.gram").alias("gram"))
    out = materialize(rarest.join(of_y.hint("merge"), ["n", "gram"]).filter((F.col("x") != F.col("y")) & F.contains("y", F.col("x"))).select("x", "y"))
    discard(of_y)
    return out


def whole_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs (a, b) of close_titles with a score of 100: those where one title is the other or a part of it."""
    a = materialize(left.select(F.col("title").alias("x")).filter("length(x) > 0").distinct())
    b = materialize(right.select(F.col("title").alias("x")).filter("length(x) > 0").distinct())
    inside = _contained(a, b.select(F.col("x").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a right that is too short for an n-gram is found for lefts under 6 characters alone
    around = _contained(b, a.select(F.col("x").alias("y"))).select(F.col("y").alias("a"), F.col("x").alias("b")).filter("length(b) >= 5 or length(a) < 6")
    same = a.join(b.hint("merge"), "x").select(F.col("x").alias("a"), F.col("x").alias("b"))
    return materialize(inside.unionByName(around).unionByName(same))


def _of_few(a: DataFrame, b: DataFrame, of_a: DataFrame, of_b: DataFrame, least: int) -> DataFrame:
    """(a, b, score) of close_titles where the keys of the lefts fit into every task: the keys of a right are looked up where
    they are made, numbers of titles that share one are all that is shuffled, and pairs of titles are scored unwritten."""
    lefts = materialize(a.withColumn("i", F.monotonically_increasing_id()))
    rights = materialize(b.withColumn("j", F.monotonically_increasing_id()))
    of_i = of_a.join(lefts, "a").select("key", "i")
    pairs = of_b(rights, "j").join(F.broadcast(of_i), "key").select("i", "j").distinct()
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # by bytes the numbers would be one task's
    titled = pairs.repartition(tasks, "j").join(rights.repartition(tasks, "j").hint("merge"), "j").join(F.broadcast(lefts), "i").filter("a != b")
    out = materialize(titled.select("a", "b", ratios_from(least)("a", "b").alias("score")).filter(F.col("score") >= least))
    discard(lefts, rights)
    return out


def close_titles(left: DataFrame, right: DataFrame, least: int = 88, hot: int = HOT_GRAM, most: int = BROADCAST_BYTES) -> DataFrame:
    """(a, b, score): the pairs of different titles, from the column `title` of either side, with a partial ratio of
    `least` or more that share an n-gram (10 characters, or 5 where a title is short; lefts under 6 need share none).

    Pairs are made by equal n-grams. A hot n-gram, one of more than `hot` rights, is joined together with a bigram: a pair
    that good has, of the d + 1 rarest bigrams of the shorter title, at least one in common, where d is how many it may
    lack. So a phrase that a third of all titles hold makes no pairs of all of them, and none is missed. What is left is
    checked by shared bigrams before Python scores it. Nulls and empty titles match nothing.

    Where the keys of the lefts have at most `most` bytes they are broadcast instead, whatever rights hold them: what is
    shuffled then grows with the rights, while a hot n-gram with its bigrams makes hundreds of rows a right.
    """
    a = materialize(left.select(F.col("title").alias("a")).filter("length(a) > 0").distinct())
    b = materialize(right.select(F.col("title").alias("b")).filter("length(b) > 0").distinct())
    of_a = a.select("a", F.explode(_keys(F.col("a"), False)).alias("key"))
    short = not a.filter("length(a) < 6").isEmpty()

    def of_b(b: DataFrame, name: str) -> DataFrame:
        keyed = b.select(name, F.explode(_keys(F.col("b"), True)).alias("key"))
        return keyed.unionByName(b.select(name, F.lit("").alias("key"))) if short else keyed

    same = a.join(b, F.col("a") == F.col("b")).select("a", "b", F.lit(100).alias("score"))
    if measured_bytes(of_a.select("key", F.lit(0).alias("i"))) <= most and measured_bytes(a) <= most:
        scored = _of_few(a, b, of_a, of_b, least)
        out = materialize(scored.unionByName(same))
        discard(a, b, scored)
        return out
    of_b = materialize(of_b(b, "b").join(of_a.select("key").distinct().hint("merge"), "key", "left_semi"))
    wide = of_b.groupBy("key").agg(F.count("*").alias("n")).withColumn("is_hot", (F.col("n") > hot) | (F.col("key") == ""))
    wide = materialize(wide.select("key", "is_hot"))
    seen = b.select(F.explode(_grams(F.col("b"), 2)).alias("part")).groupBy("part").agg(F.count("*").alias("n"))

    def dealt(side: DataFrame, title: str, first: str, second: str) -> DataFrame:
        """(title, key, part): hot keys with all parts of the title, and with the rarest ones, each for one of the directions."""
        keyed = side.join(wide.hint("merge"), "key")  # small in files, large in a driver
        cold = keyed.filter("not is_hot").select(title, "key", F.lit("").alias("part"))
        x = F.col(title)
        bigrams = keyed.filter("is_hot").select(title).distinct().select(title, F.explode_outer(_grams(x, 2)).alias("part")).join(seen, "part", "left")
        ranked = bigrams.groupBy(title).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))).alias("rising"))
        rarest = F.when(F.size(_grams(x, 2)) > _lost(x, least), F.slice("rising.part", 1, _lost(x, least) + 1)).otherwise(_grams(x, 1))  # of too few bigrams none is sure, but some character is
        both = F.concat(F.transform(rarest, lambda p: F.concat(F.lit(first), p)), F.transform(F.concat(_grams(x, 2), _grams(x, 1)), lambda p: F.concat(F.lit(second), p)))
        return cold.unionByName(keyed.filter("is_hot").select(title, "key").join(ranked.select(title, F.explode(both).alias("part")), title).select(title, "key", "part"))

    found = dealt(of_a, "a", "<", ">").join(dealt(of_b, "b", ">", "<"), ["key", "part"])
    shorter = F.length("a") <= F.length("b")
    right_way = (F.col("part") == "") | (shorter & F.startswith("part", F.lit("<"))) | (~shorter & F.startswith("part", F.lit(">")))
    # written, or the check below would be made for each shared key, before the pairs are distinct
    found = materialize(found.filter(right_way & (F.col("a") != F.col("b"))).select("a", "b").distinct())
    scored = materialize(found.select("a", "b", ratios_from(least)("a", "b").alias("score")).filter(F.col("score") >= least))
    out = materialize(scored.unionByName(same))
    discard(a, b, of_b, wide, found, scored)
    return out


def fuzzy_match(left: DataFrame, right: DataFrame, least: int = 88) -> DataFrame:
    """(left_id, right_id, score): the best right of each left at `least` or more among close_titles, the smaller id on
    ties. Both have (id, title); a left or right without a title matches nothing."""
    pairs = close_titles(left, right, least)
    found = left.select(F.col("id").alias("left_id"), F.col("title").alias("a")).join(pairs, "a").join(right.select(F.col("id").alias("right_id"), F.col("title").alias("b")), "b")
    by = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id")
    return found.select("left_id", "right_id", "score").withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")
