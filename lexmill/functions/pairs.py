"""Expressions over a text and its translation: numbers with their units, audit flags, and splitting both alike."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.identifiers import every, text_of

# Marks and words of the audits, limits of what counts as missing.
ENTITY = r"&[#A-Za-z0-9]+;"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
UNITS = {"万元": 10_000, "万": 10_000, "亿元": 100_000_000, "亿": 100_000_000}
SCALES = (1_000_000, 1_000_000_000)
SOURCE_ITEMS = r"(?:^|\n)\s*(?:[（(]\s*[一二三四五六七八九十]{1,3}\s*[)）]|[0-9]{1,3}\s*[.、．]|第[一二三四五六七八九十百]{1,4}条)"
TARGET_ITEMS = r"(?:^|\n)\s*(?:[0-9]{1,3}\s*[.、)]|Article\s+[0-9]+|\([0-9]{1,3}\)|\([a-z]\))"
UNFINISHED = r"[,;:，、；：]$|(?i)\b(and|or|the|of|in|to|with|for|by|as|that|which|shall)$"
TALK = (
    r"(?i)以下是.{0,16}(翻译|文本|内容)|以下为.{0,12}(翻译|译文)|由于.{0,12}(较长|过长|篇幅)|如需(完整|全文|获取)|仅(提供|涵盖|翻译)了?(部分|章节)|以上(翻译|内容)仅|(please|kindly) provide|"
    r"only (part|a portion) of (the|this)|(full|complete|entire) (text|content) (is|was) (too long|not provided)|未能(提供|完成|翻译)|翻译(如下|结果)[:：]"
)
SHORT, ITEMS_LEAST, ITEMS_LEFT, NUMBERS_LEAST, NUMBERS_LEFT, REPEAT_LEAST = 0.4, 8, 0.5, 8, 0.75, 40
SENTENCE_ENDS = "。；！？\n"


def _bare(x: Column) -> Column:
    return F.regexp_replace(text_of(x), ENTITY, " ")


def _plain(n: Column) -> Column:
    """A decimal as it is written, without zeros at its end."""
    s = n.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def once(value: Column, f) -> Column:
    """f of a value that is found once a row; a plain Python name stands for its expression wherever it is used, in a lambda
    even once an element."""
    return F.transform(F.array(value), f)[0]


def number_set(x: Column) -> Column:
    """The distinct numbers of a text, without commas; of a list mark run together with a year (1.2016) the year too."""
    bare = F.transform(every(_bare(x), NUMBER), lambda n: F.replace(n, F.lit(","), F.lit("")))
    glued = F.transform(F.filter(bare, lambda n: n.rlike(r"^[0-9]{1,2}\.[0-9]{4,}$")), lambda n: F.regexp_extract(n, r"\.(.*)$", 1))
    return F.array_distinct(F.concat(bare, glued))


def numbers_with_units(x: Column) -> Column:
    """array<struct<number, unit>> of a text in order; a word for `more than` may stand before the unit."""
    found = every(_bare(x), NUMBER + r"\s*(?:多|余)?\s*(?:万元|亿元|万|亿)?")
    number = lambda m: F.replace(F.regexp_extract(m, NUMBER, 0), F.lit(","), F.lit(""))
    return F.transform(found, lambda m: F.struct(F.regexp_replace(number(m), r"^[0-9]{1,2}\.([0-9]{4})$", "$1").alias("number"), F.regexp_extract(m, "(万元|亿元|万|亿)$", 1).alias("unit")))


def ways_to_write(number: Column, unit: Column) -> Column:
    """A number with a Chinese unit as it may be written elsewhere: as it stands, in full, in millions and in billions."""
    times = F.lit(None).cast("decimal(38,12)")
    for word, n in UNITS.items():
        times = F.when(unit == word, F.lit(n).cast("decimal(10,0)")).otherwise(times)
    full = number.try_cast("decimal(20,6)") * times.cast("decimal(10,0)")
    written = F.array(number, _plain(full), *[_plain(full / F.lit(s).cast("decimal(11,0)")) for s in SCALES])
    return F.filter(written, lambda w: w.isNotNull() & ~w.isin("", "0"))


def missing_numbers(source: Column, target: Column) -> Column:
    """array<struct<said, strong>>: numbers of the source that the target has in no way of writing, nor as part of a
    number. Those of three digits or more, or with a unit, are strong; others may have been put in words."""
    # a number that contains a way of writing it is found in all numbers at once, a line each
    there = F.array_join(number_set(target), "\n")
    gone = once(there, lambda lines: F.filter(numbers_with_units(source), lambda n: ~F.exists(ways_to_write(n["number"], n["unit"]), lambda w: F.contains(lines, w))))
    return F.transform(gone, lambda n: F.struct(F.concat(n["number"], n["unit"]).alias("said"), ((F.length(n["number"]) >= 3) | (n["unit"] != "")).alias("strong")))


def adjacent_repeats(x: Column) -> Column:
    """Sentences of REPEAT_LEAST characters or more that stand twice in a row."""
    parts = F.transform(F.split(text_of(x), r"(?<=[.!?])\s+", -1), lambda p: F.trim(p))
    twice = lambda p, following: F.when((F.length(p) >= REPEAT_LEAST) & (p == following), p)
    return once(parts, lambda parts: F.array_compact(F.zip_with(parts, F.slice(parts, 2, F.size(parts)), twice)))


def audit_flags(source: Column, target: Column, held_hash: Column | None = None) -> dict[str, Column]:
    """Flags of a pair: residual Han, too short, cut off, strong numbers missing, repeats, empty, items lost, numbers
    dropped, talk about the translation, and (given the hash of the source then) out of date. An empty or missing target
    has only the flag `empty`; without a source there is nothing to compare with."""
    s, t = text_of(source), text_of(target)
    has_source, has_target = s != "", F.trim(t) != ""
    n, m = F.size(number_set(source)), F.size(number_set(target))
    items, kept = F.size(every(source, SOURCE_ITEMS)), F.size(every(target, TARGET_ITEMS))
    both = has_source & has_target
    out = {
        "residual": has_target & t.rlike("[一-鿿]"),
        "short": both & (F.length(t) / F.length(s) < SHORT),
        "cut_off": has_target & F.right(F.rtrim(t), F.lit(20)).rlike(UNFINISHED),  # longer than its longest word
        "numbers_missing": both & F.exists(missing_numbers(source, target), lambda x: x["strong"]),
        "repeats": has_target & (F.size(adjacent_repeats(target)) > 0),
        "empty": F.length(F.trim(t)) < 10,
        "items_lost": both & (items >= ITEMS_LEAST) & (kept < items * ITEMS_LEFT),
        "numbers_dropped": both & (n >= NUMBERS_LEAST) & (m < n * NUMBERS_LEFT),
        "talk": has_target & t.rlike(TALK),
    }
    if held_hash is not None:
        out["out_of_date"] = both & ~held_hash.eqNullSafe(F.sha2(source, 256))
    return out


def _chunks(x: Column, size: int) -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _cut(chunks: Column, size: int, start: Column, end: Column) -> Column:
    """What stands from start to end of a text given as chunks; only the chunks in question are looked at, as finding a place
    in a text means counting its characters from the start."""
    first = F.floor(start / size).cast("int")
    near = F.slice(chunks, first + 1, F.floor(end / size).cast("int") - first + 1)
    return F.substring(F.array_join(near, ""), start - first * size + 1, end - start)


def split_alike(source: Column, target: Column, most: int) -> Column:
    """array<struct<source, target>>: both texts in as many parts as the source has lengths of `most`. A part of the source
    ends after the last end of a sentence near its length, if there is one, the target's in proportion; joined again
    either side gives its whole text. Texts are cut into chunks once, in linear time; where a part may be so short that it
    matters where the last one ended, one fold over the ends carries that, as numbers alone."""
    s, t = text_of(source), text_of(target)
    n = F.greatest(F.lit(1), F.ceil(F.length(s) / most)).cast("int")
    both = F.struct(_chunks(s, most).alias("s"), _chunks(t, most).alias("t"), F.length(s).alias("s_size"), F.length(t).alias("t_size"), n.alias("n"))
    reach = 240

    def last_end(x: Column, i: Column) -> Column:
        """How far before the end of the i-th length of `most` the last sentence within `reach` ends; `reach` if none does."""
        end = (i + 1) * most
        window = _cut(x["s"], most, F.greatest(F.lit(0), end - reach), end)
        upto = F.length(F.regexp_extract(window, rf"(?s)^.*[{SENTENCE_ENDS}]", 0))
        return F.when(upto > 0, F.least(F.lit(reach), end) - upto).otherwise(reach)

    def source_end(i: Column, before: Column, near: Column) -> Column:
        # a sentence that ends with the first character looked at is passed over
        return (i + 1) * most - F.when(before < near - 1, before).otherwise(0)

    def of_text(x: Column) -> Column:
        inner = F.sequence(F.lit(0), x["n"] - 2)
        inner = F.when(x["n"] > 1, F.transform(inner, lambda i: F.struct(i.alias("i"), last_end(x, i).alias("before"))))
        inner = F.coalesce(inner, F.array().cast("array<struct<i:int,before:int>>"))
        if most - most // 2 >= reach:
            ends = F.transform(inner, lambda e: source_end(e["i"], e["before"], F.lit(reach)))
        else:
            near = lambda done, e: F.least(F.lit(reach), F.greatest(F.lit(0), (e["i"] + 1) * most - F.element_at(done, -1) - most // 2))
            folded = F.aggregate(inner, F.array(F.lit(0)), lambda done, e: F.concat(done, F.array(source_end(e["i"], e["before"], near(done, e)))))
            ends = F.slice(folded, 2, F.greatest(F.lit(0), F.size(folded) - 1))
        ends = F.concat(F.array(F.lit(0)), ends, F.array(x["s_size"]))
        others = F.transform(F.sequence(F.lit(0), x["n"]), lambda i: F.when(i == x["n"], x["t_size"]).otherwise(F.least(x["t_size"], F.bround(i.cast("long") * x["t_size"] / x["n"]).cast("int"))))

        def pieces(at: Column) -> Column:
            def piece(i: Column) -> Column:
                one, two = ((_cut(x[c], most, F.get(at[c], i), F.get(at[c], i + 1))) for c in ("s", "t"))
                return F.struct(one.alias("source"), two.alias("target"))

            return F.transform(F.sequence(F.lit(0), x["n"] - 1), piece)

        return once(F.struct(ends.alias("s"), others.alias("t")), pieces)

    return once(both, of_text)
