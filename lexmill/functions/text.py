"""Text, date, number and classification expressions; all stay in the JVM."""

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_identifier(x: Column) -> Column:
    """An identifier with all bracket kinds as square ones and without spaces, for lookups."""
    return F.regexp_replace(F.translate(x, "〔〕（）【】()", "[][][][]"), r"(?U)\s+", "")


def all_terms(text: Column, terms: list[str]) -> Column:
    """Every term occurs in text, case folded, taken literally; no terms, no condition."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(and_, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(True))


def occurrences(text: Column, term: str) -> Column:
    """Occurrences of term that do not overlap, case folded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("int")


def snippet(text: Column, terms: list[str], before: int = 100, after: int = 160) -> Column:
    """Text around the earliest hit of any term, with marks where it is cut; without a hit the head."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n", " ")
    spots = [F.nullif(F.instr(F.lower(flat), F.lit(t.lower())), F.lit(0)) for t in terms]
    hit = F.least(*spots, F.lit(None).cast("int")) if len(spots) > 1 else spots[0]
    start = F.greatest(hit - before, F.lit(1))
    cut = F.substring(flat, start, before + after)
    around = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + before + after <= F.length(flat), "…").otherwise(""))
    return F.when(hit.isNull(), F.substring(flat, 1, before + after)).otherwise(around)


def title_of(text: Column) -> Column:
    """The first line with anything in it, whole."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1)


def iso_date(x: Column) -> Column:
    """A date from Y-M-D, Y/M/D, Y.M.D or 年月日 forms, or year and month (the 1st); null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"(\d{4})[-/.年](\d{1,2})(?:[-/.月](\d{1,2}))?", i), F.lit(""))
    return F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(F.coalesce(part(3), F.lit("1")), 2, "0")), "yyyy-MM-dd")


def money(x: Column) -> Column:
    """The first amount in 元, 万元 or 亿元 as decimal(16,2)."""
    bare, form = F.regexp_replace(x, ",", ""), r"([0-9]+(?:\.[0-9]+)?)\s*(亿|万)?元"
    unit = F.regexp_extract(bare, form, 2)
    scale = F.when(unit == "亿", F.lit(100_000_000)).when(unit == "万", F.lit(10_000)).otherwise(F.lit(1))
    return (F.nullif(F.regexp_extract(bare, form, 1), F.lit("")).cast("decimal(18,6)") * scale).cast("decimal(16,2)")


def numbers(x: Column) -> Column:
    """The distinct numbers of a text in order, thousands separators dropped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda n: F.rtrim(F.replace(n, F.lit(","), F.lit("")))))


def html_text(x: Column) -> Column:
    """Markup to text by patterns: scripts and comments out, blocks to lines, five entities; see llm for parsing."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|li|h[1-6]|br|tr|article|footer|nav|ul)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?(\n ?)+", "\n"))


def chunks(x: Column, size: int = 600, step: int = 500, most: int | None = None) -> Column:
    """Overlapping windows of characters, the first `most` if given; the last is the first one that reaches the end."""
    n = F.length(F.coalesce(x, F.lit("")))
    starts = F.sequence(F.lit(0), (F.ceil(F.greatest(n - size, F.lit(0)) / step) * step).cast("int"), F.lit(step))
    found = F.transform(starts, lambda s: F.substring(x, s + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(found if most is None else F.slice(found, 1, most))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null for zero vectors."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def content_hash(*columns: str) -> Column:
    """sha256 over columns, with a mark of its own for null."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def page(x: Column, offset: int, size: int) -> Column:
    """(text, truncated, next_offset) of one page of a text; next_offset is null on the last."""
    more = F.length(F.coalesce(x, F.lit(""))) > offset + size
    return F.struct(F.substring(F.coalesce(x, F.lit("")), offset + 1, size).alias("text"), more.alias("truncated"), F.when(more, F.lit(offset + size)).alias("next_offset"))


def highlight(x: Column, terms: list[str]) -> Column:
    """Markup-safe text with a mark around every hit of a term."""
    out = F.coalesce(x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    form = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(out, f"(?i)({form})", "<mark>$1</mark>")


def split_pieces(x: Column, most: int) -> Column:
    """A text as pieces of at most `most` characters that give the text again when joined: whole paragraphs together
    while they fit, a longer paragraph by sentences, a longer sentence by length."""

    def pack(parts: Column) -> Column:
        def add(done: Column, part: Column) -> Column:
            last = F.element_at(done, -1)
            fits = (F.size(done) > 0) & (F.length(F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))) + F.length(part) <= most)
            return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, part)))).otherwise(F.concat(done, F.array(part)))

        return F.aggregate(parts, F.array().cast("array<string>"), add)

    def whole(part: Column, split) -> Column:
        return F.when(F.length(part) <= most, F.array(part)).otherwise(split(part))

    by_length = lambda part: F.transform(F.sequence(F.lit(0), F.greatest(F.length(part) - 1, F.lit(0)), F.lit(most)), lambda at: F.substring(part, at + 1, F.lit(most)))
    by_sentence = lambda part: F.flatten(F.transform(F.split(part, r"(?<=[。！？])|(?<=[.!?])(?=\s)", -1), lambda sentence: whole(sentence, by_length)))
    pieces = F.flatten(F.transform(F.split(F.coalesce(x, F.lit("")), r"(?<=\n)", -1), lambda paragraph: whole(paragraph, by_sentence)))
    return pack(F.filter(pieces, lambda p: p != ""))
