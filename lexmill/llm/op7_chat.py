"""Chat formatting in budgeted windows.

Only DataFrame functions. Turns are numbered within their conversation in two steps, within blocks of turn numbers and
then by the blocks' sizes, so no task sorts a whole conversation. Windows are chosen on compact rows (place, tokens): the
running sum of tokens, charged with the conversation's first system turn and the repeated history, is held against the
budget, and a span ends with the turn before the one that goes over. Spans begin anew every RESTART turns, which bounds
what is gathered at a time. Only then do the turns' texts join the windows that hold them. A window repeats the system
turn and those of the `history` turns before its span that fit; the loss mask holds the assistant turns of the span
itself, so every target counts once. A turn over the budget is alone in its window with the system turn.

The template marks a turn as OPEN + " " + text + " " + CLOSE of its role. Control strings inside a text are broken by
a backslash after their first character, one more than the text itself has there, so escaping can be undone exactly.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.storage import join_checked, materialize

#: Tokens of a window, turns repeated before its span at most, tokens of a turn's marks, and turns after which spans begin anew.
BUDGET, HISTORY, TURN_TOKENS, RESTART = 1024, 2, 4, 4096

# The control strings of the template. Other roles are written in hex into an OTHER turn.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
_REST = r"(/?s>|</?SYS>>|</?ROLE>>|/?INST\])"
_TURN = r"(?s)(?:<<SYS>>|\[INST\]|<s>|<<ROLE>>) (?:.*?) (?:<</SYS>>|\[/INST\]|</s>|<</ROLE>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def _turn(role: Column, text: Column) -> Column:
    """A turn as the template writes it."""
    out = F.concat(F.lit(OTHER[0] + " "), F.hex(F.encode(role, "UTF-8")), F.lit("\n"), escape(text), F.lit(" " + OTHER[1]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a + " "), escape(text), F.lit(" " + b))).otherwise(out)
    return out


def _read(turn: Column) -> Column:
    """(role, text) of a turn that the template wrote."""
    inner = F.regexp_extract(turn, r"(?s)^(\S+) (.*) (\S+)$", 2)
    out = F.struct(F.decode(F.unhex(F.substring_index(inner, "\n", 1)), "UTF-8").alias("role"), unescape(F.regexp_replace(inner, r"(?s)^[^\n]*\n", "")).alias("text"))
    for name, (a, _) in MARKS.items():
        out = F.when(F.startswith(turn, F.lit(a + " ")), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(out)
    return out


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns keyed by (conv, none, block, k), and compact rows with each turn's place nth in its conversation.

    none marks the conversation without an id; k is the place within a block of RESTART turn numbers.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").cast("long").isNull().alias("none"),
        F.coalesce(F.floor(turn / RESTART).cast("long"), F.lit(1 << 62)).alias("block"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    of = Window.partitionBy("conv", "none", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    turns = materialize(rows.withColumn("k", F.row_number().over(of)).withColumn("tokens", F.lit(TURN_TOKENS) + F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).drop("turn"))
    size = turns.groupBy("conv", "none", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv", "none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select("conv", "none", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    compact = turns.select("conv", "none", "block", "k", "tokens", (F.col("role") == "system").alias("system"))
    return turns, join_checked(compact, before, ["conv", "none", "block"]).select("conv", "none", (F.col("before") + F.col("k")).alias("nth"), "block", "k", "tokens", "system")


_SPANS = "array<struct<first:bigint,repeats:int>>"


def _spans(turns: Column, system: Column, part: Column, budget: int, history: int) -> Column:
    """(first, repeats) of each window over `turns` in order; those of earlier parts stand before as history only."""

    def add(s: Column, x: Column) -> Column:
        head = F.when(system["nth"] < x["nth"], system["tokens"]).otherwise(F.lit(0)).cast("long")
        fits = (F.size(s["spans"]) > 0) & (s["used"] + x["tokens"] <= budget)
        room = F.lit(budget) - head - x["tokens"]
        sums = F.transform(s["earlier"], lambda _, i: F.aggregate(F.slice(s["earlier"], 1, i + 1), F.lit(0).cast("long"), lambda n, e: n + e))
        repeats = F.size(F.filter(sums, lambda n: n <= room))
        opened = F.struct(x["nth"].alias("first"), repeats.alias("repeats"))
        begun = head + x["tokens"] + F.coalesce(F.get(sums, repeats - 1), F.lit(0))
        mine = x["part"] == part
        kept = F.when(~mine | fits, s["spans"]).otherwise(F.concat(s["spans"], F.array(opened)))
        cost = F.when(x["system"], F.lit(0)).otherwise(x["tokens"]).cast("long")  # the system turn is retained anyway
        return F.struct(
            F.when(fits, s["used"] + x["tokens"]).otherwise(begun).cast("long").alias("used"),
            F.slice(F.concat(F.array(cost), s["earlier"]), 1, history).alias("earlier"),
            kept.alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("earlier"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, text, loss_spans) for conversations(conv_id, turn, role, text).

    window is the number of its first own turn; text is the formatted window, whose first n_repeated turns stand in
    earlier windows too. loss_spans lists (start, length) in characters from 0, of the escaped texts under the loss
    mask. A window's turns hold at most `budget` tokens (words, and TURN_TOKENS a turn) unless it has one own turn that
    is over it with the system turn; history that does not fit is left out, the farthest first. Null text and role
    count as empty; null conv_id is a conversation of its own; null turns come last; rows with equal turn, repeated
    ones too, are ordered by role and text; other columns are not read; an empty table gives an empty table.
    """
    turns, compact = _numbered(conversations)
    compact = materialize(compact)
    head = compact.filter("system").groupBy("conv", "none").agg(F.min(F.struct("nth", "block", "k", "tokens")).alias("head"))
    part = F.floor((F.col("nth") - 1) / RESTART)
    last = F.col("nth") - part * RESTART > RESTART - history  # the next part's history
    parts = compact.withColumn("part", part).withColumn("in", F.explode(F.when(last, F.array(part, part + 1)).otherwise(F.array(part))))
    grouped = parts.groupBy("conv", "none", "in").agg(F.array_sort(F.collect_list(F.struct("nth", "block", "k", "tokens", "system", "part"))).alias("turns"))
    grouped = grouped.join(head, ["conv", "none"], "left")
    chosen = grouped.select("conv", "none", "head", "turns", _spans(F.col("turns"), F.col("head"), F.col("in"), budget, history).alias("spans"))
    ends = F.transform("spans", lambda s, i: F.struct(s["first"].alias("first"), s["repeats"].alias("repeats"), (F.coalesce(F.get("spans", i + 1)["first"], F.element_at("turns", -1)["nth"] + 1) - 1).alias("last")))
    spans = chosen.withColumn("s", F.explode(ends)).select("conv", "none", "head", "turns", "s.first", "s.repeats", "s.last")
    begin = (F.col("first") - F.col("repeats") - F.element_at("turns", 1)["nth"] + 1).cast("int")
    held = F.expr("slice(turns, begin, cast(last - first as int) + repeats + 1)")
    place = lambda x, nth, repeated: F.struct(x["block"].alias("block"), x["k"].alias("k"), nth.alias("nth"), repeated.alias("repeated"))
    own = F.transform(F.filter(held, lambda x: (x["nth"] >= F.col("first")) | ~x["system"]), lambda x: place(x, x["nth"], x["nth"] < F.col("first")))
    kept = F.when(F.col("head.nth") < F.col("first"), F.array(place(F.col("head"), F.lit(0).cast("long"), F.lit(True)))).otherwise(F.slice(own, 1, 0))
    members = spans.withColumn("begin", begin).select("conv", "none", F.col("first").alias("window"), F.explode(F.concat(kept, own)).alias("m")).select("conv", "none", "window", "m.*")
    parts = (
        members.join(turns.select("conv", "none", "block", "k", "role", "text"), ["conv", "none", "block", "k"])
        .groupBy("conv", "none", "window")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "repeated", "role", "text"))).alias("t"))
        .select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "window", "t")
    )
    parts = parts.select(
        "conv_id",
        "window",
        F.transform("t", lambda x: F.struct(_turn(x["role"], x["text"]).alias("text"), (~x["repeated"] & (x["role"] == "assistant")).alias("target"), x["repeated"].alias("repeated"))).alias("t"),
    )
    lead, tail = len(MARKS["assistant"][0]) + 1, len(MARKS["assistant"][1]) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "t",
        start,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.when(x["target"], F.concat(s["spans"], F.array(F.struct((s["at"] + lead).alias("start"), (F.length(x["text"]) - lead - tail).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return parts.select(
        "conv_id",
        "window",
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["repeated"])).cast("long").alias("n_repeated"),
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"),
        spans.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows' text.

    The digest of a conversation needs all its turns in one value; nothing else here gathers a conversation.
    """
    fresh = F.transform(F.expr("slice(parsed, cast(n_repeated as int) + 1, size(parsed))"), _read)
    one = windows.withColumn("parsed", F.regexp_extract_all("text", F.lit(_TURN), F.lit(0))).select(
        "conv_id",
        "window",
        fresh.alias("turns"),
        F.length("text").cast("long").alias("chars"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "").alias("loss"),
    )
    one = one.select(
        "conv_id",
        "window",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        "chars",
        "loss",
    )
    whole = one.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return whole.select("conv_id", "n_turns", joined("turns").alias("turns"), joined("loss").alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
