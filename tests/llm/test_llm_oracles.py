"""Queries with SQL on the small tables, and on a fixture of odd rows."""

import pytest
from compare import rows_of, rows_of_sql

from lexmill.llm import op4_embedding, op6_quality_rules, op7_chat, op9_line_dedup, oracles, queries

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e f g h i j", "Line  one\nline ONE\n\nx\ny\nz", "x\ny\nz\nx\ny\nz", "x\ny\nz", "x y\n" * 300, "w" * 50_000, "\n".join(f"l{i % 7}" for i in range(3000)),
    "long " * 60 + "\nend", "long " * 60, "# * $ < > | & %\r\n\ttab\x0bvt\x0cff", "é è ê ñ ß Ü nbsp ü", "last line\n",
]


def odd_documents(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, 7) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "shared footer line\nword " + " ".join(f"u{i}_{k}" for k in range(i % 9)), "en", "hot", 1) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_same_as_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(oracles.ORACLES[name], SF)


def test_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op6_line_frequency_rules", "op9_line_window_dedup"):
        assert rows_of(queries.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(oracles.ORACLES[name], SF, documents=f"{tmp_path}/documents.parquet/*.parquet"), name


def test_odd_conversations(spark, tmp_path):
    marks = ["<s> x </s>", "[INST]", "<\\s>", "<\\\\/s> [\\/INST]", "<<SYS>> <</SYS>> <<\\ROLE>>", "\n", " ", "", None, "a " * 3000]
    rows = [(c, t, role, marks[(c + t) % len(marks)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "tool x\n", None, "assistant", "system", "user", "assistant"][: 1 + c])]
    rows += [(50, i, "user" if i % 2 == 0 else "assistant", "hot words " * 5) for i in range(2000)] + [(0, 0, "system", marks[0])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.QUERIES["op7_chat_formatting"](spark, str(tmp_path))) == rows_of_sql(oracles.ORACLES["op7_chat_formatting"], SF, conversations=f"{tmp_path}/conversations.parquet/*.parquet")


def words_of(text):
    return len(text.split())


@pytest.mark.parametrize(("sizes", "budget"), [([100] * 59, 512), ([1000, 3000, 900, 5, 5, 1016, 1, 1], 1024), ([3] * 5000, 1024), ([500, 20, 700, 1, 300, 1020, 40] * 30, 1024)])
def test_windows_keep_to_the_budget(spark, sizes, budget):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "w " * n) for i, n in enumerate(sizes, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = op7_chat.format_windows(frame, budget=budget).orderBy("window").collect()
    mine = [r["n_turns"] - r["n_repeated"] for r in found]
    assert sum(mine) == len(rows) and [r["window"] for r in found] == [1 + sum(mine[:i]) for i in range(len(mine))]
    for r, own in zip(found, mine, strict=True):
        tokens = r["text"].count("w ") + 2 * r["text"].count("be kind") + 4 * r["n_turns"]
        alone = own == 1 and r["n_repeated"] <= 1  # a turn that is over the budget with the system turn
        assert tokens <= budget or alone
        assert r["text"].startswith("<<SYS>> be kind <</SYS>>") and r["n_repeated"] <= 3
    full = [op7_chat.TURN_TOKENS + n for n in [2, *sizes]]
    for r, nxt in zip(found, found[1:], strict=False):  # the next turn did not fit, or spans begin anew there
        first, after = r["window"], nxt["window"]
        charged = r["text"].count("w ") + 2 * r["text"].count("be kind") + 4 * r["n_turns"]
        assert charged + full[after - 1] > budget or (after - 1) % op7_chat.RESTART == 0, (first, after)
    spans = [r["text"][s["start"] : s["start"] + s["length"]] for r in found for s in r["loss_spans"]]
    assert spans == [t for _, _, role, t in rows if role == "assistant"]


def test_chat_nulls_ties_and_clashing_columns(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (2, None, "user", "last"), (2, 5, None, None), (2, 5, "user", "x"), (2, 5, "user", "x"), (0, 1, "user", "zero")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as block", "3 as k", "4 as conv")
    found = {r["conv_id"]: r for r in op7_chat.read_windows(op7_chat.format_windows(frame)).collect()}
    import hashlib

    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert {k: (r["n_turns"], r["turns_sha256"]) for k, r in found.items()} == {
        None: (2, sha(("assistant", "b"), ("user", "a"))),
        2: (4, sha(("", ""), ("user", "x"), ("user", "x"), ("user", "last"))),
        0: (1, sha(("user", "zero"))),
    }


def test_nulls_empty_tables_and_other_columns(spark):
    docs = odd_documents(spark).selectExpr("*", "1 as n_lines", "2 as kept", "3 as covered", "4 as h", "5 as n")
    assert op9_line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert op6_quality_rules.keep_by_rules(docs).columns == docs.columns
    loose = docs.withColumn("doc_id", docs.doc_id * 0 if False else docs.n_chars.cast("long")).selectExpr("nullif(doc_id, doc_id) doc_id", "text", "lang", "source", "n_chars")
    assert op9_line_dedup.dedup_lines(loose).count() == op6_quality_rules.quality_rules(loose).count() == docs.count()
    empty = docs.filter("false")
    assert op9_line_dedup.dedup_lines(empty).count() == op6_quality_rules.quality_rules(empty).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op7_chat.read_windows(op7_chat.format_windows(none)).count() == 0
    assert op4_embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passages_repeated_across_documents_go_once(spark):
    passage = "p1 one two\np2 three four\np3 five six"
    rows = [(i, f"head {i}\n{passage}\ntail {i}") for i in range(30)]
    found = {r["doc_id"]: r["text"] for r in op9_line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == rows[0][1] and all(found[i] == f"head {i}\ntail {i}" for i in range(1, 30))


def test_odd_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(200)]
    rows += [(1000 + i, base[0].tolist()) for i in range(1200)]  # copies, one class
    rows += [(2500 + i, (base[1] + 0.001 * rng.standard_normal(16)).tolist()) for i in range(1200)]  # a bucket of more than two blocks
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] * 16), (5006, [1.0, 2.0])]
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i < 5000]
    x = np.array([v for _, v in ok])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = {i: int(n) for (i, _), n in zip(ok, near.sum(axis=1), strict=True)} | {i: 0 for i, _ in rows if i >= 5000}
    found = {r["vec_id"]: r for r in op4_embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == want
    assert all(found[i]["kept"] and found[i]["component_id"] == i for i in range(5000, 5007))
    assert found[1000]["component_id"] == 0 and not found[1000]["kept"]


def test_repeated_vector_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, [0.0, 2.0]), (3, [3.0, 0.1]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as unit", "2 as same", "3 as component")
    want = sorted([("1", 1, "1"), ("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3"), ("None", 0, "None")])
    for parts in (1, 3):
        found = op4_embedding.near_duplicates(frame.repartition(parts)).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == want


def test_recall_of_pairs_at_the_threshold(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows, x = [], []
    for i in range(400):  # single pairs at cosine 0.95 to 0.96, each a component of its own
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9501, 0.96)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    found = op4_embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.filter("n_links = 1 and component_id = vec_id - vec_id % 2").count() >= 0.95 * 800


def test_passages_of_two_lines_go_too(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, f"{a}\n{b}"), (2, f"head\n{a}\n\n{b}\ntail"), (3, f"{a}\nother"), (4, f"{b}\n{a}"), (5, "x\ny"), (6, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (op9_line_dedup.drop_repeated_lines(docs), op9_line_dedup.dedup_lines(docs)):
        assert {r["doc_id"]: r["text"] for r in found.collect()} == {**dict(rows), 2: "head\ntail"}


def test_repeated_rows_are_later_occurrences(spark):
    text = "l1 a\nl2 b\nl3 c\nl4 d"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x\ny"), (2, "x\ny")], "doc_id long, text string").coalesce(1)
    assert sorted(map(str, (tuple(r) for r in op9_line_dedup.dedup_lines(docs).select("doc_id", "text", "n_removed").collect()))) == sorted(
        map(str, [(1, text, 0), (1, "", 4), (None, "", 4), (2, "x\ny", 0), (2, "x\ny", 0)])
    )
    assert op9_line_dedup.drop_repeated_lines(docs).count() == 3


def test_rules_judge_rows_not_ids(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(1, good, "a"), (1, bad, "a"), (None, good, "a"), (None, bad, None), (2, good, None), (2, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as host", "2 as row", "3 as line")
    assert op6_quality_rules.quality_rules(docs).filter("kept").count() == 4
    kept = op6_quality_rules.keep_by_rules(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "None"]


def test_long_lines_of_a_host_are_boilerplate(spark):
    legal = " ".join(f"legal{i}" for i in range(60))
    rows = [(i, f"{legal}\nown{i} words{i} here{i}", "hot") for i in range(40)] + [(100, legal, "hot"), (101, legal, "cold")]
    found = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in op6_quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {**{i: (60, False) for i in [*range(40), 100]}, 101: (0, True)}
