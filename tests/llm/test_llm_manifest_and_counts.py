"""Alignment, token counts and manifests against plain Python over whole texts."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from compare import rows_of, rows_of_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import op11_alignment, op12_counts, op13_merkle, oracles, queries
from lexmill.plans.storage import table

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
ODD = [
    None, "", " ", "  ", "\n", "x", "x ", " x", "a  b \n c\t\n  d", "a  b　 c", "<s> </s><unk> <|endoftext|>", "▁", "a▁b", "it's 12,345 <0x41>", "é ﬁ ① Σς 日本語 🙂‍🙂", "\x00 \x1c \x85",
    "᠎ ​ ﻿ x", "z" * 700, "日本語" * 400, "word " * 3000, "same text", "same text", " " * 300 + "x",
]
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "　", "​", "﻿", "᠎", "'s", "12", "é", "日", "🙂", "\x1c", "\x85", " ", "ﬁ", "!", "<s>", "<|endoftext|>", "▁", "́", "foo", "\r", "\x00"]
TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ALPHABET), max_size=15).map("".join))


def odd(spark):
    return spark.createDataFrame([(i if i != 9 else None, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, block long, pair string")


def plain_tokens(text):
    """(a ids, a ends, b ids, b ends) of the whole text, or nothing."""
    if not text:
        return [], [], [], []
    from lexmill.llm.bpe import _byte_chars

    byte_of = {c: b for b, c in enumerate(_byte_chars())}
    a, b, raw = A.encode(" " + text, add_special_tokens=False), B.encode(text), (" " + text).encode()
    sides = [[bytes(byte_of[c] for c in A.id_to_token(i)) for i in a.ids], [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(s) != raw for s in sides):
        return [], [], [], []
    ends = [list(accumulate(map(len, s))) for s in sides]
    return a.ids, ends[0], b, ends[1]


def plain_alignment(text):
    """(n_a, n_b, groups as text, links as pairs of ids), by comparing all tokens of either side."""
    a, ea, b, eb = plain_tokens(text)
    groups, i, j = [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        k, m = ea.index(e, i) + 1, eb.index(e, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    sa, sb = [0, *ea], [0, *eb]
    links, j0 = [], 0
    for i in range(len(a)):
        while j0 < len(b) and eb[j0] <= sa[i]:
            j0 += 1
        j = j0
        while j < len(b) and sb[j] < ea[i]:
            links.append((a[i], b[j]))
            j += 1
    return len(a), len(b), ";".join(groups), links


@given(TEXT)
@settings(deadline=None, max_examples=300)
def test_alignment_of_a_text(text):
    found = op11_alignment.aligner(BYTES, PIECES)([text])[0]
    n_a, n_b, groups, links = plain_alignment(text)
    assert (sum(s.n_a for s in found), sum(s.n_b for s in found), ";".join(s.groups for s in found), sum(s.n_groups for s in found)) == (n_a, n_b, groups, groups.count("|"))
    assert [int.from_bytes(s.pairs[8 * k : 8 * k + 8], "little") for s in found for k in range(len(s.pairs) // 8)] == [x << 32 | y for x, y in links]


@pytest.mark.parametrize("block_chars", [op11_alignment.BLOCK_CHARS, 3000])
def test_alignment_counts_by_brute_force(spark, block_chars):
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(120).unionByName(odd(spark).selectExpr("doc_id + 1000000 as doc_id", "text"))
    rows = docs.collect()
    each = [plain_alignment(r["text"]) for r in rows]
    n = Counter(x for *_, links in each for x in links)
    top: dict[int, int] = {}
    for (_, b), k in n.items():
        top[b] = max(top.get(b, 0), k)
    want = []
    for r, (n_a, n_b, groups, links) in zip(rows, each, strict=True):
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want.append((r["doc_id"], n_a, n_b, groups.count("|"), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), sha))
    found = op11_alignment.alignment_counts(docs.selectExpr("*", "1 as block", "2 as pair", "3 as n"), BYTES, PIECES, block_chars)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_alignment_groups_and_empty_tables(spark):
    found = {r["doc_id"]: r["groups"] for r in op11_alignment.token_groups(odd(spark), BYTES, PIECES).collect()}
    for i, t in enumerate(ODD):
        if i != 9:
            assert ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in found[i]) == plain_alignment(t)[2]
    for none in (odd(spark).filter("false"), odd(spark).filter("doc_id = 1")):
        assert [tuple(r) for r in op11_alignment.alignment_counts(none, BYTES, PIECES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * none.count()
    assert op11_alignment.token_groups(odd(spark).filter("false"), BYTES, PIECES).count() == 0


@given(TEXT)
@settings(deadline=None, max_examples=300)
def test_counts_as_the_library(text):
    assert op12_counts.counter(PIECES).counts([text]) == [len(B.encode(text))]


def test_counts_of_all_characters():
    texts = [f"a {chr(i)}b{chr(i)} {chr(i)} c" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    assert op12_counts.counter(PIECES).counts(texts) == [len(x) for x in B.encode(texts)]


def test_counts_of_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(B.encode(r["text"] or "")), n > 4096) for r in docs.collect()]
    assert sorted(map(str, map(tuple, op12_counts.token_counts(docs.selectExpr("*", "1 as n_tokens"), PIECES).collect()))) == sorted(map(str, want))
    assert op12_counts.token_counts(docs.filter("false"), PIECES).count() == 0


def test_tables_of_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(op12_counts, "KEEP_CHARS", 50)
    monkeypatch.setattr(op11_alignment, "KEEP_CHARS", 50)
    c, a = op12_counts.HeapMerges(PIECES), op11_alignment.Aligner(BYTES, PIECES)
    rng = random.Random(2)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdeé", k=rng.choice([3, 8, 300]))) for _ in range(10))
        assert c.counts([text]) == [len(B.encode(text))]
        assert ";".join(s.groups for s in a([text])[0]) == plain_alignment(text)[2]
        assert len(c.kept) <= 30 and len(a.kept) <= 30 and all(len(s) <= 200 for s in [*c.kept, *a.kept])


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """The root, and for each node its siblings as (left, right) of each level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(nodes)):
        at, steps = i, []
        for level in levels[:-1]:
            low = at // 3 * 3
            steps.append(("".join(level[low:at]), "".join(level[at + 1 : low + 3])))
            at //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def plain_manifest(rows):
    by: dict = {}
    for r in rows:
        leaf = lambda text, r=r: digest(*map(sized, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
        held = r["text"].replace("\n", "") if r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]
        by.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["text"])), leaf(held), r["doc_id"]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[0][2] for x in sorted(by[s], key=lambda x: x[0])]) for s in sources]
    root, upper = plain_tree([sub for sub, _ in trees])
    out = []
    for s, (sub, proofs), above in zip(sources, trees, upper, strict=True):
        for (order, held, doc_id), proof in zip(sorted(by[s], key=lambda x: x[0]), proofs, strict=True):
            node = held
            for left, right in (*proof, *above):
                node = digest(left, node, right)
            out.append((doc_id, order[2], sub, root, digest(*[x + y for x, y in (*proof, *above)]), node, node == root))
    return sorted(map(str, out))


def odd_manifest(spark):
    rows = [(i if i % 7 else None, None if i % 3 == 0 else f"t\n{i % 5}", "en", [None, "a", "é", "b", "zz", "", "🙂", "￮"][i % 8] if i < 400 else "hot", i % 2 or None) for i in range(1200)]
    rows += [(9, "x\ny", None, "lone", 1)] + [(5, "d\n", "en", "hot", 1)] * 9 + [(2000 + i, "x" * 9000, "en", f"host{i:03}", 2) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_manifest_by_brute_force(spark, tmp_path):
    docs = odd_manifest(spark)
    found = op13_merkle.manifest(docs.selectExpr("*", "1 as rank", "2 as total", "3 as node")).collect()
    assert sorted(map(str, map(tuple, found))) == plain_manifest(docs.collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))) == rows_of_sql(oracles.ORACLES["op13_merkle_manifest"], SF, documents=f"{tmp_path}/documents.parquet/*.parquet")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 81, 82, 244])
def test_manifest_of_few_documents(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}\n", "en", "s", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, map(tuple, op13_merkle.manifest(docs).collect()))) == (plain_manifest(docs.collect()) if n else [])
