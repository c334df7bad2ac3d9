"""Operators that SQL can't express: brute force, exact round trips and held-out accuracy."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import bpe, op1_html, op2_simhash, op3_quality, op5_packing, op8_toxicity, op10_bpe, queries
from lexmill.plans.storage import table

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [None, "", " \n", "x", "The the  THE", "<|endoftext|> a <|endoftext|>", "é́ ﬁ Σς İ", "a" * 9000, "word " * 5000, "  x", "'s't 12345 !?!", "🙂🙃 \x00\x1c", "ab " * 3 + "\r\n\t", "same text", "same text"]


def odd(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, fp int, piece string")


def test_html_keeps_the_article():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- <p>no</p> -->"
        "<div class='cookie-notice'>We use cookies</div><div class=ad>Buy now</div><main><article><h1>Title &amp; more</h1><p>First   line<br>goes on <a href=x>here</a>.<p>Second &lt;b&gt; &#233;"
        "<form><input><label>Mail</label></form><ul><li>One</li><li>Two</li></ul><section class='comments'><p>Great post!</p></section></article></main><aside>Links</aside><footer>(c) me</footer></body></html>"
    )
    assert op1_html.main_text(page, op1_html.train()) == "Title & more\n\nFirst line goes on here.\n\nSecond <b> é\n\nOne\n\nTwo"


LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='layout has-sidebar'><article><h1>T</h1><p>{LONG}</p></article></div>", ["T", LONG]),
        (f"<div class='no-sidebar'><main><p>{LONG}</p></main></div>", [LONG]),
        (f"<div class='page with-header'><p>{LONG}</p></div>", [LONG]),
        (f"<div class='search-results'><main><h1>T</h1><p>{LONG}</p></main></div><div class=sidebar><p>other</p></div>", ["T", LONG]),
        (f"<form id=aspnetForm><div class=menu><a>Home</a></div><article><h1>T</h1><p>{LONG}</p></article></form>", ["T", LONG]),
        (f"<article><header><h1>T</h1><p>A standfirst of the text</p></header><p>{LONG}</p><figure><figcaption>What it shows</figcaption></figure></article>", ["T", "A standfirst of the text", LONG, "What it shows"]),
        (f"<article><p>{LONG}</p><nav><a>Next page</a></nav><p><a>All of this is one link</a></p><div class=related-posts><a>More</a></div></article>", [LONG, "All of this is one link"]),
        (f"<div><a href=/>Home</a></div><div><a><div>Also a link</div></a></div><h1>A title here</h1><p>{LONG}</p><div><a>One</a></div><div><a>Two</a></div>", ["A title here", LONG]),
        (f"<article><p title=don't>{LONG}</p><p title='a > b'>x</p></article>", [LONG, "x"]),
        (f"<main><p>{LONG}</p><section id=comments><article><p>{LONG}</p></article></section></main>", [LONG]),
    ],
)
def test_html_by_structure(page, want):
    assert op1_html.main_text(page, op1_html.train()).split("\n\n") == want


def test_html_labelled_pages_are_learnt():
    tree, wrong = op1_html.train(), 0
    for *x, label in op1_html.labelled():
        node = tree
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        wrong += node != label
    assert wrong == 0


@pytest.mark.parametrize("bad", ["<a ", "<p class='", "<p x=\"y' ", "<div>", "</p></i", "<!--", "<script>", "<", "<td><tr>", "&"])
def test_html_time_is_proportional(bad):
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        op1_html.main_text(bad * n + '"', op1_html.train())
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.1)


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a" * 1000, "<p>" * 20_000])
def test_html_odd_pages(page):
    assert "<" not in op1_html.main_text(page, op1_html.train()) or page == "<"


def test_html_frame(spark):
    rows = [(1, "u", None, 5), (None, None, "<article><p>x y z</p></article>", 6), (1, "u", None, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in op1_html.extract_main_text(pages).collect()) == [("", 0), ("", 0), ("x y z", 5)]
    assert op1_html.extract_main_text(pages.filter("false")).count() == 0


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, bits):
    ids = sorted(prints)
    up = {i: i for i in ids}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(prints, 4)
    found = op2_simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == want


@pytest.mark.parametrize(("bits", "key"), [(4, 3), (6, 2), (7, 1)])
def test_simhash_index_misses_no_pair(spark, bits, key):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {}
    for i in range(1500):
        x = base[i % 30] if i < 300 else base[0]  # one group longer than a block
        for b in rng.sample(range(64), rng.randrange(0, bits + 1)):
            x ^= 1 << b
        prints.setdefault(x, i)
    want = brute_components({i: x for x, i in prints.items()}, bits)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for x, i in prints.items()]
    from lexmill.operators.graph import connected_components

    links = op2_simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, doc_id long"), bits, key)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_odd_rows(spark):
    found = op2_simhash.near_duplicates(odd(spark)).collect()
    assert len(found) == len(ODD)
    zero = {r["doc_id"] for r in found if r["fingerprint"] == "0" * 16}
    assert zero == {0, 1, 2} and {r["component_id"] for r in found if r["doc_id"] in zero} == {0}
    assert op2_simhash.near_duplicates(odd(spark).filter("false")).count() == 0
    kept = op2_simhash.drop_near_duplicates(odd(spark))
    assert kept.columns == ["doc_id", "text", "fp", "piece"] and kept.filter("text = 'same text'").count() == 1


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(
    ("name", "label", "folder", "least", "least_f1"),  # at sf0.01 eight toxic documents are held out, too few to tell; 86 are at sf0.1
    [("op3_quality_classifier", "quality", SF2, 0.95, 0.95), ("op8_toxicity_scores", "toxic", "/root/testdata/sf0.1", 0.85, 0.65)],
)
def test_held_out_accuracy(spark, name, label, folder, least, least_f1):
    found = queries.QUERIES[name](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").toPandas()
    y, said = found[label].to_numpy(), found.predicted.to_numpy()
    assert found.score.between(0, 1).all()
    assert auc(found.score.to_numpy(), y) >= least
    assert 2 * (y * said).sum() / (y.sum() + said.sum()) >= least_f1


@pytest.mark.parametrize(("score", "label"), [(op3_quality.quality_scores, "quality"), (op8_toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, score, label):
    labels = spark.createDataFrame([(i, i % 2, "en") for i in range(12)] + [(1, None, "en"), (None, 1, "en"), (2, 7, "en")], f"doc_id long, {label} int, text string")
    for given_labels in (labels, labels.filter("false")):
        found = score(odd(spark), given_labels).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    assert score(odd(spark).filter("false"), labels).count() == 0


def test_quality_filter_keeps_columns(spark):
    docs = table(spark, SF2, "documents").selectExpr("*", "1 as score", "2 as label")
    kept = op3_quality.keep_good(docs, table(spark, SF2, "labels"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_is_whole_gapless_and_tight(spark):
    docs = table(spark, SF2, "documents").selectExpr("doc_id", "text").unionByName(odd(spark).filter("doc_id is not null").selectExpr("doc_id + 1000000 as doc_id", "text"))
    pieces = op5_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    lib, by, total = library("word_bpe_49k.json"), {}, 0
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[d["doc_id"]]) == want
    at: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) <= 1.01 * total / 2048 + 1


def test_packed_sequences_hold_the_ids(spark):
    docs = odd(spark).filter("doc_id is not null").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    placed = op5_packing.pack_documents(docs, path)
    assert sum(len(r["ids"]) for r in op5_packing.assemble(docs, placed, path).collect()) == placed.groupBy().sum("length").first()[0]
    assert op5_packing.pack_documents(docs.filter("false"), path).count() == 0


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 20)), max_size=12), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 9)), max_size=8))
@settings(deadline=None, max_examples=100)
def test_sweep_matches_each_piece_with_its_successor(pieces, gaps):
    pieces = [(i, s, 0, n) for i, (s, n) in enumerate(pieces)]
    slots = [(g, 1000 * i, n) for i, (g, n) in enumerate(gaps)]
    left, after, matches = op5_packing.sweep(pieces, slots, 30)
    room = {i + k: g for g, i, n in slots for k in range(n)}
    # piece by piece: the smallest gap of before the round that is not shorter and not taken by other pieces
    free, want = sorted(room.values()), {}
    for home, s, _, n in sorted(pieces, key=lambda p: (-p[1], p[0])):
        while n and (fit := [g for g in free if g >= s]):
            free.remove(min(fit))
            take = min(n, min(fit) // s)
            want[home] = want.get(home, 0) + take
            n -= take
    got: dict[int, int] = {}
    used = dict.fromkeys(room, 0)
    for home, s, first, n, slot, per, at in matches:
        assert first == got.get(home, 0) and n % per == 0
        got[home] = first + n
        for k in range(n // per):
            assert at == 30 - room[slot + k] and not used[slot + k]
            used[slot + k] = per * s
    assert got == want and {h: n for h, _, _, n in left} == {h: n - want.get(h, 0) for h, _, _, n in pieces if n > want.get(h, 0)}
    assert sorted(g - used[i] for i, g in room.items() if g > used[i]) == sorted(g for g, _, n in after for _ in range(n))


def test_packing_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(op5_packing, "PART_PIECES", 40)
    rng = random.Random(4)
    sizes = [rng.choice([2048, rng.randrange(1, 2048), rng.randrange(1, 200), 700]) for _ in range(1500)] + [3] * 500
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], op5_packing.PIECE)
    found = op5_packing.place_pieces(pieces).collect()
    assert sorted((r["doc_id"], r["length"]) for r in found) == list(enumerate(sizes))
    at: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    gaps: list[int] = []  # best fit piece by piece, longest first
    for n in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 2048) - n)
    assert max(at.values()) <= 2048 and len(at) <= 1.03 * len(gaps)


def test_word_ids_of_all_characters():
    lib, codec = library("word_bpe_49k.json"), bpe.codec(bpe.WordCodec, public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"x{chr(i)}1 {chr(i)} a" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    ids = [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 20_000) for e in lib.encode_batch(texts[at : at + 20_000], add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, ids, [x for at in range(0, len(texts), 500) for x in codec.encode(texts[at : at + 500])], strict=True) if a != b] == []


@given(st.text(max_size=60))
@settings(deadline=None, max_examples=150)
def test_bpe_as_the_library(text):
    lib, codec = library_byte, bpe.codec(bpe.TextCodec, public_tokenizers.path("byte_bpe_50k.json"))
    ids = lib.encode(text, add_special_tokens=False).ids
    assert codec.encode([text]) == [(",".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]


library_byte = library("byte_bpe_50k.json")


def test_bpe_digests(spark):
    docs = table(spark, SF, "documents").selectExpr("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id + 1000000 as doc_id", "text"))
    found = {r["doc_id"]: r for r in op10_bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for d in docs.filter("doc_id is not null").collect():
        ids = library_byte.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library_byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert op10_bpe.encode_documents(docs.filter("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    from lexmill.plans.storage import materialize

    docs = table(spark, SF2, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF2))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    placed = p.STAGES[-1][1](spark, docs, SF2)
    assert placed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert docs.groupBy("text").count().filter("count > 1").count() == 0


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def brute_similar(texts):
    """doc_id -> smallest doc_id reachable through pairs of Jaccard similarity 0.8 or more, and the pairs."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    up, pairs = {i: i for i in sets}, []
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sorted(sets):
        for b in sets:
            if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))):
                pairs.append((a, b))
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, pairs


def test_pipeline_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = {i: " ".join(word() for _ in range(300)) for i in range(40)}
    for i in range(40, 300):  # no exact copies: similarities of some 0.6 to 0.97
        w = texts[i % 40].split()
        for at in rng.sample(range(300), rng.randrange(1, 16)):
            w[at] = word()
        texts[i] = " ".join(w)
    want, pairs = brute_similar(texts)
    far = [(a, b) for a, b in pairs if (op2_simhash.fingerprint(texts[a], 5) ^ op2_simhash.fingerprint(texts[b], 5)).bit_count() > 6]
    assert len(far) > 50  # beyond what 6 bits of a SimHash reach
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in op2_simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_pipeline_near_duplicates_of_documents(spark):
    docs = table(spark, SF2, "documents")
    want, _ = brute_similar({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in op2_simhash.similar_texts(docs).collect()} == want


def test_pipeline_near_duplicates_go_by_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 7), (5, a, 8), (5, b, 9), (7, "x", 1), (7, "x", 1), (None, b, 2), (None, "y", 3), (9, None, 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumnRenamed("row", "part")
    kept = op2_simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a, 7), (5, b, 9), (7, "x", 1), (None, "y", 3), (8, "", 5)]))


def test_pipeline_rules_remove_lines(spark):
    from lexmill.llm import op6_quality_rules

    words = lambda i: " ".join(f"w{i}_{k}" for k in range(40))
    rows = [(i, f"Shared  BANNER of the site\n\n{words(i)}\n shared banner of THE site", "h", 1) for i in range(200)] + [(900, f"shared banner of the site\n{words(900)}", "other", 2), (901, "shared banner of the site " * 3 + "end", "h", 3), (902, None, "h", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").withColumn("removed_lines", F.lit(0))
    found = op6_quality_rules.keep_by_rules(docs)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(i, f"\n{words(i)}") for i in range(200)] + [(900, rows[200][1])]


@pytest.mark.parametrize(("fit", "label", "share"), [(op3_quality.fit, "quality", 0.9), (op8_toxicity.fit, "toxic", 0.1)])
def test_scores_keep_the_class_shares_under_a_cap(spark, fit, label, share):
    rng = random.Random(5)  # texts that tell nothing of their label: the mean score is the share of the label
    rows = [(i, " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=40)), int(rng.random() < share)) for i in range(4000)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {label} int")
    model = fit(frame.select("doc_id", "text"), frame.select("doc_id", label), rows=500)
    texts = [t for _, t, _ in rows[:500]]
    scores = model.score(texts, op3_quality.WordIds(model.vocabulary)) if label == "quality" else model.score(texts)
    assert abs(scores.mean() - share) < 0.08


def test_toxicity_learns_every_marking_word():
    rng = random.Random(6)
    marks = [f"zq{i}x" for i in range(250)] + ["qx"]
    plain = lambda: rng.choices([f"w{i}" for i in range(50)], k=60)
    toxic = [" ".join(plain() + [marks[(i * 9 + k) % 251] for k in range(9)]) for i in range(800)]
    sample = [(t, 1) for t in toxic] + [(" ".join(plain()), 0) for _ in range(2400)]
    assert op8_toxicity.marking_words(toxic, [t for t, y in sample if not y]) == {m.encode() for m in marks}
    model = op8_toxicity.ToxicityModel(sample)
    scores = model.score([" ".join(plain() + [marks[(i * 5 + k) % 251] for k in range(5)]) for i in range(251)] + [" ".join(plain()) for _ in range(251)])
    assert auc(scores, np.array([1] * 251 + [0] * 251)) > 0.95


def test_labelled_sample_takes_whole_texts_up_to_its_bound(spark):
    from lexmill.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (100_000 if i == 3 else 10)) for i in range(40)] + [(5, "x"), (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(60, 1), (None, 1)], "doc_id long, quality int")
    whole, shift = labelled_sample(docs, labels, "quality", 100, labels.doc_id >= 0)
    assert len(whole) == 40 and shift == 0 and max(len(t) for t, _ in whole) == 100_000 and min(len(t) for t, _ in whole) == 1
    some, _ = labelled_sample(docs, labels, "quality", 100, labels.doc_id >= 0, chars=200)
    assert sum(len(t) for t, y in some if y == 0) == 100 and sum(len(t) for t, y in some) <= 200


def test_pipeline_near_duplicates_begin_with_simhash(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{i}" for i in range(400)]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    # without any candidate of the min-wise fingerprints the near pair comes from the index over SimHash bytes
    monkeypatch.setattr(op2_simhash, "_candidates", lambda spanning: lambda batches: (b.select(["key", "i", "j", "sid"] if not spanning else ["key", "sid"]).rename_columns(["key", "i", "j", "sid"] if not spanning else ["src", "dst"]).slice(0, 0) for b in batches))
    assert {r["doc_id"]: r["component_id"] for r in op2_simhash.similar_texts(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_a_worker_keeps_the_tables_of_one_operator():
    import gc
    import weakref

    model = op3_quality.QualityModel([("a good text " * k, k % 2) for k in range(1, 40)])
    words = weakref.ref(bpe.codec(bpe.WordCodec, public_tokenizers.path("word_bpe_49k.json")))
    rows = weakref.ref(op3_quality.rows_of(model))
    gc.collect()
    assert words() is None and rows() is op3_quality.rows_of(model)
    bpe.codec(bpe.WordCodec, public_tokenizers.path("word_bpe_49k.json"))
    gc.collect()
    assert rows() is None


def test_the_words_of_a_worker_stay_bounded_and_those_in_use_stay():
    path = public_tokenizers.path("word_bpe_49k.json")
    small, whole = bpe.WordCodec(path, keep=400), bpe.WordCodec(path)
    for k in range(12):
        texts = ["the income tax, " + " ".join(f"w{k}x{i}" for i in range(40)), "the <|endoftext|> tax", "Σ The"]
        assert small.encode(texts) == whole.encode(texts)
        assert "income" in small.words and "tax," in small.words  # met in every batch, so never learnt anew
        assert not small.words.keys() & small.before.keys()
    assert small.before and len(small.words) + len(small.before) < len(whole.words)


def test_slices_do_not_hold_their_batch():
    import pyarrow as pa

    from lexmill.llm import batches

    def stream():
        yield pa.record_batch({"doc_id": list(range(1000)), "text": ["x" * 100] * 1000})

    before, seen, last = pa.total_allocated_bytes(), [], None
    for last in batches.slices(stream()):
        seen += last.column("doc_id").to_pylist()
    assert seen == list(range(1000)) and last.num_rows == 232
    assert pa.total_allocated_bytes() - before < 60_000  # the last part's rows, not all 1,000
