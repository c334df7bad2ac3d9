"""SimHash near-duplicates through an inverted index over byte positions of the fingerprints.

Two fingerprints of 64 bits that differ in at most d bits agree in at least 8 - d of their 8 byte positions: the
guaranteed number of matches. The index is keyed by `key_bytes` positions at once, over a set of positions such that
any 8 - d shared ones contain a key; so no pair is missed, and a posting list holds a 2^-24 share of unrelated
fingerprints rather than a 2^-8 one. Within a posting list the shared positional bytes of each pair are tallied, pairs
that reach the guarantee are the candidates (the key's own bytes are one short of it), and these are verified bit by bit.

Lists are sorted runs of Spark partitions. A long list (one huge group of near copies) is cut into blocks, each pair
of blocks being a task's work of bounded size; what leaves a block is a spanning forest of its links, never its
pairs. Equal fingerprints are one row with the smallest doc_id before any of this.

The pipeline's stage removes texts of a shingle similarity of 0.8 or more. Such pairs differ in some 10 of 64 sign
bits, which no index of byte positions reaches; similar_texts therefore takes the candidates of the index and searches
by min-wise fingerprints, 16 a text, for the others. Each candidate is verified on the whole shingle sets.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import forest, slices, sorted_groups
from lexmill.operators.graph import connected_components
from lexmill.plans.storage import join_checked, materialize

#: Fingerprints of one posting list that are compared in one block; longer lists are dealt out by pairs of blocks.
BLOCK = 1024


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer; 0 for a text without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        line = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[: -words].tolist()]
        shingles = [line[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    return sign_bits(np.fromiter(map(_hash, shingles), np.uint64, len(shingles)))


def sign_bits(h: np.ndarray) -> int:
    """The SimHash of shingle hashes: a bit is 1 if over half of them have it; 0 for none."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        set_in += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.int64)[0])


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of docs; a narrow map over whole texts."""

    def run(batches):
        for b in slices(batches):
            found = [fingerprint(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def key_positions(matches: int, key_bytes: int) -> list[tuple[int, ...]]:
    """Sets of `key_bytes` byte positions of 8 such that any `matches` positions contain one of them.

    For keys one shorter than the guarantee, three cyclic classes of positions need far fewer keys than all.
    """
    if matches == 4 and key_bytes == 3:
        part = [0, 0, 0, 1, 1, 1, 2, 2]
        wanted = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
        return [c for c in combinations(range(8), 3) if tuple(sorted(part[i] for i in c)) in wanted]
    return list(combinations(range(8), key_bytes))


def _links(max_distance: int):
    least = 8 - max_distance

    def to_numpy(_, column):
        return column.to_numpy(zero_copy_only=False)

    def close(x: np.ndarray) -> np.ndarray:
        """Of differences x: tally the equal positional bytes; only candidates with enough of them have their bits verified."""
        tally = (np.ascontiguousarray(x)[..., None].view(np.uint8) == 0).sum(axis=-1)
        found = tally >= least
        found[found] = np.bitwise_count(x[found]) <= max_distance
        return found

    def run(batches):
        for rows, starts in sorted_groups(batches, ["slot", "key", "i", "j"], ["fp", "doc_id"], to_numpy):
            fp, ids = rows["fp"].view(np.uint64), rows["doc_id"]
            size = np.diff([*starts, len(fp)])
            group = np.repeat(np.arange(len(starts)), size)
            a, b = [], []
            small = np.repeat(size <= 16, size)
            for d in range(1, 16):
                if len(fp) <= d:
                    break
                at = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
                at = at[close(fp[at] ^ fp[at + d])]
                a.append(ids[at])
                b.append(ids[at + d])
            for s, n in zip(starts[size > 16], size[size > 16], strict=True):
                own = fp[s : s + n]
                x = np.zeros((n, n), bool)
                for r in range(0, n, 256):
                    x[r : r + 256] = close(own[r : r + 256, None] ^ own[None, :])
                root = forest(x)
                at = np.flatnonzero(root != np.arange(n))
                a.append(ids[s + at])
                b.append(ids[s + root[at]])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["src", "dst"])

    return run


def fingerprint_links(prints: DataFrame, max_distance: int = 4, key_bytes: int = 3) -> DataFrame:
    """(src, dst): links that span each group of fingerprints at most max_distance bits apart.

    prints has (fp, doc_id) with distinct fp. max_distance is at most 7 and key_bytes at most 8 - max_distance. Each
    fingerprint is posted once a key (20 for the defaults), so the shuffle grows with the input; comparisons within
    lists grow with its square over 2^(8 key_bytes), which a longer key divides by 256 for a corpus that needs it.
    """
    assert 0 <= max_distance <= 7 and 1 <= key_bytes <= 8 - max_distance
    masks = [sum(0xFF << (8 * p) for p in c) for c in key_positions(8 - max_distance, key_bytes)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    posts = prints.select(
        "fp", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("p")
    ).select("p.slot", "p.key", "fp", "doc_id")
    long = posts.groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    long = long.select("slot", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = join_checked(posts, long, ["slot", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (
        dealt.select("slot", "key", "fp", "doc_id", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        .select("slot", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "doc_id")
        .repartition("slot", "key", "i", "j")
        .sortWithinPartitions("slot", "key", "i", "j")
    )
    return dealt.mapInArrow(_links(max_distance), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4, key_bytes: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id reachable through links (fingerprints at most max_distance bits apart),
    the document itself included. Null, empty and blank texts have fingerprint zero and are linked with each other
    like any equal fingerprints. Repeated rows give repeated results; a row with null doc_id gets the component of
    its fingerprint and lends it nothing. Other columns are not read; an empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    parts = connected_components(fingerprint_links(distinct.filter("doc_id is not null"), max_distance, key_bytes))
    of_print = distinct.join(parts, distinct.doc_id == parts.node, "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands and minima a band of the min-wise fingerprints, and the estimate below which a candidate is not verified.
BANDS, ROWS, LEAST_ESTIMATE = 16, 4, 0.55
_TWIST = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, cut as in fingerprint()."""
    w = (text or "").encode().lower().split()
    return np.unique(np.fromiter((_hash(b" ".join(w[i : i + words])) for i in range(max(len(w) - words, 0) + 1 if w else 0)), np.uint64))


def _set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def _sketches(words: int):
    """(doc, sid, n, keys, sketch, fp): a number for the set, its size, the min-wise fingerprint of each band, a byte of each
    minimum, and the SimHash of the set."""

    def one(text):
        h = shingle_hashes(text, words)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for at in range(0, len(h), 4096):
            low = np.minimum(low, ((h[None, at : at + 4096] ^ _TWIST[0]) * _TWIST[1]).min(axis=1))
        keys = [xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
        return _set_id(h), len(h), np.array(keys, np.uint64).view(np.int64).tolist(), (low >> np.uint64(24)).astype(np.uint8).tobytes(), sign_bits(h)

    def run(batches):
        for b in slices(batches):
            found = [one(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *cols], ["doc", "sid", "n", "keys", "sketch", "fp"])

    return run


def _shingle_sets(words: int):
    def run(batches):
        for b in slices(batches, 64):
            sets = [shingle_hashes(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["sid", "shingles"])

    return run


def _tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges of `near` that span its components."""
    seen, a, b = np.zeros(len(near), bool), [], []
    for seed in range(len(near)):
        todo = [] if seen[seed] else [seed]
        seen[seed] = True
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & ~seen)
            seen[found] = True
            todo += found.tolist()
            a += [at] * len(found)
            b += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _candidates(spanning: bool):
    """Within a bucket, pairs of different labels whose sizes and sketches allow for a similarity of 0.8: as many
    (src, dst) as span them, or else the texts (key, i, j, sid) that are in any."""
    least = int(LEAST_ESTIMATE * BANDS * ROWS)

    def to_numpy(name, column):
        if name == "sketch":
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        return column.to_numpy(zero_copy_only=False)

    def run(batches):
        for rows, starts in sorted_groups(batches, ["key", "i", "j"], ["sid", "label", "n", "sketch"], to_numpy):
            for s, e in zip(starts, [*starts[1:], len(rows["sid"])], strict=True):
                sid, label, n, sketch = (rows[c][s:e] for c in ("sid", "label", "n", "sketch"))
                if e - s < 2 or (label == label[0]).all():
                    continue
                near = np.zeros((e - s, e - s), bool)
                for r in range(0, e - s, 64):
                    m = n[r : r + 64, None].astype(np.int64)
                    near[r : r + 64] = (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (label[r : r + 64, None] != label)
                    near[r : r + 64] &= (sketch[r : r + 64, None] == sketch).sum(axis=2) >= least
                if spanning:
                    x, y = _tree(near)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[x], sid[y])), pa.array(np.maximum(sid[x], sid[y]))], ["src", "dst"])
                else:
                    at = s + np.flatnonzero(near.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[c][at]) for c in ("key", "i", "j", "sid")], ["key", "i", "j", "sid"])

    return run


def _shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share; only elements of two sets or more are looked at."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, (first, first + columns))
        x = np.zeros((len(sets), columns), np.float32)
        x[row[a:b], number[a:b] - first] = 1
        out += x @ x.T
    return out


def _exact_links():
    """(src, dst) that span, within a bucket, the pairs of different labels with a similarity of 0.8 or more."""

    def to_numpy(name, column):
        if name == "shingles":
            out = np.empty(len(column), object)
            for i, x in enumerate(column):
                out[i] = x.values.to_numpy(zero_copy_only=False)
            return out
        return column.to_numpy(zero_copy_only=False)

    def run(batches):
        for rows, starts in sorted_groups((part for b in batches for part in slices([b], 512)), ["key", "i", "j"], ["sid", "label", "shingles"], to_numpy):
            for s, e in zip(starts, [*starts[1:], len(rows["sid"])], strict=True):
                sid, label, sets = (rows[c][s:e] for c in ("sid", "label", "shingles"))
                n = np.array([len(x) for x in sets], np.int64)
                x, y = _tree((9 * _shared(list(sets)) >= 4 * (n[:, None] + n)) & (label[:, None] != label))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[x], sid[y])), pa.array(np.maximum(sid[x], sid[y]))], ["src", "dst"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 or more, exactly: 9 |A and B| >= 4 (|A| + |B|)."""
    both = pairs.distinct().join(sets.select(F.col("sid").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("sid").alias("dst"), F.col("shingles").alias("b")), "dst")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("src", "dst")


def simhash_pairs(sets: DataFrame, max_distance: int = 4) -> DataFrame:
    """(src, dst), src < dst: candidates among sets (sid, fp) from the index over byte positions. They span the groups of
    fingerprints at most max_distance bits apart, and join sets of one fingerprint to the least of them."""
    prints = materialize(sets.groupBy("fp").agg(F.min("sid").alias("doc_id")))
    equal = sets.join(prints, "fp").filter(F.col("sid") != F.col("doc_id")).select(F.col("doc_id").alias("src"), F.col("sid").alias("dst"))
    near = fingerprint_links(prints, max_distance)
    return near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).unionByName(equal)


def similar_texts(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, component_id) of each row of docs with a doc_id. Linked are texts whose sets of word shingles have a
    Jaccard similarity of 0.8 or more; component_id is the smallest doc_id reachable.

    SimHash fingerprints within 4 bits, found by the index over byte positions, are the first candidates; several min-wise
    fingerprints a text search for those beyond its reach. Each link is verified on the whole sets. A pair
    at 0.8 shares none of the 16 fingerprints with a chance of (1 - 0.8^4)^16 = 0.0002, one at 0.85 of 0.00001. Equal
    sets are one row. The first round verifies pairs that span the candidates of each bucket. In the second the sets
    of texts with candidates that the first has not brought together come to the buckets, where all such pairs are
    counted in blocks; what leaves a block spans its links. So no round writes the pairs of a group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null")
    rows = materialize(texts.mapInArrow(_sketches(words), "doc long, sid long, n int, keys array<long>, sketch binary, fp long"))
    distinct = materialize(rows.groupBy("sid").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "keys", "sketch", "fp")]))
    posts = distinct.select("sid", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    posts = join_checked(posts, shared, "key").select("key", "sid", own.alias("own"), other.alias("other"))
    posts = materialize(posts.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid").join(distinct.select("sid", "n", "sketch"), "sid"))

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    pairs = dealt(posts.withColumn("label", F.col("sid"))).mapInArrow(_candidates(True), "src long, dst long")
    pairs = materialize(pairs.unionByName(simhash_pairs(distinct)).distinct())
    ends = pairs.select(F.col("src").alias("sid")).unionByName(pairs.select(F.col("dst").alias("sid"))).distinct()
    wanted = distinct.join(ends, "sid").select("doc").distinct()
    sets = materialize(join_checked(texts, wanted, "doc").mapInArrow(_shingle_sets(words), "sid long, shingles array<long>").dropDuplicates(["sid"]))
    links = materialize(_similar(pairs, sets))
    parts = connected_components(links)
    labelled = posts.join(parts.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_ = materialize(dealt(labelled).mapInArrow(_candidates(False), "key long, i int, j int, sid long"))
    names = sets.join(parts, sets.sid == parts.node, "left").select("sid", F.coalesce("component", "sid").alias("label"), "shingles")
    more = materialize(dealt(open_.join(names, "sid")).select("key", "i", "j", "sid", "label", "shingles").mapInArrow(_exact_links(), "src long, dst long").distinct())
    parts = connected_components(links.unionByName(more))
    named = materialize(distinct.join(parts, distinct.sid == parts.node, "left").select("sid", "doc", F.coalesce("component", "sid").alias("part")))
    first = named.groupBy("part").agg(F.min("doc").alias("component_id"))
    return rows.select("doc", "sid").join(named.join(first, "part").select("sid", "component_id"), "sid").select(F.col("doc").alias("doc_id"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The first row of each group of near-duplicates: of the rows whose texts similar_texts links, that with the smallest
    doc_id, null last, and of rows with the same doc_id the first as read. All columns stay.

    Rows are judged one by one: a row that shares its doc_id with others goes or stays by its own text, and of repeated
    rows one stays. Null and empty texts are near-duplicates of each other. An empty table gives an empty one; columns
    of docs may have any names but `_row`.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    parts = similar_texts(rows.select(F.col("_row").alias("doc_id"), "text"), words).select(F.col("doc_id").alias("row"), F.col("component_id").alias("part"))
    named = materialize(parts.join(rows.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc")), "row"))
    kept = named.groupBy("part").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("least"))
    gone = named.join(kept, "part").filter("row != least.row").select(F.col("row").alias("_row"))
    return join_checked(rows, gone, "_row", "left_anti").select(*docs.columns)
