"""Alignment of the tokens of two tokenizers by the places where tokens end.

Each byte of a text has a label: no token ends there, one of A, one of B, or both. A regular expression cuts the string
of labels into spans that each end in a byte labelled both; a span is a group, and its labels count the tokens of
either side. Within a group the labelled bytes are walked once: between two of them lies exactly one overlap of an A
token with a B token, which is a link.

A text is cut into segments, each a run of spaces and what follows up to the next space after a character that isn't
white space. No token of either vocabulary goes across such a cut, so both sides end there and the alignment of a text
is that of its segments. Segments repeat, so their alignment is kept per worker, within a bound on their characters.

How often a pair of ids is linked in the whole corpus is asked for by every document. Tasks put documents into blocks
of BLOCK_CHARS and keep, in one row of a written table, the distinct pairs of the block with their counts and, for each
document, the places of its pairs in that list. What is shuffled is one row for each block and distinct pair, not for
each link: the counts are summed, joined back to the blocks' pairs, and gathered for each block, where each document
adds up those of its links. Sums are by pair and partial; in the join a pair that all blocks hold is split by adaptive
execution.
"""

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import slices
from lexmill.llm.bpe import _byte_chars
from lexmill.plans.storage import materialize

#: Characters of text in a block, unless one text alone is longer.
BLOCK_CHARS = 8_000_000
#: Characters of the segments whose alignment a worker keeps, and the longest such segment.
KEEP_CHARS, KEEP_LENGTH = 5_000_000, 200

END_A, END_B, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: A cut is before a space, after a character that neither library may take for white space.
_WHITE = "\\s\u180e\u200b-\u200f\u2060\ufeff"
SEGMENT = re.compile(f"[ ]+[^ ]*(?:(?<=[{_WHITE}])[ ]+[^ ]*)*")
_ENDS_WHITE = re.compile(f"[{_WHITE}]\\Z")


class Alignment(NamedTuple):
    """Of a segment: its groups as text, its linked pairs of ids (a << 32 | b) as bytes, and counts."""

    groups: str
    pairs: bytes
    n_a: int
    n_b: int
    n_groups: int


def align(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group sizes (tokens of A, tokens of B) and links (place of the A token, place of the B token), in order.

    a_ends and b_ends are the byte offsets after each token; both end in `size`.
    """
    label = np.zeros(size, np.uint8)
    label[a_ends - 1] |= END_A
    label[b_ends - 1] |= END_B
    first = np.cumsum([0, *map(len, SPAN.findall(label.tobytes()))])[:-1]
    n_a, n_b = (np.add.reduceat((label & end) // end, first, dtype=np.int64) for end in (END_A, END_B))
    marks = label[label > 0]  # between two labelled bytes lies one overlap of an A token with a B token
    of_a, of_b = marks & END_A, marks // END_B
    return n_a, n_b, np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b


class Aligner:
    """Aligns whole texts under a byte-level tokenizers file (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t if c in byte_of)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.b_space = [self.b.piece_to_id("\u2581")]
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        # how an id is written before a further one of its side, and at the end of its side of a group
        self.written = [f"{i}{mark}" for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(side))]
        self.kept: dict[str, Alignment | None] = {}
        self.kept_chars = 0

    def _ids(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of a text that begins with a space, under A and B, and whether the tokens of both give it back."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1) or self.b_space  # B adds the first space itself, but not to nothing
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == text.encode() == b"".join(map(self.b_bytes.__getitem__, b))

    def _align(self, segments: list[str]) -> list[Alignment | None]:
        """The alignments of segments that can stand one after the other, all from one string of labels."""
        text = "".join(segments)
        a, b, whole = self._ids(text)
        if not whole:
            return [None] if len(segments) == 1 else [self._align([s])[0] for s in segments]
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.lengths[0][a_ids]), np.cumsum(self.lengths[1][b_ids])
        n_a, n_b, link_a, link_b = align(int(a_ends[-1]), a_ends, b_ends)
        pairs = (a_ids[link_a] << 32 | b_ids[link_b]).tobytes()
        # tokens in the order in which groups are written: those of A, then those of B
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        size_a, size_b = map(len, self.lengths)
        a_ids[upto_a - 1] += size_a
        b_ids[upto_b - 1] += size_b
        words = np.empty(len(a_ids) + len(b_ids), np.int64)
        words[np.arange(len(a_ids)) + np.repeat(upto_b - n_b, n_a)] = a_ids
        words[np.arange(len(b_ids)) + np.repeat(upto_a, n_b)] = b_ids + 2 * size_a
        said = list(map(self.written.__getitem__, words.tolist()))
        # where each segment ends: in tokens of A and B, in groups and in links
        ends = np.cumsum([len(s.encode()) for s in segments])
        by_group = np.searchsorted(a_ends[upto_a - 1], ends) + 1
        by_link = np.searchsorted(link_a, upto_a[by_group - 1])
        cuts = zip(upto_a[by_group - 1].tolist(), upto_b[by_group - 1].tolist(), by_group.tolist(), by_link.tolist(), strict=True)
        out, a0, b0, g0, l0 = [], 0, 0, 0, 0
        for a1, b1, g1, l1 in cuts:
            out.append(Alignment("".join(said[a0 + b0 : a1 + b1])[:-1], pairs[8 * l0 : 8 * l1], a1 - a0, b1 - b0, g1 - g0))
            a0, b0, g0, l0 = a1, b1, g1, l1
        return out

    def __call__(self, texts: list[str]) -> list[list[Alignment]]:
        """For each text the alignments of its segments in order; none for a text that has no tokens."""
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        if self.kept_chars > KEEP_CHARS:
            self.kept.clear()
            self.kept_chars = 0
        known, long = self.kept, {}
        new = list(set().union(*cut).difference(known))
        alone = [s for s in new if _ENDS_WHITE.search(s)]  # what follows these would be read otherwise
        joined = list(set(new).difference(alone))
        parts = [[s] for s in alone] + [joined[at : at + 2000] for at in range(0, len(joined), 2000)]
        for part in parts:
            for s, found in zip(part, self._align(part), strict=True):
                if len(s) <= KEEP_LENGTH:
                    known[s] = found
                    self.kept_chars += len(s)
                else:
                    long[s] = found
        out = []
        for segments in cut:
            found = [long[s] if s in long else known[s] for s in segments] if long else list(map(known.__getitem__, segments))
            out.append([] if None in found else found)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process, kept between tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups): for each row of docs its groups in order, as array<struct<a: array<int>, b: array<int>>>.

    A narrow map. Null and empty texts, and those whose tokens don't give back a space and the text (B reads U+2581 as
    a space), have no groups. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    schema = "doc_id long, groups array<struct<a:array<int>,b:array<int>>>"
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        ids = lambda x: [int(i) for i in x.split(",")]
        for batch in slices(batches):
            found = aligner(a_path, b_path)([t or "" for t in batch.column("text").to_pylist()])
            groups = [[dict(zip("ab", map(ids, g.split("|")), strict=True)) for s in segments for g in s.groups.split(";")] for segments in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(groups, kind)], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, schema)


_BLOCK = "block long, pairs array<long>, ns array<long>, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, sizes array<int>, links binary"
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _pack(places: np.ndarray, times: np.ndarray) -> bytes:
    """Two arrays of unsigned integers, byte by byte of their places, so that equal high bytes lie together."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack([places, times]).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    both = np.ascontiguousarray(raw.reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4").reshape(2, -1)
    return both[0].astype(np.int64), both[1].astype(np.int64)


class _Block:
    """Documents of a task, up to BLOCK_CHARS, with the counts of their pairs."""

    def __init__(self, number: int):
        self.number, self.chars, self.docs, self.found = number, 0, [], []

    def add(self, doc_id: int | None, text: str, segments: list[Alignment]) -> None:
        pairs, times = np.unique(np.frombuffer(b"".join([s.pairs for s in segments]), np.int64), return_counts=True)
        groups = ";".join([s.groups for s in segments])
        counts = [sum(s.n_a for s in segments), sum(s.n_b for s in segments), sum(s.n_groups for s in segments), int(times.sum())]
        self.docs.append([doc_id, *counts, hashlib.sha256(groups.encode()).hexdigest() if groups else ""])
        self.found.append((pairs, times))
        self.chars += len(text)

    def row(self, names: list[str]) -> pa.RecordBatch:
        pairs, places = np.unique(np.concatenate([p for p, _ in self.found]), return_inverse=True)
        times = np.concatenate([n for _, n in self.found])
        ns = np.bincount(places, times, len(pairs)).astype(np.int64)
        of_docs = [list(x) for x in zip(*self.docs, strict=True)]
        row = [self.number, pairs, ns, *of_docs, [len(p) for p, _ in self.found], _pack(places, times)]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 7, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def _blocks(docs: DataFrame, a_path: str, b_path: str, block_chars: int) -> DataFrame:
    names = [c.split(" ")[0] for c in _BLOCK.split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in slices(batches, 64):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, text, segments in zip(batch.column("doc_id").to_pylist(), texts, aligner(a_path, b_path)(texts), strict=True):
                if block.docs and block.chars + len(text) > block_chars:
                    yield block.row(names)
                    number += 1
                    block = _Block(number)
                block.add(doc_id, text, segments)
        if block.docs:
            yield block.row(names)

    return _texts(docs).mapInArrow(run, _BLOCK)


def _sum_links(batches):
    """The documents of each block, with the counts of its pairs in the whole corpus added up over their links."""
    for batch in batches:
        for at in range(batch.num_rows):
            r = {c: v[0].as_py() if c == "links" else v[0].values for c, v in ((c, batch.slice(at, 1).column(c)) for c in batch.schema.names)}
            n, best = (np.zeros(0, np.int64) if r[c] is None else r[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("counts", "best"))
            places, times = _unpack(r["links"])
            ends = np.concatenate([[0], np.cumsum(r["sizes"].to_numpy(zero_copy_only=False))])
            of_best, of_all = (np.concatenate([[0], np.cumsum(x)]) for x in (times * best[places], times * n[places]))
            sums = [pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in (of_best, of_all)]
            docs = [r[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*docs, *sums, r["shas"]], [c.split(" ")[0] for c in _DOC.split(", ")])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best) of each linked pair of ids: its links in all blocks, and whether no pair of its B id has more."""
    counts = materialize(blocks.select(F.explode(F.arrays_zip("pairs", "ns")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.ns").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most, so its size is bounded by the vocabulary
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    n_best is the number of links whose pair of ids is linked as often in the corpus as any pair with the same B id (ties
    are all best), count_sum the sum of that number over the links. Null and empty texts, and texts whose tokens don't
    give back a space and the text, have no tokens: zeros and an empty digest. Repeated rows are rows of their own, and
    count each. Rows without a doc_id are kept. Texts are taken whole: one above `block_chars` is a block of its own. An
    empty table gives an empty one; other columns are not read.
    """
    blocks = materialize(_blocks(docs, a_path, b_path, block_chars))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("known"))
    known = known.select("block", F.col("known.n").alias("counts"), F.transform("known.best", lambda x: x.cast("int")).alias("best"))
    return blocks.drop("pairs", "ns").join(known, "block", "left").drop("block").mapInArrow(_sum_links, _DOC)
