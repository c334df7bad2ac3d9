"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the adjacent pairs of a piece of text, each with (rank of its merge, place); an inner
node holds the lesser of its children. The root is therefore the leftmost merge of the lowest rank. Applying it
changes three leaves (the merged pair and its two neighbours), each in a logarithmic number of nodes, until the
root says that nothing can be merged. Pieces of up to LANE symbols are worked in step, many trees in one array;
longer ones have a tree of their own, so a piece of n symbols costs n log n however long it is.
"""

import json
import unicodedata
from array import array

import numpy as np
import regex

from lexmill.llm.batches import held

LANE = 256
_NONE = np.iinfo(np.int64).max


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    at = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(at[b]) for b in range(256)]


class SegmentTreeBpe:
    """Merges of a tokenizers JSON file; encode() takes pieces of text as bytes and gives lists of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self._rank_of = None
        byte_of = {c: b for b, c in enumerate(chars)}
        cut = len(suffix)
        self.bytes = {
            i: bytes(byte_of[c] for c in (t[:-cut] if cut and t.endswith(suffix) else t)) for t, i in vocab.items() if all(c in byte_of for c in t.removesuffix(suffix))
        }

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), or -1."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        lanes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n <= 1:
                out[i] = self.last[list(p)].tolist()
            elif n > LANE:
                out[i] = self._encode_long(p)
            else:
                lanes.setdefault(1 << (n - 1).bit_length(), []).append(i)
        for width, where in lanes.items():
            step = max(1, 60_000 // width)
            for at in range(0, len(where), step):
                part = where[at : at + step]
                for i, ids in zip(part, self._encode_lane([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _encode_lane(self, pieces: list[bytes], width: int) -> list[list[int]]:
        rows = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.zeros((rows, width), np.uint8)
        raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.first[raw]
        every = np.arange(rows)
        ids[every, n - 1] = self.last[raw[every, n - 1]]
        place = np.arange(width)
        tree = np.full((rows, 2 * width), _NONE)
        rank = self._lookup(ids[:, :-1], ids[:, 1:])
        rank[place[:-1] >= (n - 1)[:, None]] = -1
        tree[:, width : 2 * width - 1] = np.where(rank < 0, _NONE, rank * width + place[:-1])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        alive = place < n[:, None]
        live = every
        while True:
            root = tree[live, 1]
            go = root != _NONE
            live, root = live[go], root[go]
            if not len(live):
                break
            at, rank = root % width, root // width
            gone = after[live, at]
            nxt = after[live, gone]
            new = self.merged[rank]
            ids[live, at] = new
            alive[live, gone] = False
            after[live, at] = nxt
            before[live, np.minimum(nxt, width)] = at
            has = nxt < n[live]
            rank = np.where(has, self._lookup(new, ids[live, np.where(has, nxt, 0)]), -1)
            tree[live, width + at] = np.where(rank < 0, _NONE, rank * width + at)
            tree[live, width + gone] = _NONE
            prev = before[live, at]
            has = prev >= 0
            prev = np.where(has, prev, at)
            rank = np.where(has, self._lookup(ids[live, prev], new), -1)
            tree[live, width + prev] = np.where(has, np.where(rank < 0, _NONE, rank * width + prev), tree[live, width + prev])
            paths = [width + at, width + gone, width + prev]
            for _ in range(width.bit_length() - 1):
                paths = [q >> 1 for q in paths]
                for q in paths:
                    tree[live, q] = np.minimum(tree[live, 2 * q], tree[live, 2 * q + 1])
        flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_long(self, piece: bytes) -> list[int]:
        if self._rank_of is None:
            self._rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, size, merged = self._rank_of, self.size, self.merged
        n = len(piece)
        ids = [*self.first[list(piece[:-1])].tolist(), int(self.last[piece[-1]])]
        width = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)

        def leaf(a: int, b: int, at: int):
            r = rank_of.get(ids[a] * size + ids[b])
            return none if r is None else (r, at)

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1, i)
        for q in range(width - 1, 0, -1):
            tree[q] = min(tree[2 * q], tree[2 * q + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)

        def put(at: int, value) -> None:
            q = width + at
            tree[q] = value
            q >>= 1
            while q:
                low = min(tree[2 * q], tree[2 * q + 1])
                if tree[q] == low:
                    break
                tree[q] = low
                q >>= 1

        while tree[1] is not none and tree[1] != none:
            r, at = tree[1]
            gone = after[at]
            nxt = after[gone]
            ids[at] = int(merged[r])
            alive[gone] = 0
            after[at] = nxt
            put(gone, none)
            if nxt < n:
                before[nxt] = at
            put(at, leaf(at, nxt, at) if nxt < n else none)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at, before[at]))
        return [ids[i] for i in range(n) if alive[i]]


#: The patterns that split a text into pieces before the merges, as published with the vocabularies.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END_OF_TEXT = "<|endoftext|>"


class TextCodec:
    """Byte-level encoding and decoding of whole texts, with the pieces seen lately kept per worker."""

    def __init__(self, path: str, keep: int = 250_000):
        self.bpe, self.split, self.keep = SegmentTreeBpe(path), regex.compile(BYTE_PIECES), keep
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def learn(self, pieces: set[str]) -> None:
        if len(self.ids) > self.keep:
            self.ids.clear()
            self.back.clear()
        new = [p for p in pieces if p not in self.ids]
        bytes_of = self.bpe.bytes
        for p, ids in zip(new, self.bpe.encode([p.encode() for p in new]), strict=True):
            self.ids[p] = ",".join(map(str, ids))
            self.back[p] = b"".join([bytes_of[i] for i in ids])
        # a piece can't hold a control string, as texts are cut at them
        for s, i in self.special.items():
            self.ids[s], self.back[s] = str(i), s.encode()

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids (decimal, joined by commas) and what they decode to."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        return [(",".join(map(self.ids.__getitem__, ps)), b"".join(map(self.back.__getitem__, ps)).decode("utf-8", "replace")) for ps in cut]


class WordCodec:
    """Ids of whole texts under the lower-casing word vocabulary, as little-endian unsigned 32-bit integers.

    White space ends every token there, so a text's ids are those of its words. Texts with control strings or
    characters on which libraries differ go to the tokenizers library itself; so do those with a word that holds a
    character that Unicode has not assigned as this Python knows it, as libraries know different versions.
    """

    ODD = ("<|", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, keep: int = 1_200_000):
        self.path, self.bpe, self.split, self.keep = path, SegmentTreeBpe(path), regex.compile(WORD_PIECES), keep
        self.words: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        self.library = None

    def _unknown(self, words: set[str]) -> set[str]:
        """The words that are not kept; those of the former generation that are met again move to this one."""
        new = words.difference(self.words)
        again = self.before.keys() & new
        self.words.update((w, self.before.pop(w)) for w in again)
        return new - again

    def learn(self, words: set[str]) -> None:
        """Keep the ids of words and of their pieces; a piece is a word whose only piece is itself.

        Two generations of half of `keep` each: when this one is full the former goes, with the words not met since.
        """
        if len(self.words) > self.keep // 2:
            self.before, self.words = self.words, {}
        known = self.words
        new = self._unknown(words)
        whole = {w for w in new if w.isalpha() and w.isascii()}
        unsure = {w for w in new if not w.isprintable() and "Cn" in map(unicodedata.category, w)}
        known.update(dict.fromkeys(unsure))
        cut = [(w, self.split.findall(w)) for w in new - whole - unsure]
        pieces = list(self._unknown(whole.union(p for _, ps in cut for p in ps)))
        known.update(zip(pieces, [array("I", x).tobytes() for x in self.bpe.encode([p.encode() for p in pieces])], strict=True))
        for w, ps in cut:
            known[w] = b"".join([known[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list = []
        for t in texts:
            if any(o in t for o in self.ODD):
                cut.append(t)
            else:
                t = t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
                cut.append(t.lower().split())
        self.learn(set().union(*(ws for ws in cut if isinstance(ws, list))))
        out = []
        for t, ws in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(self.words.__getitem__, ws)) if isinstance(ws, list) else self._by_library(ws))
            except TypeError:  # one of the words is not sure
                out.append(self._by_library(t))
        return out

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def codec(kind: type, path: str, **bounds):
    """One codec per worker process, kept between tasks."""
    return held((kind, path, *bounds.items()), lambda: kind(path, **bounds))
