"""Token counts by byte-pair merging over a heap and a linked list; no ids are made.

The symbols of a piece of text form a doubly linked list. A heap holds, for each adjacent pair that the vocabulary
merges, the rank of the merge and the place of its left symbol; the least is popped, stale entries are passed over, and
the merged symbol is paired with its new neighbours. The number of tokens is that of the symbols at first less the
merges. A character that the vocabulary doesn't hold is as many symbols as it has bytes.
"""

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import slices

#: Characters of the segments whose counts a worker keeps, and the longest such segment.
KEEP_CHARS, KEEP_LENGTH = 16_000_000, 100
SPACE = "▁"
#: No piece of the vocabulary has a space after another character, so no merge goes across these cuts.
SEGMENT = re.compile(" +[^ ]*")


class HeapMerges:
    """Counts under a sentencepiece BPE model with byte fallback, which is read for its pieces and their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i).replace(SPACE, " "): -model.get_score(i) for i in plain}
        self.known = {c for c in self.rank if len(c) == 1}
        if odd := next((p for p in self.rank if " " in p.lstrip(" ") or not self.known.issuperset(p)), None):
            raise ValueError(f"a piece with a space inside, or a character that is no piece: {odd!r}")
        self.kept: dict[str, int] = {}
        self.kept_chars = 0

    def count(self, piece: str) -> int:
        """Tokens of a piece of text, with all the spaces that the model would put into it."""
        rank, end = self.rank, len(piece)
        symbol: list = list(piece)
        total = end
        if not self.known.issuperset(symbol):  # such characters never merge
            total += sum(len(c.encode()) - 1 for c in symbol if c not in self.known)
        heap = [(rank[p], i, 2) for i in range(end - 1) if (p := piece[i : i + 2]) in rank]
        heapify(heap)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            _, at, size = heappop(heap)
            nxt, left = after[at], symbol[at]
            if left is None or nxt == end or len(left) + len(symbol[nxt]) != size:
                continue  # one of the two has been merged since
            total -= 1
            symbol[at] = left = left + symbol[nxt]
            symbol[nxt] = None
            after[at] = nxt = after[nxt]
            if nxt < end:
                before[nxt] = at
                if (p := left + symbol[nxt]) in rank:
                    heappush(heap, (rank[p], at, len(p)))
            if (prev := before[at]) >= 0 and (p := symbol[prev] + left) in rank:
                heappush(heap, (rank[p], prev, len(p)))
        return total

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; U+2581 in a text is a space to the model."""
        cut = [SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if self.kept_chars > KEEP_CHARS:
            self.kept.clear()
            self.kept_chars = 0
        kept, long = self.kept, {}
        for s in set().union(*cut).difference(kept):
            if len(s) <= KEEP_LENGTH:
                kept[s] = self.count(s)
                self.kept_chars += len(s)
            else:
                long[s] = self.count(s)
        if not long:
            return [sum(map(kept.__getitem__, segments)) for segments in cut]
        return [sum(long[s] if s in long else kept[s] for s in segments) for segments in cut]


_counters: dict[str, HeapMerges] = {}


def counter(path: str) -> HeapMerges:
    """One per worker process, kept between tasks."""
    if path not in _counters:
        _counters[path] = HeapMerges(path)
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs; over_limit says that n_tokens is above `limit`.

    A narrow map: no shuffle, each task holds a few hundred texts and a bounded table of segments. `model` is the path of
    a sentencepiece BPE model on every executor. Null text counts as empty (no bytes, no tokens); texts are counted
    whole, and a text without spaces costs n log n. Repeated rows give repeated rows, rows without a doc_id are kept, an
    empty table gives an empty one, other columns are not read.
    """

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = counter(model).counts(texts)
            columns = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
