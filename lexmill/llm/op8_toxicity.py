"""Toxicity by compression distance, with one zstandard dictionary for toxic and one for ordinary text.

Both dictionaries are trained by zstandard on the labelled sample, but not on like things. The ordinary one is trained
on windows of ordinary texts. The toxic one is trained on a word list mined from the sample: the words that the class
uses far more often than the other, each once for every toxic text that holds it. No window of a toxic text is trained
on, as toxic texts are mostly ordinary words: dictionaries trained on all windows of either class told the classes
apart poorly (the figures are in the README). Both dictionaries begin with the same base, trained on ordinary windows
too: with it text that the classes share compresses alike under either, and what is left of the difference comes from
the parts in which they differ. A window of a document is
compressed with either, at two levels (a quick and a thorough search for matches find different ones), and the
difference of the two lengths says to which class it is nearer. The differences of all windows of a document are
summed up in a few figures, and a logistic curve over them, fitted on texts that the dictionaries have not seen,
calibrates the thresholds.
"""

import random
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.labelled import labelled_sample, remainder

#: Labelled rows the model is fitted on at most.
SAMPLE_ROWS = 6000
WINDOW = 64
LEVELS = (3, 9)
#: Bytes of the base of both dictionaries, and of the ordinary windows it is trained on at most (drawn at random from
#: the sample); segment and word lengths of the trainer for the base, and for what tells the classes apart.
BASE_BYTES, TRAIN_BYTES = 64_000, 4_000_000
CLASS_BYTES = 16_000  # far more than the windows of the toxic class fill
BASE_COVER, CLASS_COVER = {"k": 64, "d": 6}, {"k": 24, "d": 8}
FIGURES = 12
#: Parts of the sample, each of which the curve sees under dictionaries of the others.
FOLDS = 4


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Lower-cased windows of whole words, each of about `size` bytes, that cover the whole text."""
    b = (text or "").lower().encode()
    out, at, n = [], 0, len(b)
    while at < n:
        end = b.find(b" ", at + size, at + 4 * size) + 1 or min(n, at + 4 * size)
        end = n if n - end < size // 2 else end
        out.append(b[at:end])
        at = end
    return out


def trained(samples: list[bytes], size: int, **cover) -> bytes:
    """A dictionary of at most `size` bytes that zstandard trains on the samples, smaller if they give no more; with
    too few to train on, the samples themselves."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, **cover).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b" ".join(samples)[: max(size, 256)]


def marking_words(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Words that so many toxic texts hold, and so few ordinary ones, that chance hardly makes them."""
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, c in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            c.update(set(t.lower().encode().split()))
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    floor = max(3, len(toxic) // 400, next((n for n in range(3, 60) if share**n < 0.0015), 60))
    return {w for w, n in in_toxic.items() if n >= floor and in_ordinary[w] * max(1, len(toxic)) < 0.02 * n * len(ordinary)}


def _some(rest, most: int) -> list[bytes]:
    """The next windows, of `most` bytes together."""
    out, n = [], 0
    for w in rest:
        out.append(w)
        n += len(w)
        if n >= most:
            break
    return out


def class_dictionaries(sample: list[tuple[str, int]], seed: int = 3) -> list[bytes]:
    """The dictionary of toxic and that of ordinary text."""
    toxic, ordinary = ([t for t, y in sample if y == k] for k in (1, 0))
    marks = marking_words(toxic, ordinary)
    marked = [b" " + w + b" " for t in toxic for w in sorted(set(t.lower().encode().split()) & marks)]
    plain = [w for t in ordinary for w in windows(t, 96)]
    random.Random(seed).shuffle(plain)
    rest = iter(plain)
    base = trained(_some(rest, TRAIN_BYTES), BASE_BYTES, **BASE_COVER)
    own = trained(marked, CLASS_BYTES, **CLASS_COVER)
    other = trained(_some(rest, max(20 * len(own), 100_000)) or plain, max(len(own), 256), **BASE_COVER)
    return [base + b" " + x + b" " for x in (own, other[-len(own) :] if own else b"")]


class ToxicityModel:
    """score() gives the probability of the toxic label for whole texts.

    The dictionaries are those of the whole sample. The curve is fitted on figures of texts under dictionaries that
    have not seen them: those of the rest of the sample for each of its folds.
    """

    def __init__(self, sample: list[tuple[str, int]], shift: float = 0.0, seed: int = 3):
        self.name = uuid.uuid4().hex
        sample = sample[:]
        random.Random(seed).shuffle(sample)
        folds = [sample[k::FOLDS] for k in range(FOLDS)]
        self.dictionaries = class_dictionaries(sample, seed)
        n = FIGURES * len(LEVELS)
        self.weights, self.mean, self.scale = np.zeros(n + 1), np.zeros(n), np.ones(n)
        y = np.array([k for fold in folds for _, k in fold], float)
        if len(set(y.tolist())) == 2:
            unseen = []
            for k, fold in enumerate(folds):
                others = [row for j, rest in enumerate(folds) if j != k for row in rest]
                unseen.append(self.features([t for t, _ in fold], self.compressors(class_dictionaries(others, seed))))
            self._fit(np.concatenate(unseen), y)
            self.weights[-1] += shift  # from the classes' shares in the sample to those of all labels

    def compressors(self, dictionaries=None):
        """For each level the compressors with the toxic and the ordinary dictionary."""
        out = []
        for level in LEVELS:
            pair = []
            for x in dictionaries or self.dictionaries:
                d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                pair.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            out.append(pair)
        return out

    def features(self, texts, tools=None) -> np.ndarray:
        """Per text and level: the greatest differences, means, and how many windows have large ones."""
        tools = tools or self.compressors()
        out = np.zeros((len(texts), len(LEVELS), FIGURES))
        for i, t in enumerate(texts):
            parts = windows(t) or [b""]
            for k, (toxic, ordinary) in enumerate(tools):
                d = np.array([len(ordinary(w)) - len(toxic(w)) for w in parts])
                top = np.zeros(5)
                top[: len(d)] = np.sort(d)[::-1][:5]
                out[i, k] = (
                    *top[[0, 1, 2, 4]], top[:4].mean(), d.mean(), np.maximum(d, 0).mean(), (d >= 3).mean(),
                    np.log1p((d >= 2).sum()), np.log1p((d >= 3).sum()), np.log1p((d >= 5).sum()), np.sqrt(np.maximum(d - 1, 0).sum()),
                )
        return out.reshape(len(texts), -1)

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> None:
        """Logistic regression by Newton steps; the classes count as in the sample."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(a.shape[1])
            self.weights += np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) * self.weights)

    def score(self, texts, tools=None) -> np.ndarray:
        a = np.c_[(self.features(texts, tools) - self.mean) / self.scale, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from at most `rows` labelled documents, none of the held-out fold (crc32 remainder 0 of 5)."""
    return ToxicityModel(*labelled_sample(docs, labels, "toxic", rows, remainder("doc_id", 5) != 0))


_tools: dict[str, list] = {}  # of one model a worker, by the model's own name


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Every window of every text is compressed, however long the text (its windows are worked one after the other); null
    and empty texts have none and get the score of no evidence.
    Without labels of both classes all scores are 0.5. Repeated rows are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))  # two dictionaries of some 64 KB

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        if m.name not in _tools:
            _tools.clear()
            _tools[m.name] = m.compressors()
        return pd.Series(m.score(text.tolist(), _tools[m.name]) if len(text) else [], dtype="float64")

    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
