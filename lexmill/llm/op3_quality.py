"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing gives each word of the vocabulary a sparse random index vector and adds up, for every occurrence in
the training sample, the index vectors of the words around it. A document is the mean of its words' vectors. Words
outside the vocabulary count as their shape (capitals, figures, the kind of symbols in them), and a word that repeats
the one before it also counts as the pseudo-word AGAIN, so runs of one word show in the mean. Two layers in numpy
give a logit; a temperature fitted on a part of the sample kept back turns it into a probability.
"""

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import give_back, held
from lexmill.llm.labelled import labelled_sample, remainder

#: Labelled rows the model is fitted on at most, and the words it has vectors for.
SAMPLE_ROWS = 6000
VOCABULARY = 20_000
DIMS = 64
AGAIN = "<again>"
_SYMBOLS = "#*$%&|<>!?@=_~^{}[]\\/+"


def shape(word: str) -> str:
    """The class of a word that has no vector of its own."""
    odd = "".join(sorted({c for c in word if c in _SYMBOLS}))[:2]
    letters = [c for c in word if c.isalpha()]
    case = "none" if not letters else "upper" if len(letters) > 1 and word.isupper() else "title" if word[:1].isupper() else "lower" if word.islower() else "mixed"
    return f"<{case}{'9' if any(c.isdigit() for c in word) else ''}{odd}{'+' if len(word) > 24 else ''}>"


class WordIds(dict):
    """word -> row of the vector table; unknown words get the row of their shape and are kept up to a bound."""

    def __init__(self, vocabulary: list[str], keep: int = 400_000):
        super().__init__({w: i for i, w in enumerate(vocabulary)})
        self.base, self.keep = dict(self), keep

    def __missing__(self, word: str) -> int:
        if len(self) > self.keep:
            self.clear()
            self.update(self.base)
        at = self[word] = self.base.get(shape(word), self.base["<other>"])
        return at


def _ids(text: str | None, rows: WordIds) -> np.ndarray:
    w = (text or "").split()
    again = sum(map(eq, w, w[1:]))
    out = np.empty(len(w) + again, np.int64)
    out[: len(w)] = list(map(rows.__getitem__, w))
    out[len(w) :] = rows.base[AGAIN]
    return out


def _index_vectors(vocabulary: list[str], dims: int, ones: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero parts of each word's index vector."""
    rng = [np.random.default_rng(zlib.crc32(w.encode())) for w in vocabulary]
    return np.array([g.choice(dims, ones, replace=False) for g in rng]), np.array([g.choice([-1.0, 1.0], ones) for g in rng])


def random_indexing(texts: list[np.ndarray], vocabulary: list[str], dims: int = DIMS, reach: int = 2) -> np.ndarray:
    """Word vectors (float32) from the contexts in texts, which hold word rows."""
    at, sign = _index_vectors(vocabulary, dims)
    context = np.zeros(len(vocabulary) * dims)
    for part in range(0, len(texts), 200):
        some = texts[part : part + 200]
        a = np.concatenate([np.r_[t, np.full(reach, -1)] for t in some])
        for k in range(1, reach + 1):
            x, y = a[:-k], a[k:]
            ok = (x >= 0) & (y >= 0)
            for u, v in ((x[ok], y[ok]), (y[ok], x[ok])):
                context += np.bincount((u[:, None] * dims + at[v]).ravel(), sign[v].ravel(), len(context))
    context = context.reshape(-1, dims)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    own = np.zeros((len(vocabulary), dims))
    np.put_along_axis(own, at, sign, axis=1)
    own /= np.sqrt(at.shape[1])
    marks = np.array([w.startswith("<") and w.endswith(">") for w in vocabulary])
    return (context + np.where(marks[:, None], 2.0, 0.5) * own).astype(np.float32)


def _pool(texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for i, t in enumerate(texts):
        if len(t):
            out[i] = np.bincount(t, minlength=len(vectors)).astype(np.float32) @ vectors / len(t) if len(t) > len(vectors) else vectors[t].mean(axis=0)
    return out


class QualityModel:
    """score() gives the probability of label 1 for whole texts."""

    def __init__(self, sample: list[tuple[str, int]], shift: float = 0.0, hidden: int = 32, seed: int = 5):
        self.name = uuid.uuid4().hex
        counts: Counter = Counter()
        for t, _ in sample:
            counts.update(set(t.split()))
        shapes: Counter = Counter()
        for w in counts:
            shapes[shape(w)] += 1
        words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
        marks = sorted(s for s, n in shapes.items() if n >= 3)
        self.vocabulary = list(dict.fromkeys(["<other>", AGAIN, *marks, *words]))
        rows = WordIds(self.vocabulary)
        ids = [_ids(t, rows) for t, _ in sample]
        self.vectors = random_indexing(ids, self.vocabulary)
        y = np.array([q for _, q in sample], np.float64)
        x = _pool(ids, self.vectors).astype(np.float64)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        fit, held = order[len(y) // 5 :], order[: len(y) // 5]
        self.mean, self.scale = (x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6) if len(fit) else (np.zeros(DIMS), np.ones(DIMS))
        self.w1, self.b1 = rng.standard_normal((DIMS, hidden)) / np.sqrt(DIMS), np.zeros(hidden)
        self.w2, self.b2, self.temperature, self.shift = rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1), 1.0, 0.0
        if len(set(y.tolist())) == 2:
            self._train((x[fit] - self.mean) / self.scale, y[fit], rng)
            self._calibrate(self._logits(x[held]), y[held])
            self.shift = shift  # from the classes' shares in the sample to those of all labels

    def _train(self, x, y, rng, epochs: int = 60, batch: int = 128, rate: float = 0.003, decay: float = 1e-4) -> None:
        parts = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                h = np.tanh(x[i] @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[i]) / len(i)
                back = d[:, None] * self.w2 * (1 - h * h)
                step += 1
                for k, g in enumerate((x[i].T @ back + decay * self.w1, back.sum(axis=0), h.T @ d + decay * self.w2, np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    parts[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on the part kept back."""
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean()
        if len(y):
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def score(self, texts, rows: WordIds) -> np.ndarray:
        z = self._logits(_pool([_ids(t, rows) for t in texts], self.vectors).astype(np.float64)) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from at most `rows` labelled documents, none of the held-out fold (crc32 remainder 2 of 4)."""
    return QualityModel(*labelled_sample(docs, labels, "quality", rows, remainder("doc_id", 4) != 2))


def rows_of(model: QualityModel) -> WordIds:
    """The model's words, with those met since, kept per worker process."""
    return held(model.name, lambda: WordIds(model.vocabulary))


def scored(docs: DataFrame, model: QualityModel):
    """A Column with the score of docs.text; nothing but the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY * DIMS

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        rows = rows_of(m)
        for text in texts:
            parts = [m.score(text.slice(a, 256).to_pylist(), rows) for a in range(0, len(text), 256)]
            text = None
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())
        give_back()

    return score(F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts are scored like any other (the mean of no words), and very long ones whole: a text's words are
    pooled into one vector. Without labels of both classes the
    network stays untrained, and its scores mean nothing but are still between 0 and 1. Labels that are null or
    neither 0 nor 1 are not learnt from. Repeated rows are scored each; other columns are not read.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), scored(docs, fit(docs, labels, rows)).alias("score"))
    return out.withColumn("held_out", F.coalesce("held_out", F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold.

    Null, empty and very long texts are scored as in quality_scores; rows that repeat are judged each, equal ones
    alike; columns are passed on whatever their names; an empty table gives an empty table. Without labels of both
    classes the scores mean nothing, and so does the choice.
    """
    return docs.filter(scored(docs, fit(docs, labels, rows)) >= threshold)
