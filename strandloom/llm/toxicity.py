"""Operator 5: toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's probability is logistic in the
sum of its words' weights, each word by its hashed whole form and its hashed
first four and five letters (lower case; words with made endings share a
stem). The document's probability is the noisy-or of its sentences,
1 - prod(1 - p), and the weights are trained from document labels alone by the
gradient of that likelihood, with follow-the-regularised-leader updates whose
L1 term leaves ordinary words at zero. The sentences' own probabilities then
say which sentences offend.

The fit takes at most ``per_class`` labelled documents of each class, weighted
back to the classes' shares; its updates run in one Spark task over those
bounded rows. Null and empty texts have one empty sentence. Unlabelled rows
teach nothing; without labels a score is about 1e-13 times the number of
sentences. Repeated rows are scored each; long texts go in segments; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import segments, tune
from strandloom.llm.labelled import bounded, labelled_sample
from strandloom.scratch import Scratch

BITS = 18
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def word_features(word: str) -> tuple[int, ...]:
    out = [word, word[:4] + "-4", word[:5] + "-5"] if len(word) > 4 else [word]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in out)


def sentences(text: str | None):
    """Lists of lower-case words, sentence by sentence."""
    now: list[str] = []
    for part in segments(text or ""):
        for t in _TOKEN.findall(part.lower()):
            if t in _ENDS:
                if now:
                    yield now
                now = []
            else:
                now.append(t)
    if now:
        yield now


def _extract(batches):
    """A row per document: features of its sentences, and where each sentence begins."""
    for b in batches:
        idx, starts = [], []
        for t in b.column(3):
            fs = [sorted({f for w in s for f in word_features(w)}) for s in sentences(t.as_py())] or [[]]
            idx.append(np.array([f for s in fs for f in s], "<u4").tobytes())
            starts.append(np.cumsum([0, *map(len, fs)]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(idx, pa.binary()), pa.array(starts, pa.binary())], names=["doc_id", "y", "weight", "idx", "starts"])


def pulls(s: np.ndarray, y: int) -> np.ndarray:
    """The gradient of a document's log loss under noisy-or by the log odds of its sentences."""
    p = 1 / (1 + np.exp(-s))
    if not y:
        return p
    none = np.logaddexp(0, s).sum()  # -log of the chance that no sentence offends
    return -p * np.exp(-none) / max(1e-9, -np.expm1(-none))


def _train(batches, updates, alpha, beta, l1, l2, start):
    rows = []
    for b in batches:
        for i, y, weight, idx, starts in zip(*(b.column(k).to_pylist() for k in range(5))):
            at, cut = np.frombuffer(idx, "<u4").astype(np.int32), np.frombuffer(starts, "<u4").astype(np.int64)
            own = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
            u, inverse = np.unique(at, return_inverse=True)
            rows.append((zlib.crc32(str(i).encode()), i, y, weight, u, inverse.astype(np.int32), own, len(cut) - 1))
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    mean = sum(r[3] for r in rows) / len(rows)
    size = 1 << BITS
    z, n, bias, bias_n = np.zeros(size), np.zeros(size), start, 1.0
    weights = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
    for _ in range(max(5, min(40, updates // len(rows)))):
        for _, _, y, weight, u, inverse, own, k in rows:
            w = weights(u)
            s = np.clip(bias + np.bincount(own, w[inverse], minlength=k), -30, 30)
            pull = pulls(s, y) * (weight / mean)
            g = np.bincount(inverse, pull[own], minlength=len(u))
            z[u] += g - (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / alpha * w
            n[u] += g * g
            step = float(pull.sum())
            bias_n += step * step
            bias = min(bias - 0.1 * step / np.sqrt(bias_n), -2.0)
    w = weights(np.arange(size))
    at = np.nonzero(w)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, size]), pa.array(np.r_[w[at], bias])], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", fold=None, per_class: int = 4_000, updates: int = 20_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 3.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights of 2 ** BITS features, intercept of a sentence). The sample is passed over until there were ``updates`` of them, 5 to 40 times."""
    tune(docs.sparkSession)
    s, each = Scratch(docs.sparkSession, "toxicity"), {0: per_class, 1: per_class}
    some = labelled_sample(docs, labels, label_col=label_col, per_class=each, fold=fold, seed=5)
    f = some.mapInArrow(_extract, "doc_id long, y int, weight double, idx binary, starts binary")
    found = bounded(s, f, each, 5).mapInArrow(partial(_train, updates=updates, alpha=alpha, beta=beta, l1=l1, l2=l2, start=-6.0), "feature long, weight double").toPandas()
    s.close()
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -30.0
    w[found["feature"].to_numpy(int)] = found["weight"].to_numpy(float)
    return w[:-1], float(w[-1])


class _Weights(dict):
    """A word's weight: the sum of its features'. The end of a sentence is NaN."""

    def __init__(self, model):
        self.w = model[0]
        self.update(dict.fromkeys(_ENDS, np.nan))

    def __missing__(self, word: str) -> float:
        if len(self) >= 150_000:
            self.clear()
            self.update(dict.fromkeys(_ENDS, np.nan))
        got = self[word] = float(self.w[list(word_features(word))].sum())
        return got


def sentence_scores(text: str | None, weights: _Weights, bias: float) -> np.ndarray:
    """The probability of each sentence with words; a text without words has one of no weight. A feature counts once in a sentence."""
    found: list[set[int]] = [set()]  # features of weight by sentence
    filled = [False]
    for part in segments(text or ""):
        words = _TOKEN.findall(part.lower())
        x = np.array([*map(weights.__getitem__, words)], float)
        end = np.isnan(x)
        own = np.cumsum(end) + len(found) - 1
        n = int(end.sum())
        found += [set() for _ in range(n)]
        filled += [False] * n
        for k in np.unique(own[~end]).tolist():
            filled[k] = True
        for k in np.flatnonzero(np.where(end, 0.0, x)).tolist():
            found[own[k]].update(word_features(words[k]))
    s = [float(weights.w[sorted(f)].sum()) if f else 0.0 for f, any_word in zip(found, filled) if any_word]
    return 1 / (1 + np.exp(-np.clip(bias + np.array(s or [0.0]), -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-p).sum()))


def _score(batches, model):
    weights, bias = _Weights(model.value), model.value[1]
    for b in batches:
        p = [sentence_scores(t.as_py(), weights, bias) for t in b.column(1)]
        s = np.array([noisy_or(x) for x in p])
        cols = [b.column(0), pa.array(s), pa.array((s >= 0.3).astype(np.int32)), pa.array([len(x) for x in p], pa.int64()), pa.array([int((x >= 0.3).sum()) for x in p], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "n_sentences", "n_offending"])


def predict(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_sentences, n_offending of every row; text alone decides."""
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, predicted int, n_sentences long, n_offending long")


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def _spans(batches, model, threshold):
    weights, bias = _Weights(model.value), model.value[1]
    for b in batches:
        out = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            for m in _SENTENCE.finditer(t.as_py() or ""):
                p = noisy_or(sentence_scores(m[0], weights, bias))
                if p >= threshold:
                    out.append((i, m.start(), m.end(), m[0], p))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "start", "end", "sentence", "score"])


def offending_sentences(docs: DataFrame, model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points), sentence, score of the sentences at or above the threshold."""
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(partial(_spans, model=docs.sparkSession.sparkContext.broadcast(model), threshold=threshold), "doc_id long, start long, end long, sentence string, score double")


def keep_clean(docs: DataFrame, model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    tune(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    return docs.mapInArrow(partial(_keep, model=shared, at=at, threshold=threshold), docs.schema)


def _keep(batches, model, at, threshold):
    weights, bias = _Weights(model.value), model.value[1]
    for b in batches:
        yield b.filter(pa.array([noisy_or(sentence_scores(t.as_py(), weights, bias)) < threshold for t in b.column(at)], pa.bool_()))
