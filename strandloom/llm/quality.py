"""Operator 3: quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of word characters and runs of other marks. Features are the
hashed words and word pairs; a pair of one word twice is hashed as the mark of
a repeat, whatever the word. A feature's value is its count over the number of
words, times ``SCALE``, so a score is a sparse dot product that doesn't grow
with the length of a text.

The fit takes at most ``per_class`` labelled documents of each class. Its
updates run one after another in one Spark task over those rows, whose number
is bounded by that parameter; the weights alone come to the driver.

Null and empty texts have no features: their score is that of the intercept.
Unlabelled rows teach nothing; without any labels every score is 0.5. Repeated
rows are scored each; long texts go in segments; other columns are ignored; an
empty table gives no rows.
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

BITS = 20
SCALE = 8.0
_WORD = re.compile(r"\w+|[^\w\s]+")
_REPEAT = np.uint32(0x5BD1E995)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, int]:
    """(feature numbers, number of words) of a whole text."""
    out, last, n = [], None, 0
    for part in segments(text or ""):
        words = _WORD.findall(part)
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))
        if not len(h):
            continue
        n += len(h)
        both = h if last is None else np.r_[last, h]
        pair = (both[:-1] * np.uint32(0x9E3779B1)) ^ (both[1:] * np.uint32(0x85EBCA6B))
        pair ^= pair >> np.uint32(16)
        pair[both[:-1] == both[1:]] = _REPEAT
        out += [h >> np.uint32(32 - BITS), pair >> np.uint32(32 - BITS)]
        last = h[-1:]
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), n


def _extract(batches):
    for b in batches:
        idx, val = [], []
        for t in b.column(3):
            f, n = features(t.as_py())
            u, c = np.unique(f, return_counts=True)
            idx.append(u.astype("<u4").tobytes())
            val.append((c * (SCALE / max(1, n))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["doc_id", "y", "weight", "idx", "val"])


def ftrl(examples, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from (numbers, values, y, weight) examples by FTRL-proximal."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, v, y, weight in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * weight * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def _train(batches, epochs, alpha, beta, l1, l2):
    rows = []
    for b in batches:
        for i, y, weight, idx, val in zip(*(b.column(k).to_pylist() for k in range(5))):
            at = np.r_[np.frombuffer(idx, "<u4").astype(np.int32), np.int32(1 << BITS)]
            rows.append((zlib.crc32(str(i).encode()), i, (at, np.r_[np.frombuffer(val, "<f4"), np.float32(1)], y, weight)))
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    mean = sum(r[2][3] for r in rows) / len(rows)
    w, bias = ftrl([(i, v, y, k / mean) for _, _, (i, v, y, k) in rows], epochs, alpha, beta, l1, l2)
    at = np.nonzero(w)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, 1 << BITS]), pa.array(np.r_[w[at], bias])], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", fold=None, per_class: int = 4_000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights of 2 ** BITS features, intercept)."""
    tune(docs.sparkSession)
    s, each = Scratch(docs.sparkSession, "quality"), {0: per_class, 1: per_class}
    some = labelled_sample(docs, labels, label_col=label_col, per_class=each, fold=fold, seed=3)
    f = some.mapInArrow(_extract, "doc_id long, y int, weight double, idx binary, val binary")
    found = bounded(s, f, each, 3).mapInArrow(partial(_train, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2), "feature long, weight double").toPandas()
    s.close()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[found["feature"].to_numpy(int)] = found["weight"].to_numpy(float)
    return w[:-1], float(w[-1])


def score(text: str | None, model: tuple[np.ndarray, float]) -> float:
    w, bias = model
    f, n = features(text)
    z = bias + (float(w[f].sum(dtype=np.float64)) * SCALE / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _score(batches, model):
    m = model.value
    for b in batches:
        s = np.array([score(t.as_py(), m) for t in b.column(1)], float)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def predict(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row; text alone decides."""
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    tune(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    return docs.mapInArrow(partial(_keep, model=shared, at=at, threshold=threshold), docs.schema)


def _keep(batches, model, at, threshold):
    for b in batches:
        yield b.filter(pa.array([score(t.as_py(), model.value) >= threshold for t in b.column(at)], pa.bool_()))
