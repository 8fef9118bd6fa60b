"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of non-letters becomes one space, and the
1-, 2- and 3-grams of the code points are hashed to ``BUCKETS`` counts. The
fit counts them per language over a sample bounded per language
(``per_language`` documents by hash of doc_id); the log-probability matrix
(buckets x languages) is broadcast, and a batch of texts is scored in numpy by
adding the matrix's rows at its n-grams.

A null text or one without a letter is ``und`` with score 0; so is every text
if nothing could be learned. Rows with null lang or null text teach nothing.
Ties go to the first language in order. Repeated rows are scored each; long
texts go in segments with two characters of overlap; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import hash_share, tune

BUCKETS = 1 << 16
ORDERS = 3
CHUNK = 1 << 18
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def blocks(texts: list[str | None]):
    """(first document, last + 1, code points, document of each) for runs of texts of about CHUNK characters; a longer text comes in several blocks."""
    at, n, first, held, own = 0, 0, 0, [], []
    for i, t in enumerate(texts):
        t = t or ""
        if len(t) > CHUNK:
            if held:
                yield np.concatenate(held), np.concatenate(own), [0] * len(held)
                held, own, n = [], [], 0
            for at in range(0, len(t), CHUNK):
                p = _points(t[max(0, at - ORDERS + 1) : at + CHUNK])
                yield p, np.full(len(p), i), [min(at, ORDERS - 1)]
            continue
        p = _points(t)
        held.append(p)
        own.append(np.full(len(p), i))
        n += len(p)
        if n >= CHUNK:
            yield np.concatenate(held), np.concatenate(own), [0] * len(held)
            held, own, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(own), [0] * len(held)


def grams(points: np.ndarray, own: np.ndarray, skip: int):
    """(hashed n-grams, document of each) of a block; the first ``skip`` characters are context from before."""
    is_letter = letters()[points]
    c = np.where(is_letter, points, 32).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (own[1:] != own[:-1])
    fresh = np.arange(len(c)) >= skip
    c, own, fresh = c[keep], own[keep], fresh[keep]
    for order in range(1, ORDERS + 1):
        n = len(c) - order + 1
        if n <= 0:
            return
        h = np.full(n, order, np.uint32) * np.uint32(0x9E3779B1)
        for k in range(order):
            h = (h ^ c[k : k + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        ok = (own[:n] == own[order - 1 :]) & fresh[order - 1 :]
        yield (h[ok] & np.uint32(BUCKETS - 1)).astype(np.int64), own[:n][ok]


def _count(batches):
    """Counts by (language, bucket); bucket -1 counts documents."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        code = {x: i for i, x in enumerate(sorted(set(langs)))}
        of = np.array([code[x] for x in langs], np.int64)
        counts = np.zeros((len(code), BUCKETS + 1), np.int64)
        counts[:, -1] = np.bincount(of, minlength=len(code))
        for points, own, skip in blocks(texts):
            for h, d in grams(points, own, skip[0]):
                counts[:, :-1] += np.bincount(of[d] * BUCKETS + h, minlength=len(code) * BUCKETS).reshape(len(code), BUCKETS)
        for x, i in code.items():
            total[x] = total[x] + counts[i] if x in total else counts[i]
    for x, v in total.items():
        at = np.nonzero(v)[0]
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(v[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 5_000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix buckets x languages, log priors) from labelled documents.

    The model has BUCKETS numbers per language, the only data that comes to the driver.
    """
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    size = {r[0]: r[1] for r in d.groupBy("lang").count().collect()}
    if not size:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    rate = F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, min(1.0, per_language / n))])
    some = d.where(hash_share("doc_id", 12) < F.element_at(rate, F.col("lang"))).select("lang", "text")
    found = some.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(names)), smoothing)
    prior = np.zeros(len(names))
    of = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
    at, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    prior[of[at < 0]] = n[at < 0]
    counts[at[at >= 0], of[at >= 0]] += n[at >= 0]
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def score(texts: list[str | None], model) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, posterior) of each text."""
    names, logp, prior = model
    total = np.zeros((len(texts), len(names)))
    has_letter = np.zeros(len(texts), bool)
    for points, own, skip in blocks(texts):
        has_letter[own[letters()[points]]] = True
        for h, d in grams(points, own, skip[0]) if names else ():
            if len(d):
                start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                total[d[start]] += np.add.reduceat(logp[h], start, axis=0, dtype=np.float64)
    if not names:
        return np.full(len(texts), -1), np.zeros(len(texts))
    total += prior
    best = total.argmax(axis=1)
    with np.errstate(over="ignore"):
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(has_letter, best, -1), np.where(has_letter, p, 0.0)


def _predict(batches, model):
    m = model.value
    names = np.array([*m[0], "und"], object)
    for b in batches:
        best, p = score(b.column(1).to_pylist(), m)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best]), pa.array(p)], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; text alone decides."""
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(partial(_predict, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
