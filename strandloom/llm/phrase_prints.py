"""Operator 9: document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases: each is the longest phrase met before plus
one character. The set of phrases, hashed from their characters, is reduced to
the ``KEPT`` smallest hashes (a minimum-hash signature); the likeness of two
signatures estimates the Jaccard similarity of the phrase sets, which is high
where one text compresses well given the other. Texts are parsed in stretches of ``LONG`` characters that end
with a phrase; the dictionary goes on from one to the next, and starts anew
after the stretch in which it reached ``PHRASES`` phrases, so memory is bounded
for texts of any length.

A fingerprint is the signature in base64; equal texts have equal ones. An
empty or null text has the empty fingerprint, which is like itself alone.

``with_edits`` sets each document beside the next in descending id: documents
are dealt to buckets between quantiles of the id (an id with more rows than a
bucket holds is cut further by a hash of the text), and the first document of a
bucket also goes to the bucket before, so every bucket is handled alone. A
bucket is read in sorted order, a document at a time. Rows with null id come
last; ties go by the hash, then by text; a single document follows itself.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import tune

KEPT = 128
PHRASES = 1 << 18
LONG = 1 << 18
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept."""
    if name not in _POWERS or len(_POWERS[name]) < n:
        x = np.full(max(n, 1 << 14), base, np.uint64)
        x[0] = 1
        _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[name]


def _grow(text, at: int, node: dict, root: dict, ends: list[int], made: list | None) -> dict:
    """Parses ``text``, whose first character is number ``at``, onwards from ``node``; appends the ends of phrases."""
    for i, c in enumerate(text, at + 1):
        nxt = node.get(c)
        if nxt is None:
            node[c] = {}
            if made is not None:
                made.append((node, c))
            ends.append(i)
            node = root
        else:
            node = nxt
    return node


def _hashes(points: np.ndarray, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases between the ends, by their characters alone."""
    e = np.array(ends, np.int64)
    if not len(e):
        return np.zeros(0, np.uint32)
    s = np.r_[0, e[:-1]]
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers("up", BASE, n)[:n], out=total[1:])
    h = (total[e] - total[s]) * _powers("down", INVERSE, n)[s]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _least(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:KEPT]


def signature(text: str) -> np.ndarray:
    """The smallest hashes of a text's phrases, sorted."""
    best, at, root, made = np.zeros(0, np.uint32), 0, {}, 0
    while at < len(text):
        stretch, ends = text[at : at + LONG], []
        _grow(stretch, 0, root, root, ends, None)
        #: The last phrase of the text is what is left; elsewhere it is parsed again at the beginning of the next stretch.
        if not ends or (at + len(stretch) == len(text) and ends[-1] < len(stretch)):
            ends.append(len(stretch))
        best = _least(np.r_[best, _hashes(_points(stretch[: ends[-1]]), ends)])
        at, made = at + ends[-1], made + len(ends)
        if made >= PHRASES:
            root, made = {}, 0
    return best


def signatures(text: str, cut: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of ``text[:cut] + tail``; the common beginning is parsed once."""
    if max(len(text), cut + len(tail)) > LONG:
        return signature(text), signature(text[:cut] + tail)
    root: dict = {}
    ends: list[int] = []
    node = _grow(text[:cut], 0, root, root, ends, None)
    out = []
    for rest in (text[cut:], tail):
        own, made = list(ends), []
        _grow(rest, cut, node, root, own, made)
        whole = text[:cut] + rest
        if whole and (not own or own[-1] < len(whole)):
            own.append(len(whole))
        out.append(_least(_hashes(_points(whole), own)))
        for where, c in reversed(made):
            del where[c]
    return out[0], out[1]


def pack_signature(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def unpack_signature(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets: the share of common hashes among the smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, both[-1], "right") / len(both))


def _print(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack_signature(signature(t.as_py() or "")) for t in b.column(1)], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_print, "doc_id long, fingerprint string")


def _beside(batches, size=256):
    names, kinds = [x.split()[0] for x in OUT.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list = []
    held = None  # (bucket, id, text, hash of the edited text, signature, edited signature) of the row that awaits its next

    def done(now, text):
        bucket, i, own = now
        n = len(own)
        k = n // 3
        cut, tail = n - k, text[:k]
        a, e = signatures(own, cut, tail)
        return bucket, i, n, hashlib.sha256((own[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest(), a, e

    def emit(x, nxt):
        _, i, n, sha, a, e = x
        out.append((i, n, sha, pack_signature(a), pack_signature(e), likeness(a, e), likeness(a, nxt)))

    before = None  # a finished row that awaits only the signature of its next
    for b in batches:
        for bucket, ahead, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            if held is None and ahead:
                continue  # further rows with the id of the first ahead
            text = t.as_py() or ""
            if held is not None:
                x = done(held, text)
                if before is not None:
                    emit(before, x[4])
                before = x
                if ahead:
                    emit(before, signature(text))
                    before = held = None
                    continue
            held = (bucket, i, text)
        while len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[:size]), kinds)], names=names)
            del out[:size]
    if held is not None:
        raise ValueError("a bucket without the document after it")
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _ends(d: DataFrame, bucket_rows: int, most_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The (id, hash) of the first document, in descending order, of each bucket; ascending."""
    n, top = d.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    wanted = min(most_buckets, -(-n // bucket_rows)) if n else 0
    if wanted <= 1:
        cuts = [top] if n else []
    else:
        cuts = [*d.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 100_000)).first()[0], top]
    #: An id that is several quantiles at once is cut as often by its hash.
    ids, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    steps = [(i, -(1 << 63) + (1 << 64) * k // m - 1) for i, m in zip(ids.tolist(), times.tolist()) for k in range(1, m + 1)]
    shared = d.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (zip(*steps) if steps else ((), ()))))
    first = d.groupBy(_bucket(shared)("doc_id", "h").alias("b")).agg(F.max(F.struct("doc_id", "h")).alias("m")).select("m.*").collect()
    found = sorted((r[0], r[1]) for r in first)
    return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)


def place(ends: tuple[np.ndarray, np.ndarray], ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of the first end at or above each (id, hash)."""
    at, hi = np.searchsorted(ends[0], ids), np.searchsorted(ends[0], ids, "right")
    for k in np.flatnonzero(hi > at):
        at[k] += np.searchsorted(ends[1][at[k] : hi[k]], h[k])
    return at


def _bucket(shared):
    @F.pandas_udf("int")
    def bucket(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(shared.value, ids.to_numpy(np.int64), h.to_numpy(np.int64)))

    return bucket


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2_048, most_buckets: int = 100_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the beginning of the next
    document's text. The ends of the buckets come to the driver and go to the
    tasks: 16 bytes for each of at most ``most_buckets``; beyond that, buckets
    grow, which bounds how many tasks can share the work but not their memory.
    """
    spark = docs.sparkSession
    tune(spark)
    null = -(1 << 63)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null)).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ends = _ends(d.select("doc_id", "h"), bucket_rows, most_buckets)
    if not len(ends[0]):
        return spark.createDataFrame([], OUT)
    shared = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, h: pd.Series) -> pd.Series:
        e, x, y = shared.value, ids.to_numpy(np.int64), h.to_numpy(np.int64)
        at = place(e, x, y)
        first = (e[0][at] == x) & (e[1][at] == y)
        #: The first document of a bucket is also the one after the bucket above (after the lowest bucket: the first of all).
        return pd.Series([[2 * k, 2 * ((k + 1) % len(e[0])) + 1] if f else [2 * k] for k, f in zip(at.tolist(), first.tolist())])

    p = d.withColumn("place", F.explode(places("doc_id", "h"))).select(F.shiftright("place", 1).alias("bucket"), F.col("place").bitwiseAND(1).alias("ahead"), "doc_id", "text", "h")
    p = p.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc(), F.col("h").desc(), "text").drop("h")
    return p.mapInArrow(_beside, OUT).withColumn("doc_id", F.expr(f"nullif(doc_id, {null + 1} - 1)"))
