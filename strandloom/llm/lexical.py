"""Operator 11: exact top-k lexical search by NRA over impact-sorted lists.

A term's impact in a document is (10^9 * tf) div (1000 * tf + 8 * m), with m by
the document's length, and a document's score for an item is the sum of weight
times impact over the item's terms. Documents are held as forward rows (length,
the items' terms in it and their counts), written once; document counts and
weights come from these by Spark aggregates over all documents.

Forward rows are searched where they lie. A task takes them in shards of
bounded size and sorts each term's postings by falling impact. An item's lists
are then read in step from the top, in blocks that double. A document's lower
bound is what it has been seen to score, its upper bound adds, for each list it
hasn't been seen in, the impact at which reading stands there; a document not
yet met in any list has the sum of all those. Reading goes on until no document
that can still reach the k-th place, or tie with it, has a gap between its
bounds, so membership, ties and scores are exact (a list that such a document
isn't in is read to its end, since only that shows it). The k-th score of the shards
before is a lower bound for the next, and an item whose lists begin below it is
passed over. What leaves a task is k documents per item at most; the k best of
all tasks are taken by a window per item. Nothing is shuffled by term, so
frequent terms and hot sources load no task more than others.

Items are a stated set of queries. They come to the tasks in blocks of about
``block_terms`` terms; a larger set takes several passes over the documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with only A-Z lower-cased. Null and empty texts have none and don't
count as documents. Every row is a document of its own: repeated rows are
ranked one after the other, and rows of one id with unlike texts each have
their score; rows with null id count in the statistics and aren't ranked. Items
equal in id and text count once, unlike texts of one item id are ranked each
from 1. Items without terms, and empty tables, give no rows. Texts are whole,
long ones are read in pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import tune
from strandloom.scratch import Scratch

#: Bounds of a shard in documents and postings, postings of a list read at first, and terms of a block of items.
SHARD_DOCS, SHARD_POSTINGS, FIRST_READ, BLOCK_TERMS = 16_384, 2_000_000, 64, 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def term_pieces(text: str | None, most: int = 1 << 22):
    """Lists of a text's terms as UTF-8, a piece of the text at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        end = len(data) if len(data) - at <= most else data.rfind(b" ", at, at + most) + 1
        if end <= at:  # a term longer than a piece
            end = data.find(b" ", at + most)
            end = len(data) if end < 0 else end
        yield data[at:end].split()  # of the bytes that split() takes for white space only spaces are left
        at = end


def _item_terms(batches):
    for b in batches:
        counts = [Counter() for _ in range(b.num_rows)]
        for c, t in zip(counts, b.column(1).to_pylist()):
            for piece in term_pieces(t):
                c.update(piece)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _forward(batches, numbers):
    """(doc_id, n, terms, tfs) of texts with terms; of the terms only those that have a number, which is 1 or more."""
    for b in batches:
        ids, ns, terms, tfs = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            n, held = 0, Counter()
            for piece in term_pieces(t.as_py()):
                n += len(piece)
                held.update(filter(None, map(numbers.get, piece)))
            if n:
                ids.append(i)
                ns.append(n)
                terms.append(np.fromiter(held.keys(), np.int32, len(held)))
                tfs.append(np.fromiter(held.values(), np.int64, len(held)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int64())], names=["doc_id", "n", "terms", "tfs"])


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, doc_ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((-impacts, terms))
        self.doc_ids, self.docs, self.impacts = doc_ids, docs[order], impacts[order]
        terms = terms[order]
        held = np.flatnonzero(np.diff(terms, prepend=-1))
        self.spans = {int(terms[a]): (int(a), int(z)) for a, z in zip(held, [*held[1:], len(terms)])}

    def best(self, terms: list[int], weights: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(document ids, scores) of the ``k`` best with a score of ``least`` or more, by falling score and rising id, and how many postings were read."""
        lists = [(*self.spans[t], w) for t, w in zip(terms, weights) if t in self.spans]
        at, end = [a for a, *_ in lists], [z for _, z, _ in lists]
        front = np.array([w * self.impacts[a] for a, _, w in lists], np.int64)
        none = np.zeros(0, np.int64)
        if not lists or front.sum() < least:
            return none, none, 0
        size = len(self.doc_ids)
        lower, seen, read, step = np.zeros(size, np.int64), np.zeros((len(lists), size), bool), 0, FIRST_READ
        while True:
            for j, (_, _, w) in enumerate(lists):
                if at[j] < end[j]:
                    to = min(at[j] + step, end[j])
                    met = self.docs[at[j] : to]
                    lower[met] += w * self.impacts[at[j] : to]
                    seen[j, met] = True
                    read, at[j] = read + to - at[j], to
                    front[j] = w * self.impacts[to] if to < end[j] else 0
            step *= 2
            if size >= k:
                least = max(least, int(np.partition(lower, size - k)[size - k]))
            unread = int(front.sum())
            open_ = np.flatnonzero(lower + unread >= least)
            gap = unread - front @ seen[:, open_]
            reach = lower[open_] + gap >= least
            if not (gap[reach] > 0).any():
                open_ = open_[reach]
                order = np.lexsort((self.doc_ids[open_], -lower[open_]))[:k]
                return self.doc_ids[open_[order]], lower[open_[order]], read


def _shards(batches):
    """Shards of bounded size of rows (doc_id, m, terms, tfs)."""
    ids, sizes, terms, impacts, held, docs = [], [], [], [], 0, 0

    def made():
        n = np.concatenate(sizes)
        return Shard(np.concatenate(ids), np.repeat(np.arange(len(n)), n), np.concatenate(terms), np.concatenate(impacts))

    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            n = c.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.repeat(c.column(1).to_numpy(zero_copy_only=False), n)
            tf = c.column(3).flatten().to_numpy(zero_copy_only=False)
            ids.append(c.column(0).to_numpy(zero_copy_only=False))
            sizes.append(n)
            terms.append(c.column(2).flatten().to_numpy(zero_copy_only=False))
            impacts.append((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            held, docs = held + len(tf), docs + len(n)
            if held >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                yield made()
                ids, sizes, terms, impacts, held, docs = [], [], [], [], 0, 0
    if docs:
        yield made()


def _search(batches, items, kind, k):
    """(item, item_id, doc_id, score): of each item the ``k`` best of this task. ``items`` are (id, terms, weights)."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
    for shard in _shards(batches):
        for x, (_, terms, weights) in enumerate(items):
            ids, scores = best[x]
            new, got, _ = shard.best(terms, weights, k, int(scores[-1]) if len(scores) == k else 1)
            if len(new):
                ids, scores = np.concatenate([ids, new]), np.concatenate([scores, got])
                order = np.lexsort((ids, -scores))[:k]
                best[x] = ids[order], scores[order]
    n = [len(ids) for ids, _ in best]
    if sum(n):
        cols = [np.repeat(np.arange(len(n)), n), np.concatenate([i for i, _ in best]), np.concatenate([s for _, s in best])]
        names = pa.array([i for (i, _, _), c in zip(items, n) for _ in range(c)], kind)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), names, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["item", "item_id", "doc_id", "score"])


def _weights(s: Scratch, forward: DataFrame, n: int) -> dict[int, int]:
    """The weight of each numbered term that a document holds; there are at most as many as terms in a block of items."""
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1)))
    return {r[0]: int(r[1]) for r in df.select("term", w.cast("long")).collect()}


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 10, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``k`` documents of the highest score above 0, equal scores by rising id."""
    spark = docs.sparkSession
    tune(spark)
    s = Scratch(spark, "lexical")
    q = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    kind = q.schema["item_id"].dataType
    q = s.saved(q.mapInArrow(_item_terms, f"item_id {kind.simpleString()}, terms array<binary>, times array<long>"), "items")
    total = q.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], f"block long, item long, item_id {kind.simpleString()}, doc_id long, score long")
    for block in range(blocks):
        own = q.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)).collect()
        numbers = {t: k + 1 for k, t in enumerate(dict.fromkeys(bytes(t) for r in own for t in r.terms))}
        forward = s.saved(d.mapInArrow(partial(_forward, numbers=numbers), "doc_id long, n long, terms array<int>, tfs array<long>"), "forward")
        n, length = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            break
        weight = _weights(s, forward, n)
        work = []
        for r in own:
            held = [(numbers[bytes(t)], c) for t, c in zip(r.terms, r.times) if weight.get(numbers[bytes(t)])]
            work.append((r.item_id, [t for t, _ in held], [c * weight[t] for t, c in held]))
        m = F.expr(f"25 + (75 * n * {n}L) div {length}L")
        got = forward.where("doc_id is not null and size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs")
        got = got.mapInArrow(partial(_search, items=work, kind=to_arrow_type(kind), k=k), f"item long, item_id {kind.simpleString()}, doc_id long, score long")
        found = found.unionByName(s.saved(got.withColumn("block", F.lit(block).cast("long")), "found", stays=True))
    s.close()
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
