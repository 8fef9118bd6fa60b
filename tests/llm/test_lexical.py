"""Exact lexical search against brute force, with the odd rows of a table."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from strandloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, n long, terms string, m string, score long"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        score = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * count) // length
            s = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if s > 0 and i is not None:
                score.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


def test_terms_in_pieces():
    text = "Ab1 éÀ x_y-Z\0" * 50 + "w" * 100 + "  ÄB"
    want = [t.encode() for t in terms(text)]
    for most in (5, 16, 1 << 22):
        assert [t for p in lexical.term_pieces(text, most) for t in p] == want
    assert list(lexical.term_pieces(None)) == []


def test_search_equals_brute_force(spark):
    random.seed(11)
    words = [f"w{int(random.paretovariate(0.7)) % 400}" for _ in range(6000)] + ["É", "straße", "UPPER", " x"]
    docs = [(k, " ".join(random.choices(words, k=random.randint(0, 60)))) for k in range(500)]
    docs += [(501, docs[3][1]), (3, docs[3][1]), (3, "w1 w2 w3"), (None, "w1 w2 w5 w7"), (502, None), (503, "..."), (504, "w1 " * 120_000), (505, "\x7f[]")]
    items = [(k, " ".join(random.choices(words, k=random.randint(1, 25)))) for k in range(30)] + [(100, None), (101, "?!"), (102, "nowhere"), (103, "w1 w1 w1 upper É"), (103, "w1 w1 w1 upper É")]
    d = spark.createDataFrame([(i, t, 1, "t", "m", 2) for i, t in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(d, q).collect())
    assert got == brute(docs, items[:-1], 10)
    some = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(d, q, k=3, block_terms=60).collect())
    assert some == brute(docs, items[:-1], 3)


def test_ties_go_by_id_and_items_may_be_named_by_strings(spark):
    d = spark.createDataFrame([(k, "same words here", 1, "", "", 0) for k in range(40, 0, -1)] + [(99, "other", 1, "", "", 0)], SCHEMA)
    q = spark.createDataFrame([("a", "same words"), ("b", "words"), (None, "here")], "item_id string, text string")
    got = lexical.ranked(d, q).collect()
    assert {(r.item_id, r["rank"], r.doc_id) for r in got} == {(i, k, k) for i in ("a", "b", None) for k in range(1, 11)}


def test_empty_tables(spark):
    docs, q = spark.createDataFrame([(1, "a b", 1, "", "", 0)], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), q).count() == 0
    assert lexical.ranked(docs, q.limit(0)).count() == 0


def test_bounds_stop_reading_and_shards_agree(monkeypatch):
    rng = np.random.default_rng(4)
    size, lists = 20_000, 8
    held = rng.random((lists, size)) < 0.5
    impact = np.where(held, np.minimum(rng.pareto(1.2, (lists, size)) * 1000, 90_000).astype(np.int64) + 1, 0)
    impact[:, :12] = rng.integers(900_000, 1_000_000, (lists, 12))  # a document that a list lacks would have it read to its end
    t, d = np.nonzero(impact)
    ids = rng.permutation(size).astype(np.int64) * 3
    weights = [int(x) for x in rng.integers(1, 50, lists)]
    score = np.array(weights) @ impact
    want = np.lexsort((ids, -score))[:10]
    shard = lexical.Shard(ids, d, t, impact[t, d])
    got, scores, read = shard.best([*range(lists), 77], [*weights, 5], 10, 1)
    assert got.tolist() == ids[want].tolist() and scores.tolist() == score[want].tolist()
    assert read < len(t) / 20
    assert shard.best([0], [1], 10, 10**15)[2] == 0

    docs = rng.integers(0, 5, 4000)
    n = rng.integers(0, 6, 4000)
    rows = [(int(i), 100, sorted(rng.choice(9, int(c), replace=False).tolist()), rng.integers(1, 9, int(c)).tolist()) for i, c in zip(docs, n)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "m", "terms", "tfs"])
    items = [(7, [1, 2, 3], [10, 20, 5]), (8, [4], [3]), (9, [50], [1])]
    one = [b.to_pydict() for b in lexical._search([batch], items, pa.int64(), 10)]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    many = [b.to_pydict() for b in lexical._search([batch], items, pa.int64(), 10)]
    assert one == many and len(one[0]["item"]) == 20
