"""Weakly supervised quality rules against a plain version, with the odd rows of a table."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import weak_rules

SCHEMA = "doc_id long, text string, n_words long, votes string, kept string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    letters = sum(c.isalpha() for w in words for c in w)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines), len(set(words)), letters, sum(any(c.isalpha() for c in w) for w in words), sum(c in ".!?" for c in text))


def plain_model(votes, rounds):
    n, share = len(votes[0]), weak_rules.SHARE
    good, bad, s = [weak_rules.RIGHT_GOOD] * n, [weak_rules.RIGHT_BAD] * n, weak_rules.PRIOR_TEXTS

    def posterior(v):
        x = math.log(share / (1 - share))
        for k in range(n):
            x += math.log(good[k] / (1 - bad[k])) if v[k] == 1 else math.log((1 - good[k]) / bad[k]) if v[k] == -1 else 0
        return 1 / (1 + math.exp(-x))

    for _ in range(rounds):
        q = [posterior(v) for v in votes]
        mass = lambda k, x, of: sum(of(p) for v, p in zip(votes, q) if v[k] == x)
        yes, no = (lambda p: p), (lambda p: 1 - p)
        share = (sum(q) + s * weak_rules.SHARE) / (len(q) + s)
        good = [(mass(k, 1, yes) + s * weak_rules.RIGHT_GOOD) / (mass(k, 1, yes) + mass(k, -1, yes) + s) for k in range(n)]
        bad = [max((mass(k, -1, no) + s * weak_rules.RIGHT_BAD) / (mass(k, 1, no) + mass(k, -1, no) + s), 1 - good[k]) for k in range(n)]
    return share, good, bad, posterior


def sample():
    random.seed(12)
    line = " ".join(f"w{k}" for k in range(9))
    texts = [" ".join(random.choices(["alpha", "beta.", "gamma", "%%", "|", "42", "é", "\n", "\t", "  ", "\x0b", "\xa0", line + "\n"], k=random.randint(0, 60))) for _ in range(150)]
    return texts + ["", None, " \n\t", "one two three four five six seven eight", "a " * 9, ("x y z w " * 40_000).strip(), line + "\n" + line, "long-" * 200_000, "ends\r\nends\r\nends"]


def test_counts_votes_and_verdicts_equal_the_plain_version(spark):
    texts = sample()
    rows = [(k, t, 1, "v", "k") for k, t in enumerate(texts)] + [(None, "no id", 1, "v", "k"), (0, texts[0], 1, "v", "k"), (0, "another text of the same id", 1, "v", "k")]
    got = weak_rules.judged(spark.createDataFrame(rows, SCHEMA), rounds=20)
    assert not any("Python" in x for x in got._jdf.queryExecution().toString().splitlines())
    got = got.collect()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], *plain_counts(r[1])) for r in rows)
    assert collections.Counter((r.doc_id, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_lettered", "n_ends")]) for r in got) == want
    *_, posterior = plain_model([list(r.votes) for r in got], 20)
    for r in got:
        assert r.posterior == pytest.approx(posterior(r.votes), abs=1e-9)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_model_finds_accuracies_of_rules_that_fail_apart(spark):
    random.seed(3)
    rows = []
    for k in range(4000):
        good = random.random() < 0.8
        vote = [0 if random.random() < 0.2 else (1 if random.random() < (0.97 if good else 0.4) else -1) for _ in range(6)]
        rows.append((good, vote))
    d = spark.createDataFrame(rows, "good boolean, votes array<int>")
    m = weak_rules.fit(d, rules=6, rounds=80).first()
    assert abs(m.share - 0.8) < 0.05
    assert all(abs(x - 0.97) < 0.03 for x in m.good) and all(abs(x - 0.6) < 0.1 for x in m.bad)
    worse = spark.createDataFrame([([1, 1, -1],)] * 50 + [([-1, -1, 1],)] * 50, "votes array<int>")
    m = weak_rules.fit(worse, rules=3).first()
    assert all(g + b >= 1 - 1e-12 for g, b in zip(m.good, m.bad))


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    d = weak_rules.judged(docs).join(labels, "doc_id").where("not base_failed")
    r = d.agg(F.count_if((F.col("quality") == 1) & F.col("kept")).alias("kept"), F.count_if(F.col("quality") == 1).alias("clean"), F.count_if((F.col("quality") == 0) & ~F.col("kept")).alias("gone"), F.count_if(F.col("quality") == 0).alias("junk")).first()
    assert r.kept >= 0.99 * r.clean and r.gone >= 0.9 * r.junk


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert weak_rules.judged(none).count() == 0
