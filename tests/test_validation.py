"""Held-out batches and folds against fits made one by one."""

from __future__ import annotations

import hashlib
import itertools
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandloom.operators import stats, validation


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])) if len(pos) and len(neg) else None


def test_each_batch_is_ranked_by_a_model_that_never_saw_it(spark):
    rng = np.random.default_rng(0)
    batch = np.repeat(["a", "b", "c", "d"], [40, 50, 30, 20])
    y = (rng.random(140) < 0.5).astype(int)
    y[batch == "d"] = 1
    x = rng.normal(size=(140, 3)) + y[:, None] * [0.8, 0.1, 0] + 1000.0
    rows = [(str(b), int(t), *map(float, v)) for b, t, v in zip(batch, y, x)]
    d = spark.createDataFrame(rows + [("a", None, 1.0, 2.0, 3.0), (None, 1, 1.0, 2.0, 3.0), ("a", 1, None, 2.0, 3.0)], "batch string, label int, p double, q double, r double")
    got = {r.held_out_batch: r for r in validation.leave_one_batch_out(d, features=["p", "q", "r"]).collect()}
    score = np.empty(140)
    for b in "abcd":
        train = batch != b
        w = np.linalg.lstsq(np.c_[np.ones(train.sum()), x[train]], y[train], rcond=None)[0]
        score[~train] = np.c_[np.ones((~train).sum()), x[~train]] @ w
        r = got[b]
        assert r.n == (~train).sum() and r.pooled_auc == pytest.approx(got["a"].pooled_auc)
        want = auc(y[~train], score[~train])
        assert r.auc == (pytest.approx(want) if want is not None else None)
        assert r.note == ("AUC undefined: one class in this batch" if b == "d" else "")
    assert got["a"].pooled_auc == pytest.approx(auc(y, score))


def test_a_batch_whose_training_rows_hold_one_class_is_skipped(spark):
    rows = [("mixed", k % 2, float(k)) for k in range(20)] + [("cases", 1, float(k)) for k in range(10)]
    d = spark.createDataFrame(rows, "batch string, label int, x double")
    got = {r.held_out_batch: r for r in validation.leave_one_batch_out(d, features=["x"]).collect()}
    assert (got["mixed"].auc, got["mixed"].note) == (None, "skipped: training batches hold one class")
    assert (got["cases"].auc, got["cases"].note, got["cases"].pooled_auc) == (None, "AUC undefined: one class in this batch", None)
    assert validation.leave_one_batch_out(d.limit(0), features=["x"]).count() == 0


def test_features_are_chosen_without_the_fold(spark):
    rng = np.random.default_rng(7)
    unit = rng.integers(0, 25, 120)
    y = (unit % 2 == 0).astype(int)
    x = rng.normal(size=(120, 12)) + 0.6 * y[:, None] * (np.arange(12) < 2)
    rows = [(f"u{u}", i, int(t), f"f{j:02d}", float(v)) for i, (u, t, row) in enumerate(zip(unit, y, x)) for j, v in enumerate(row)]
    d = spark.createDataFrame(rows, "patient string, sample long, label int, feature string, x double")
    got = {r.fold: r for r in validation.grouped_cv_auc(d, folds=3, top=4).collect()}
    fold = np.array([int(hashlib.md5(f"1:u{u}".encode()).hexdigest()[:8], 16) % 3 for u in unit])
    for f in range(3):
        a, b = x[(fold != f) & (y == 1)], x[(fold != f) & (y == 0)]
        t = (a.mean(0) - b.mean(0)) / np.sqrt(a.var(0, ddof=1) / len(a) + b.var(0, ddof=1) / len(b))
        best = np.argsort(-np.abs(t), kind="stable")[:4]
        s = (x[fold == f][:, best] * np.sign(t[best])).mean(1)
        assert got[f].n == (fold == f).sum() and got[f].roc_auc == pytest.approx(auc(y[fold == f], s))


def test_areas_of_groups_run_through_buckets(spark, monkeypatch):
    monkeypatch.setattr(stats, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(2)
    g, y, s = rng.integers(0, 3, 600), rng.integers(0, 2, 600), rng.integers(0, 300, 600) / 7
    d = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, y, s)], "g int, label int, score double")
    for r in stats.binned_auc(d, by=["g"]).collect():
        assert r.roc_auc == pytest.approx(auc(y[g == r.g], s[g == r.g]))


def fold_of(unit, folds):
    return int(hashlib.md5(f"1:{unit}".encode()).hexdigest()[:8], 16) % folds


def test_scores_equal_as_numbers_are_ties(spark):
    rng = np.random.default_rng(3)
    unit, x = rng.integers(0, 20, 400), rng.integers(2, 9, (400, 5))
    y = (rng.random(400) < 0.4).astype(int)
    x[:, 0] += y
    rows = [(f"u{u}", i, int(t), f"f{j}", int(v)) for i, (u, t, row) in enumerate(zip(unit, y, x)) for j, v in enumerate(row)]
    d = spark.createDataFrame(rows, "patient string, sample long, label int, feature string, n long").withColumn("x", F.log("n"))
    got = {r.fold: r for r in validation.grouped_cv_auc(d.repartition(4, F.rand(1)), folds=3, top=4).collect()}
    fold, v = np.array([fold_of(f"u{u}", 3) for u in unit]), np.log(x)
    for f in range(3):
        a, b = v[(fold != f) & (y == 1)], v[(fold != f) & (y == 0)]
        t = (a.mean(0) - b.mean(0)) / np.sqrt(a.var(0, ddof=1) / len(a) + b.var(0, ddof=1) / len(b))
        best = np.argsort(-np.abs(t))[:4]
        score = [np.prod([Fraction(int(x[i, j])) ** int(np.sign(t[j])) for j in best]) for i in range(400)]  # the exponential of four times the mean
        steps = [(sum(y[i] for i in s), len(s)) for s in ([*g] for _, g in itertools.groupby(sorted(np.flatnonzero(fold == f), key=lambda i: score[i], reverse=True), key=lambda i: score[i]))]
        pos, n = int(sum(tp for tp, _ in steps)), int(sum(k for _, k in steps))
        assert len(steps) < n - 10 and got[f].n == n
        roc = pr = ctp = seen = 0
        for tp, k in steps:
            before = Fraction(int(ctp), seen) if seen else 1
            ctp, seen = ctp + int(tp), seen + k
            roc += (k - int(tp)) * (ctp - Fraction(int(tp), 2))
            pr += Fraction(int(tp), pos) * (Fraction(ctp, seen) + before) / 2
        assert got[f].roc_auc == pytest.approx(float(roc / (pos * (n - pos))), abs=1e-12)
        assert got[f].pr_auc == pytest.approx(float(pr), abs=1e-12)


def test_features_without_spread_are_not_chosen(spark):
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 12, 90)
    y = (rng.random(90) < 0.5).astype(int)
    shift = 1e9 + 0.01 * (rng.normal(size=90) + 1.5 * y)  # its spread is lost in sums of squares
    flat = np.where(y == 1, 0.1, 0.3)
    noise = rng.normal(size=90)
    rows = [(f"u{u}" if u else None, i, int(t), f, float(v[i])) for i, (u, t) in enumerate(zip(unit, y)) for f, v in (("flat", flat), ("noise", noise), ("shift", shift))]
    rows += [("u1", 0, 1, "rare", 5.0), ("u2", 1, 0, "rare", 1.0), ("u3", 2, 0, "endless", float("inf"))]
    d = spark.createDataFrame(rows, "patient string, sample long, label int, feature string, x double")
    got = {r.fold: r for r in validation.grouped_cv_auc(d, folds=2, top=1).collect()}
    fold = np.array([fold_of(f"u{u}", 2) if u else -1 for u in unit])  # samples of no known patient are in no fold
    for f in range(2):
        assert got[f].n == (fold == f).sum() and got[f].roc_auc == pytest.approx(auc(y[fold == f], shift[fold == f]))


def test_features_of_equal_t_go_by_name(spark):
    rng = np.random.default_rng(8)
    unit, y = rng.integers(0, 15, 300), rng.integers(0, 2, 300)
    fold = np.array([fold_of(f"u{u}", 2) for u in unit])
    x = rng.random(300) + 0.3 * y
    others = [np.where(fold == 0, 1 - x, 3 * x) * k / 7 for k in range(1, 10)]  # as far apart as x in either fold, with the other sign in one
    rows = [(f"u{u}", i, int(t), f"f{j}", float(v[i])) for i, (u, t) in enumerate(zip(unit, y)) for j, v in enumerate([x, *others])]
    d = spark.createDataFrame(rows, "patient string, sample long, label int, feature string, x double")
    got = {r.fold: r for r in validation.grouped_cv_auc(d.repartition(4, F.rand(2)), folds=2, top=1).collect()}
    for f in range(2):
        assert got[f].roc_auc == pytest.approx(auc(y[fold == f], x[fold == f]))


@pytest.mark.parametrize("by", [["g"], None])
def test_chains_of_ties_cross_buckets(spark, monkeypatch, by):
    monkeypatch.setattr(stats, "BUCKET_ROWS", 9)
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), 0.6) for g, v in zip(rng.integers(0, 3, 300), rng.integers(0, 400, 300))] + [(0, float("-inf"), float("inf")), (0, float("inf"), float("inf")), (0, None, None)]
    d = spark.createDataFrame(rows, "g int, v double, e double").withColumn("was", F.col("v"))
    got = sorted((r.g if by else 0, r.was, r.v) for r in stats.joined_ties(d, "v", "e", by=by).collect() if r.was is not None)
    assert len(got) == 302
    for (g, was, v), (h, then, w) in itertools.pairwise(got):
        assert w == (v if g == h and then - was <= 1.2 else then)
    assert got[0][1] == got[0][2]
