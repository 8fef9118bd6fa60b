"""Joint counts by blocks of columns, draws by buckets, choices in rounds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import matrix, sequences


def test_joint_counts_by_blocks_equal_pairs_of_columns(spark):
    random.seed(9)
    seqs = ["".join(random.choice("ACGT-.é") for _ in range(random.randint(0, 12))) for _ in range(60)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").repartition(3)
    want = Counter()
    for s in seqs:
        s = (s or "").upper().replace(".", "-")
        want.update((i, j, s[i], s[j]) for i in range(len(s)) for j in range(i + 1, len(s)) if "-" not in (s[i], s[j]))
    for cells in (4096, 11):  # one block, and blocks of two columns
        assert {(r.i, r.j, r.ri, r.rj): r.k for r in sequences.joint_counts(d, cells=cells).collect()} == want
    one, many = ({(r.i, r.j): (r.n, round(r.mi, 9), round(r.mi_apc, 9)) for r in sequences.mutual_information_apc(d, least_rows=3, cells=c).collect()} for c in (4096, 11))
    assert one == many and one
    assert sequences.joint_counts(d.where("seq = ''")).count() == 0


def test_draws_by_buckets_are_one_draw_without_replacement(spark):
    counts = {f"f{k:03d}": 1 + (k * 7) % 30 for k in range(200)}
    rows = [(f"s{s}", f, n) for s in range(60) for f, n in counts.items()] + [("shallow", "f000", 5), ("exact", "f000", 300), ("exact", "f001", 200)]
    d = spark.createDataFrame(rows, "sample string, feature string, n long")
    total, depth = sum(counts.values()), 500
    for size in (1_000, 20):
        got = matrix.rarefy(d, depth=depth, bucket_features=size)
        t = {r["sample"]: r.t for r in got.groupBy("sample").agg(F.sum("n").alias("t")).collect()}
        assert t == {f"s{s}": depth for s in range(60)} | {"exact": depth}
        assert got.join(d.withColumnRenamed("n", "had"), ["sample", "feature"]).where("n > had or n <= 0").count() == 0
        mean = {r.feature: r.m / 60 for r in got.where("sample like 's%'").groupBy("feature").agg(F.sum("n").alias("m")).collect()}
        for f, n in counts.items():
            p = n / total
            sd = (depth * p * (1 - p) * (total - depth) / (total - 1) / 60) ** 0.5
            assert abs(mean.get(f, 0) - depth * p) < 5 * sd
        again = matrix.rarefy(d.repartition(5), depth=depth, bucket_features=size)
        assert got.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        matrix.rarefy(spark.createDataFrame([("s", "f", 10**9)], "sample string, feature string, n long"), depth=5)


def test_spaced_choices_are_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(a), round(float(s), 1), int(k)) for k, (g, a, s) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 90, 200), rng.random(200)))]
    got = sequences.spaced_top_k(spark.createDataFrame([*rows, (9, 5, None, 999)], "gene long, start long, score double, k long"), k=3, spacing=7).collect()
    for g in range(4):
        kept = []
        for _, a, s, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(kept) < 3 and all(abs(a - b) >= 7 for b, _ in kept):
                kept.append((a, s))
        assert sorted((r.start, r.score) for r in got if r.gene == g) == sorted(kept)
    assert [r.k for r in got if r.gene == 9] == [999]
    assert sequences.spaced_top_k(spark.createDataFrame([], "gene long, start long, score double")).count() == 0
