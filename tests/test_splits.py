"""Group splits against the plain greedy choice."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from strandloom.operators import splits


def plain(histogram, train, test):
    a = b = 0
    out = {k: 0 for k in histogram}
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            if a * test <= b * train:
                a, out[size] = a + size, out[size] + 1
            else:
                b += size
    while a < train and out.get(1, 0) < histogram.get(1, 0):
        a, out[1] = a + 1, out[1] + 1
    while a > train and out.get(1, 0):
        a, out[1] = a - 1, out[1] - 1
    return out


def test_sizes_are_dealt_as_group_by_group():
    random.seed(1)
    for _ in range(3000):
        h = {random.choice([1, 2, 3, 5, 8, 40, 300]): random.randint(1, random.choice([2, 9, 60])) for _ in range(random.randint(1, 5))}
        total = sum(k * n for k, n in h.items())
        train = int(total * random.choice([0.5, 0.8, 0.9, 0.37]))
        if 0 < train < total:
            assert splits.deal_sizes(h, train, total - train) == plain(h, train, total - train)
    assert sum(splits.deal_sizes({1: 10**12}, 8 * 10**11, 2 * 10**11).values()) == 8 * 10**11


def test_whole_groups_go_to_one_side(spark):
    sizes = {"big": 30, None: 11, "b": 11, "c": 7, **{f"one{k}": 1 for k in range(20)}, **{f"two{k}": 2 for k in range(6)}}
    rows = [(g, k) for g, n in sizes.items() for k in range(n)]
    d = splits.group_aware_split(spark.createDataFrame(rows, "scaffold string, split_at long"))
    got = d.collect()
    side = {r.scaffold: r.split for r in got}
    assert len(got) == len(rows) and len({(r.scaffold, r.split) for r in got}) == len(sizes)
    want = plain(Counter(sizes.values()), int(0.8 * len(rows)), len(rows) - int(0.8 * len(rows)))
    assert Counter(n for g, n in sizes.items() if side[g] == "train") == Counter({k: v for k, v in want.items() if v})
    r = splits.split_diagnostics(d).first()
    assert (r.rows, r.shared_groups, r.train_share) == (len(rows), 0, pytest.approx(int(0.8 * len(rows)) / len(rows)))
    assert r.test_single_share == pytest.approx((20 - want[1]) / (len(rows) - int(0.8 * len(rows))))


def test_splits_that_cannot_be_made(spark):
    one = spark.createDataFrame([("a",)] * 9, "scaffold string")
    with pytest.raises(ValueError):
        splits.group_aware_split(one)
    with pytest.raises(ValueError):
        splits.group_aware_split(spark.createDataFrame([("a",), ("b",)], "scaffold string"), test=0.9)
    with pytest.raises(ValueError):
        splits.group_aware_split(spark.createDataFrame([("a",)] * 8 + [("b",), ("c",)], "scaffold string"))
