"""Exact quantiles of long columns, kernel sums by cells, and filters that must refuse some tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import cells, proteins, stats


def test_quantiles_equal_percentile_on_ties_and_tails(spark):
    random.seed(8)
    tables = {
        "smooth": [random.gauss(0, 1) for _ in range(3000)],
        "ties": [float(random.choice([1, 1, 1, 2, 5])) for _ in range(3000)],
        "two values": [0.0] * 1500 + [1.0] * 1500,
        "tails": [math.copysign(10.0 ** random.uniform(-300, 300), random.random() - 0.5) for _ in range(3000)],
        "one": [4.5],
        "nan": [float("nan"), 1.0, 2.0, 3.0] * 200,
    }
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for name, values in tables.items():
        d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        want = d.agg(F.percentile("v", F.array(*[F.lit(q) for q in shares]))).first()[0]
        for how in ({}, {"few": 5, "accuracy": 20}):
            got = stats.quantiles(d, "v", shares, **how)
            assert all(g == w or (math.isnan(g) and math.isnan(w)) for g, w in zip(got, want)), (name, got, want)
    assert stats.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_bucket_numbers_are_found_by_search(spark):
    cuts = sorted({round(random.Random(k).uniform(-5, 5), 3) for k in range(300)})
    d = spark.createDataFrame([(-9.0,), (9.0,), (cuts[0],), (cuts[-1],), (cuts[17],), (0.0,), (None,)], "v double")
    for some in ([], cuts[:1], cuts[:2], cuts):
        for r in d.select("v", stats._number(F.col("v"), some).alias("k")).collect():
            assert r.k == sum(r.v is not None and c < r.v for c in some)


def test_posterior_errors_equal_the_sum_over_all_pairs(spark):
    random.seed(5)
    rows = [(k, random.choice([random.gauss(2, 1.5), random.gauss(-40, 0.01), 1e6]), random.choice(["DECOY_A", "B"])) for k in range(400)] + [(900, None, "B"), (901, float("nan"), "B"), (902, 55.0, "rev_x")]
    d = spark.createDataFrame(rows, "psm long, score double, protein string")
    known = [(s, p.lower().startswith(("decoy_", "rev_", "xxx_"))) for _, s, p in rows if s is not None and not math.isnan(s)]
    for block in (50_000, 7):
        got = {r.psm: r.pep for r in proteins.posterior_error(d, block=block).collect()}
        assert len(got) == len(rows) and got[900] is None and got[901] is None and got[902] == 1.0
        for k, s, _ in rows[:400]:
            w = [(math.exp(-((s - t) ** 2) / (2 * 0.3**2)), decoy) for t, decoy in known]
            want = min(1.0, sum(x for x, y in w if y) / max(sum(x for x, y in w if not y), 1e-9))
            assert got[k] == pytest.approx(want, abs=1e-9)
    assert proteins.posterior_error(d.where("score is null")).first().pep is None


def test_a_separate_search_needs_decoys_and_one_row_per_scan(spark):
    t = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 1.0)], "scan long, score double")
    d = spark.createDataFrame([(1, 4.5), (2, 2.0)], "scan long, score double")
    got = {r.scan: (r.pi0, r.q) for r in proteins.separate_search_q(t, d).collect()}
    assert got == {1: (pytest.approx(2 / 3), 0.0), 2: (pytest.approx(2 / 3), pytest.approx(1 / 3)), 3: (pytest.approx(2 / 3), pytest.approx(4 / 9))}
    for a, b in ((t, d.limit(0)), (t.union(t), d), (t, d.union(d))):
        with pytest.raises(ValueError):
            proteins.separate_search_q(a, b)


def test_mad_filters_refuse_flat_metrics_and_great_losses(spark):
    d = spark.createDataFrame([(k, float(k % 7), 1.0 if k else 2.0, "a") for k in range(40)] + [(99, 50.0, 1.0, "a")], "cell long, x double, flat double, donor string")
    got = {r.cell: (r.mad, r.outlier) for r in cells.mad_outliers(d, metric="x").collect()}
    assert got[99] == (2.0, True) and not any(o for k, (_, o) in got.items() if k != 99)
    assert got == {r.cell: (r.mad, r.outlier) for r in cells.mad_outliers(d, metric="x", by=["donor"]).collect()}
    assert sorted(r.cell for r in cells.mad_filter(d, metrics={"x": 5.0}, hard=F.col("cell") == 3).collect()) == [k for k in range(40) if k != 3]
    with pytest.raises(ValueError):
        cells.mad_outliers(d, metric="flat")
    with pytest.raises(ValueError):
        cells.mad_filter(d, metrics={"x": 0.5})


def test_filter_cells_genes_in_the_order_of_the_source(spark):
    # cells 1 to 3 have gene 1, of them cell 3 has too many genes in the end; gene 2 is in two cells only
    rows = [(c, 1, 5) for c in (1, 2, 3)] + [(c, 2, 5) for c in (1, 2)] + [(c, 3, 5) for c in (1, 2, 3)] + [(3, g, 1) for g in range(10, 14)] + [(4, 1, 9)]
    d = spark.createDataFrame(rows, "cell long, gene long, n long")
    got = cells.filter_cells_genes(d, mito=F.col("gene") == 99, min_genes=2, max_genes=6, min_cells=3).collect()
    assert sorted((r.cell, r.gene) for r in got) == [(1, 1), (1, 3), (2, 1), (2, 3)]
