"""Operators held against plain versions on small tables."""

from __future__ import annotations

import numpy as np
import pytest

from strandloom.functions import tails
from strandloom.operators import cells as ce
from strandloom.operators import gwas as gw
from strandloom.operators import matrix as mx
from strandloom.operators import proteins as pr
from strandloom.operators import reads as rd
from strandloom.operators import stats as st


def test_components_of_samples_by_plain_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(30, (40, 7))
    x[3, 2] = 0
    rows = [(f, f"s{s}", int(x[f, s])) for f in range(40) for s in range(7) if x[f, s]]
    d = spark.createDataFrame(rows, "feature long, sample string, n long").repartition(5)
    got = {(r.sample, r.pc): r for r in mx.sample_scores(d, components=3).collect()}
    a = np.log10(x + 1.0).T
    a -= a.mean(axis=0)
    u, sv, _ = np.linalg.svd(a, full_matrices=False)
    for k in range(3):
        want = u[:, k] * sv[k]
        want *= np.sign(want[np.abs(want).argmax()])
        assert np.allclose([got[f"s{i}", k + 1].score for i in range(7)], want, atol=1e-8)
        assert got["s0", k + 1].explained == pytest.approx(sv[k] ** 2 / (sv**2).sum())


def test_components_without_the_samples_matrix_equal_the_dense_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(np.exp(2 + rng.normal(size=(60, 3)) @ rng.normal(size=(3, 90)) * 0.4))
    d = spark.createDataFrame([(f, f"s{s:02d}", int(x[f, s])) for f in range(60) for s in range(90) if x[f, s]], "feature long, sample string, n long").repartition(3)
    dense, free = ({(r.sample, r.pc): (r.score, r.explained) for r in mx.sample_scores(d, components=4, dense_samples=k).collect()} for k in (2_000, 10))
    assert set(dense) == set(free) and len(free) == 360
    for k, (score, share) in dense.items():
        assert free[k] == (pytest.approx(score, abs=1e-6), pytest.approx(share, abs=1e-9))


def test_one_way_f_and_t2(spark):
    v = [1.0, 2.0, 4.0, 6.0, 7.0, 9.5]
    s = spark.createDataFrame([(i, 1, x) for i, x in enumerate(v)], "sample long, pc int, score double")
    f = spark.createDataFrame([(i, i // 2, 0) for i in range(6)], "sample long, batch long, condition long")
    got = {r.factor: r for r in mx.pca_batch_diagnostic(s, f).collect()}
    g = np.array(v).reshape(3, 2)
    between, within = 2 * ((g.mean(1) - g.mean()) ** 2).sum() / 2, ((g - g.mean(1)[:, None]) ** 2).sum() / 3
    assert got["batch"].f == pytest.approx(between / within)
    assert got["batch"].p == pytest.approx((1 + 2 * between / within / 3) ** -1.5)  # F with 2 and 3 degrees
    assert got["condition"].f is None and got["condition"].p is None
    t = {r.sample: r for r in mx.hotelling_t2(s).collect()}
    assert t[5].t2 == pytest.approx(9.5**2 / (sum(x * x for x in v) / 5))
    assert t[5].crit == pytest.approx(6.607891, rel=1e-5)  # (n - 1) / (n - 1) times F at 1 and 5 degrees
    assert not t[5].outlier
    assert tails.f_sf(tails.f_quantile(0.95, 3, 8), 3, 8) == pytest.approx(0.05)


def test_empty_scores_have_no_outliers(spark):
    s = spark.createDataFrame([], "sample long, pc int, score double")
    assert mx.hotelling_t2(s).count() == 0
    assert mx.pca_batch_diagnostic(s, spark.createDataFrame([], "sample long, batch long, condition long")).count() == 0


def test_peaks_are_matched_greedily_one_to_one(spark):
    # q1 and q2 both prefer l1; the second takes l2, which no choice of each peak's best alone would give
    q = [("q", 100.000, 10.0), ("q", 100.005, 9.0)] + [("q", 200.0 + i, 5.0) for i in range(5)]
    x = [("l", 100.003, 10.0), ("l", 100.008, 1.0)] + [("l", 200.0 + i, 5.0) for i in range(5)]
    cols = "spectrum string, mz double, intensity double"
    r = pr.match_spectra(spark.createDataFrame(q, cols), spark.createDataFrame(x, cols)).collect()
    assert len(r) == 1 and r[0].peaks == 7
    w = 100 + 9 + 5 * 25
    assert r[0].score == pytest.approx(w / np.sqrt(100 + 81 + 125) / np.sqrt(100 + 1 + 125))
    few = pr.match_spectra(spark.createDataFrame(q[:5], cols), spark.createDataFrame(x, cols))
    assert few.count() == 0


def test_clumps_in_order_of_p(spark):
    import random

    random.seed(3)
    p = {(l, s): random.random() for l in "ab" for s in range(30)}
    pairs = [(i, j, random.random()) for i in range(30) for j in range(i + 1, 30) if random.random() < 0.2]
    df = spark.createDataFrame([(l, s, x) for (l, s), x in p.items()] + [("c", 1, None), ("c", 2, 0.9)], "locus string, snp long, p double")
    ld = spark.createDataFrame([*pairs, (1, 2, 0.99)], "snp_a long, snp_b long, r2 double")
    near = {}
    for i, j, r in [*pairs, (1, 2, 0.99)]:
        if r >= 0.5:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    want = {("c", 2)}
    for l in "ab":
        gone = set()
        for s in sorted(range(30), key=lambda s: p[l, s]):
            if s not in gone:
                want.add((l, s))
                gone |= near.get(s, set())
    assert {(r.locus, r.snp) for r in gw.ld_clump(df, ld, r2=0.5).collect()} == want


def test_ld_across_bins(spark):
    import random

    random.seed(4)
    pos = {s: random.randrange(5000) for s in range(12)}
    g = [("x", s, pos[s], i, random.randrange(3)) for s in range(12) for i in range(20)]
    got = {(r.snp_a, r.snp_b): r.r2 for r in gw.ld_pairs(spark.createDataFrame(g, "locus string, snp long, pos long, sample long, dosage long"), window=1000).collect()}
    d = {s: [x[4] for x in g if x[1] == s] for s in pos}
    want = {(a, b): np.corrcoef(d[a], d[b])[0, 1] ** 2 for a in pos for b in pos if a < b and abs(pos[a] - pos[b]) <= 1000}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_left_censored_values(spark):
    rows = [("f", s, float(s)) for s in range(1, 11)] + [("f", 11, None), ("g", 1, 3.0), ("g", 2, None)]
    d = spark.createDataFrame(rows, "feature string, sample long, x double")
    a, b = ({(r.feature, r.sample): r.imputed for r in mx.impute_left_censored(d.repartition(k)).collect()} for k in (1, 4))
    assert a == b and a["f", 3] == 3.0
    assert abs(a["f", 11] - 1.09) < 5 * 0.1 * np.std(range(1, 11), ddof=1) and a["f", 11] >= 0.0
    assert a["g", 2] == 3.0


def test_combined_p(spark):
    d = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.02), ("b", 1, 0.5), ("b", 2, 1e-30)], "gene string, animal long, p double")
    r = {x.gene: x for x in st.stouffer_meta(d).collect()}
    assert r["a"].meta_z == pytest.approx((2.3263479 + 2.0537489) / 2**0.5, abs=1e-6)
    assert r["b"].meta_z == pytest.approx(6.3613409 / 2**0.5, abs=1e-6)
    assert (r["a"].n_nominal, r["b"].n_nominal) == (2, 1)


def test_doses_that_lack_an_effect(spark):
    rows = [("a", d, x, 0.01) for d, x in ((1, 1.0), (2, 2.0), (3, 3.0))] + [("b", 1, 1.0, 0.01), ("b", 3, 2.0, 0.01)] + [("c", 1, -3.0, 0.5), ("c", 2, -2.0, 0.5), ("c", 3, -4.0, 0.01)]
    r = {x.gene: x.monotonic for x in mx.dose_consistent(spark.createDataFrame(rows, "gene string, dose long, effect double, fdr double")).collect()}
    assert r == {"a": True, "c": False}


def test_marker_shares(spark):
    t = "label string, cell long, gene string"
    ref = spark.createDataFrame([("x", c, "g") for c in range(10)] + [("x", c, "other") for c in range(10)], t)
    query = spark.createDataFrame([("x", c, "g" if c < 5 else "other") for c in range(20)] + [("Unknown", 99, "g"), ("y", 1, "g")], t)
    markers = spark.createDataFrame([("x", "g"), ("x", "absent")], "label string, gene string")
    r = {x.label: x for x in ce.label_marker_check(ref, query, markers).collect()}
    assert set(r) == {"x", "y"}
    assert r["x"].retained == pytest.approx(0.25) and r["x"].status == "flagged"
    assert r["y"].retained is None and r["y"].status == "skipped: no markers"


def test_y_ions(spark):
    d = spark.createDataFrame([("PEPTIDEK", 2), ("GK", 1), ("AXK", 2), ("", 2), (None, 2)], "sequence string, charge int")
    r = {(x.sequence, x.number): x for x in pr.fragment_transitions(d).collect()}
    assert sorted(n for s, n in r if s == "PEPTIDEK") == [1, 2, 3, 4, 5, 6]
    assert r["PEPTIDEK", 1].mz == pytest.approx(147.1128, abs=1e-3) and r["PEPTIDEK", 1].group_id == "PEPTIDEK_2"
    assert r["PEPTIDEK", 2].precursor_mz == pytest.approx(464.7347, abs=1e-3) and r["PEPTIDEK", 2].annotation == "y2^1"
    assert r["GK", 2].mz == pytest.approx(r["GK", 2].precursor_mz)
    assert r["AXK", 1].mz is not None and r["AXK", 2].mz is None and len(r) == 11


def test_imbalance_of_haplotypes(spark):
    h = spark.createDataFrame([("c", p, "A", "C", 1, "A" if p != 12 else "C") for p in (10, 12, 30, 50, 52)], "contig string, pos long, ref string, alt string, phase_set long, hap1 string")
    cols = "contig string, pos long, ref string, alt string, ref_count long, alt_count long"
    s = [("c", 10, "A", "C", 90, 10), ("c", 12, "A", "C", 5, 95), ("c", 30, "A", "C", 50, 0), ("c", 50, "A", "C", 600, 400), ("c", 52, "A", "C", 20, 25), ("c", 52, "A", "C", 1, 2)]
    peaks = spark.createDataFrame([("c", 0, 20), ("c", 20, 40), ("c", 40, 60)], "contig string, start long, stop long")
    r = {x.start: x for x in rd.ase_per_peak(spark.createDataFrame(s, cols), h, peaks).collect()}
    assert (r[0].hap1, r[0].hap2, r[0].status) == (185, 15, "significant_imbalance")
    assert r[20].status == "underpowered_snp_count" and r[20].p is None and r[20].hap1_share == 1.0
    assert (r[40].snps, r[40].status) == (2, "below_effect_threshold")
    with pytest.raises(Exception, match="no haplotype"):
        rd.ase_per_peak(spark.createDataFrame([*s, ("c", 13, "A", "C", 40, 0)], cols), h, peaks).collect()


def test_classes_of_junctions(spark):
    t = "contig string, i_start long, i_stop long, reads long"
    known = spark.createDataFrame([("c", 1, 10, 1), ("c", 20, 30, 1)], t)
    j = spark.createDataFrame([("c", 1, 10, 6), ("c", 1, 30, 2), ("c", 1, 40, 2)], t)  # the second skips between two known ends
    r = {x["class"]: x for x in rd.junction_class_summary(j, known).collect()}
    assert (r["known"].junctions, r["partial"].junctions, r["novel"].junctions) == (2, 1, 0)
    assert r["known"].read_share == pytest.approx(0.8) and r["novel"].median_reads == 0 and r["novel"].status == "Healthy"
