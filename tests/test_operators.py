"""Known answers on small tables, and operators that SQL can't check."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators import gwas, intervals, matrix, proteins, reads, sequences, stats, variants
from strandloom.sources import text


def test_tails():
    assert tails.norm_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert tails.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert tails.norm_ppf(1e-10) == pytest.approx(-6.361341, abs=1e-5)
    assert tails.chisq1_sf(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.hypergeom_sf(2, 10, 4, 3) == pytest.approx(1 / 3, abs=1e-9)
    assert tails.binom_two_sided(2, 10) == pytest.approx(0.109375, abs=1e-9)
    assert tails.digamma(1) == pytest.approx(-0.5772156649, abs=1e-8)
    assert tails.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-8)
    assert tails.trigamma_inverse(tails.trigamma(2.5)) == pytest.approx(2.5, abs=1e-6)


def test_multi_alt_counts(spark):
    v = spark.createDataFrame([("1", 1, "A", "G,C", 0.0, "PASS"), ("1", 2, "A", "AT", 50.0, "PASS"), ("1", 3, "C", "T", None, "low")], "chrom string, pos long, ref string, alt string, qual double, filter string")
    s = variants.vcf_stats(v).first()
    assert (s.ti, s.tv, s.snps, s.indels, s.filtered, s.mean_qual) == (2, 1, 2, 1, 1, 25.0)


def test_intervals_at_bin_edges(spark):
    a = spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate([(0, 1024), (1024, 1025), (1000, 3000), (5, 5)])], "id long, contig string, start long, stop long")
    b = spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate([(1023, 1024), (1024, 2048), (2999, 4000)])], "id long, contig string, start long, stop long")
    got = sorted((r.a_id, r.b_id) for r in intervals.interval_join(a, b).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert sorted(r.id for r in intervals.interval_semi(a.where("id < 3"), b.where("id = 2")).collect()) == [2]
    assert intervals.interval_join(a.limit(0), b).count() == 0


def test_consensus_peaks_is_the_greedy_choice(spark):
    rng = np.random.default_rng(0)
    rows = [("c", int(s), float(v), i) for i, (s, v) in enumerate(zip(rng.integers(300, 5000, 60), rng.integers(0, 20, 60)))]
    peaks = spark.createDataFrame(rows, "contig string, summit long, score double, id long")
    got = sorted((r.start, r.id) for r in intervals.consensus_peaks(peaks, half=100).collect())
    assert got == sorted((r.start, r.id) for r in intervals.consensus_peaks(peaks, half=100, tile=512).collect())
    kept: list = []
    for _, s, v, i in sorted(rows, key=lambda r: (-r[2], r[1], r[3])):
        if all(abs(s - k[0] - 100) > 200 for k in kept):
            kept.append((s - 100, i))
    assert got == sorted(kept)


def test_pileup_and_junctions(spark):
    r = spark.createDataFrame([("c", 0, "3M", "ACG", [30] * 3, 60), ("c", 1, "1M1D1M", "CT", [30, 30], 60), ("c", 2, "1M", "T", [5], 60)], "contig string, start long, cigar string, seq string, quals array<int>, mapq int")
    p = {(x.pos, x.base): x.n for x in reads.pileup_alleles(r).collect()}
    assert p == {(0, "A"): 1, (1, "C"): 2, (2, "G"): 1, (2, "DEL"): 1, (3, "T"): 1}
    j = spark.createDataFrame([("a", "c", 10, "8M100N12M", 0, 255, 1), ("a", "c", 10, "8M100N12M", 0, 255, 1), ("b", "c", 14, "4M100N16M", 0, 255, 1), ("d", "c", 10, "8M100N12M", 0, 255, 4)], "qname string, contig string, start long, cigar string, flag int, mapq int, nh int")
    x = reads.junction_support(j).first()
    assert (x.i_start, x.i_stop, x.reads, x.reads_all, x.max_overhang) == (18, 118, 1, 2, 8)
    assert reads.junction_support(j, min_overhang=4).first().reads == 2


def test_adjust_p_equals_one_window(spark, monkeypatch):
    monkeypatch.setattr(stats, "BUCKET_ROWS", 100)
    rng = np.random.default_rng(1)
    p = np.round(rng.random(3000), 3)
    got = {r.i: r.q for r in stats.adjust_p(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p double")).collect()}
    order = np.argsort(p, kind="stable")
    rank = np.searchsorted(np.sort(p), p, "right")
    q = np.minimum(1, p * len(p) / rank)
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(q[order][::-1])[::-1]
    assert all(abs(got[i] - want[i]) < 1e-12 for i in got)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p double")
    harmonic = sum(1 / k for k in range(1, len(p) + 1))
    by = {r.i: r.q for r in stats.adjust_p(d, method="by").collect()}
    q = np.minimum(1, p * len(p) * harmonic / rank)
    want[order] = np.minimum.accumulate(q[order][::-1])[::-1]
    assert all(abs(by[i] - want[i]) < 1e-9 for i in by)
    low = np.searchsorted(np.sort(p), p, "left")
    holm = np.minimum(1, (len(p) - low) * p)
    want[order] = np.maximum.accumulate(holm[order])
    got = {r.i: r.q for r in stats.adjust_p(d, method="holm").collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_least_squares_and_shrinkage(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(rng.normal() + (f < 5) * (s % 2)), float(s % 2), float(s // 6)) for f in range(60) for s in range(12)]
    d = spark.createDataFrame(rows, "feature long, x double, c double, b double")
    got = {r.feature: r for r in matrix.moderated_t(matrix.feature_ols(d, design=["c", "b"], term="c")).collect()}
    x = np.column_stack([np.ones(12), [s % 2 for s in range(12)], [s // 6 for s in range(12)]])
    y = np.array([r[1] for r in rows if r[0] == 7])
    b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert got[7].beta == pytest.approx(b[1]) and got[7].s2 == pytest.approx(rss[0] / 9) and got[7].df == 9
    s2, post = [g.s2 for g in got.values()], [g.s2_post for g in got.values()]
    assert np.var(post) < np.var(s2)


def test_protein_groups(spark):
    rows = [("p1", "A"), ("p2", "A"), ("p2", "B"), ("p3", "B"), ("p2", "C"), ("p4", "D"), ("p4", "E")]
    nodes = proteins.collapse_proteins(spark.createDataFrame(rows, "peptide string, protein string"))
    got = {r.name: r.selected for r in proteins.parsimony_groups(nodes).collect()}
    assert got == {"A": True, "B": True, "C": False, "D": True}
    rng = np.random.default_rng(4)
    rows = sorted({(f"p{rng.integers(60)}", f"G{rng.integers(40):02d}") for _ in range(220)})
    nodes = proteins.collapse_proteins(spark.createDataFrame(rows, "peptide string, protein string"))
    one, two = (sorted((*r,) for r in proteins.parsimony_groups(nodes, task_links=k).select("name", "component", "selected", F.coalesce("pick", F.lit(0)), "new_peptides").collect()) for k in (10_000, 0))
    assert one == two and any(r[2] for r in one)
    with pytest.raises(ValueError):
        proteins.target_decoy_q(spark.createDataFrame([(1, 2.0, "P", 1)], "scan long, score double, protein string, psm long"))


def test_isotopes_and_reads_of_one_depth(spark):
    m = matrix.isotope_matrix(3)
    true = np.array([0.5, 0.0, 0.2, 0.3])
    d = spark.createDataFrame([((m @ true * 1000).tolist(), 3, 1.0)], "areas array<double>, carbons int, purity double")
    r = matrix.isotope_correct(d).first()
    assert r.mid == pytest.approx(true.tolist(), abs=1e-9) and r.enrichment == pytest.approx((0.4 + 0.9) / 3)
    c = spark.createDataFrame([(f, "s", 10 * (f + 1)) for f in range(6)] + [(1, "t", 5)], "feature long, sample string, n long")
    got = matrix.rarefy(c, depth=50).groupBy("sample").agg(F.sum("n")).collect()
    assert [(r[0], r[1]) for r in got] == [("s", 50)]


def test_codons_and_alignment_values(spark):
    d = spark.createDataFrame([(1, "ATGGCTTAA"), (2, "ATGTAAGCT"), (3, "ATGGC")], "id long, seq string")
    assert {r.id: r.accepted for r in sequences.validate_cds(d).collect()} == {1: True, 2: False, 3: False}
    u = sequences.codon_usage(spark.createDataFrame([(1, "CTTCTG")], "id long, seq string"), require_start=False, require_terminal_stop=False)
    assert {r.codon: r.rscu for r in sequences.rscu(u).collect() if r.amino_acid == "L" and r.n} == {"CTT": 3.0, "CTG": 3.0}
    a = spark.createDataFrame([(1, "ACGT"), (2, "ACGA"), (3, "GC-A")], "id long, seq string")
    e = {r.col: round(r.entropy, 4) for r in sequences.column_entropy(a).collect()}
    assert e == {0: 0.9183, 1: 0.0, 2: 0.0, 3: 0.9183}
    i = {(r.id_a, r.id_b): (r.pid1, r.pid2) for r in sequences.pairwise_identity(a).collect()}
    assert i[(1, 2)] == (0.75, 0.75) and i[(2, 3)] == (0.5, pytest.approx(2 / 3))


def test_mendelian_sums(spark):
    d = spark.createDataFrame([("o", k, 0.1 * k, 0.05 * k, 0.01) for k in range(1, 6)], "o string, snp long, beta double, beta_2 double, se_2 double")
    assert gwas.mr_ivw(d, by=["o"]).first().estimate == pytest.approx(0.5)
    e = gwas.mr_egger(d, by=["o"]).first()
    assert (e.slope, e.intercept) == (pytest.approx(0.5), pytest.approx(0, abs=1e-9))
    assert gwas.weighted_median(d, by=["o"]).first().weighted_median == pytest.approx(0.5)


def test_sources(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nc1\t5\t.\tA\tG,T\t.\tPASS\tDP=3;DB\tGT\t0/1\n")
    v = text.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (v.chrom, v.pos, v.alt, v.qual, v.info["DP"], v.info["DB"], v.samples) == ("c1", 5, "G,T", None, "3", None, ["0/1"])
    (tmp_path / "a.bed").write_text("track x\n#c\nc1\t1\t5\tn\n")
    assert [(r.contig, r.start, r.stop) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("c1", 1, 5)]
    (tmp_path / "a.fa").write_text(">sp|P1|X desc\nAC\nGT\n>b\nTT\n")
    assert sorted((r.id, r.seq) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("P1", "ACGT"), ("b", "TT")]
    (tmp_path / "a.gmt").write_text("s1\td\tg1\tg2\ns2\td\tg1\n")
    assert sorted((r.set, r.gene) for r in text.read_gmt(spark, str(tmp_path / "a.gmt")).collect()) == [("s1", "g1"), ("s1", "g2"), ("s2", "g1")]
    (tmp_path / "a.sam").write_text("@HD\nr1\t99\tc1\t11\t60\t5M2S\t=\t50\t45\tACGTACG\tIIIIIII\tNH:i:1\tts:A:+\n")
    s = text.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (s.start, s.stop, s.tags["NH"], s.tags["ts"], s.quals[0]) == (10, 15, "1", "+", 40)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n2 2 2\n1 1 5\n2 2 7\n")
    (tmp_path / "f.tsv").write_text("g1\nG2\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    assert sorted((r.gene, r.cell, r.n) for r in text.read_mtx(spark, str(tmp_path / "m.mtx"), str(tmp_path / "f.tsv"), str(tmp_path / "b.tsv")).collect()) == [("G2", "c2", 7), ("g1", "c1", 5)]
    d = spark.range(25).withColumn("k", F.col("id") % 3)
    text.write_by_key(d, str(tmp_path / "out"), key="k")
    assert {r.k: r.n for r in text.manifest(d, key="k").collect()} == {0: 9, 1: 8, 2: 8}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        text.write_by_key(d, str(tmp_path / "out"), key="k")
    text.write_in_chunks(d.coalesce(1), str(tmp_path / "chunks"), records=10)
    assert len(list((tmp_path / "chunks").glob("*.parquet"))) == 3


def test_clusters_in_rounds_equal_those_of_tasks(spark):
    rng = np.random.default_rng(5)
    ids = spark.range(60).select("id")
    pairs = spark.createDataFrame(sorted({tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(110)}), "id_a long, id_b long")
    from strandloom.operators.components import components

    c = components(pairs, ids)
    one, two = (sorted((r.id, r.cluster) for r in sequences.butina_clusters(pairs, ids, c, task_links=k).collect()) for k in (10_000, 0))
    assert one == two and len(one) == 60


def test_rules_of_evidence_and_clips(spark):
    cases = {
        ("PP3_Strong",): (4, "VUS", None), ("PM3_VeryStrong", "PM2"): (9, "Likely Pathogenic", None), ("BA1", "PS1"): (-96, "Benign", None), ("PVS1_Strong", "PP3_Strong", "PM4"): (4, "VUS", None),
        ("PP3_Strong", "BP4_Moderate"): (None, None, "conflicting family"), ("PP5",): (None, None, "retired criterion"), ("QQ1",): (None, None, "unknown criterion"), ("PS1", "PS1"): (None, None, "repeated criterion"), ("PP1", "PP1_Strong"): (None, None, "several of one family"), (): (0, "VUS", None),
    }
    d = spark.createDataFrame([(k, list(c)) for k, c in enumerate(cases)], "id int, criteria array<string>")
    got = {r.id: (r.points, r["class"], r.problem) for r in variants.evidence_points(d).collect()}
    assert got == dict(enumerate(cases.values()))
    r = spark.createDataFrame([(100, "10M3S5H"), (100, "2H4S10M"), (100, "5M2D5M"), (100, "5S5M100N5M1S")], "start long, cigar string")
    assert [(x.u_start, x.u_stop) for x in reads.with_unclipped_ends(r).collect()] == [(100, 118), (94, 110), (100, 112), (95, 211)]


def test_repeated_points_stay(spark):
    p = spark.createDataFrame([("c", 5, {"a": 1})] * 2 + [("c", 10, {}), ("c", 11, {})], "contig string, at long, m map<string,int>")
    s = spark.createDataFrame([("c", 0, 10, 2.0), ("c", 10, 20, 3.0)], "contig string, start long, stop long, copy_number double")
    assert sorted((r.at, r.copy_number) for r in intervals.point_in_segment(p, s).collect()) == [(5, 2.0), (5, 2.0), (10, 2.0), (11, 3.0)]
    a = p.withColumn("start", F.col("at")).withColumn("stop", F.col("at") + 1)
    assert intervals.interval_anti(a, s.where("start = 10")).count() == 2


def test_entries_that_read_like_the_size_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 5\n2 2 2\n")
    (tmp_path / "f.tsv").write_text("g1\ng2\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    got = text.read_mtx(spark, *[str(tmp_path / x) for x in ("m.mtx", "f.tsv", "b.tsv")])
    assert sorted((r.gene, r.cell, r.n) for r in got.collect()) == [("g1", "c1", 5), ("g2", "c2", 2)]


def test_exact_rank_p():
    assert tails.rank_less(0, 3, 5, 0) == pytest.approx(1 / 56)
    assert tails.rank_less(4, 2, 4, 0) == pytest.approx(9 / 15)
    assert tails.rank_less(15, 3, 5, 0) == 1.0
    assert tails.rank_less(30.0, 10, 12, 0) == pytest.approx(tails.norm_sf((60 - 30.5) / math.sqrt(10 * 12 * 23 / 12)))
