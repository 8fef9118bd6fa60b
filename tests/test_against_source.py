"""Rules of operators with answers worked out from the source material's own code."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, matrix, proteins, reads, sequences, variants
from strandloom.sources import text

READ = "qname string, contig string, start long, stop long, mate_start long, tlen long, mapq int, flag int"


def test_coding_sequences(spark):
    def check(seq, **how):
        r = sequences.validate_cds(spark.createDataFrame([(seq,)], "seq string"), **how).first()
        return r.refused, r.codons, [(x.offset, x.segment) for x in r.discarded], r.internal_stops

    assert check("CTGAAATAA") == (None, ["CTG", "AAA", "TAA"], [], [])
    assert check("ttgaaataa")[0] is None and check("GTGAAATAA")[0] == "no start codon" and check("GTGAAATAA", table=11)[0] is None
    assert check("")[0] == "empty" and check(None)[0] == "empty"
    assert check("ATG AAATAA")[0] == "white space"
    assert check("ATGAAATA")[0] == "length is not divisible by three"
    assert check("ATGNAATAA")[0] == "invalid codon"
    assert check("ATGAAA")[0] == "no stop codon"
    assert check("ATGTAAAAATAG") == ("internal stop", ["ATG", "TAA", "AAA", "TAG"], [], [1])
    assert check("ATGTAAAAATAG", allow_internal_stops=True)[0] is None
    assert check("ATGNAAAAATAGCC", policy="permissive") == (None, ["ATG", "AAA", "TAG"], [(3, "NAA"), (12, "CC")], [])
    assert check("NNN", policy="permissive")[0] == "no complete codons"
    assert check("ATGTGATAA")[0] == "internal stop" and check("ATGTGATAA", table=4)[0] is None
    assert check("ATGTGAAGA", table=2) == (None, ["ATG", "TGA", "AGA"], [], [])
    for how in ({"policy": "loose"}, {"table": 99}):
        with pytest.raises(ValueError):
            check("ATG", **how)
    d = spark.createDataFrame([("ATGAAATAA",), ("AAAAAAAAA",)], "seq string")
    assert {r.codon: (r.n, r.frequency) for r in sequences.codon_usage(d).collect()} == {c: (1, pytest.approx(1 / 3)) for c in ("ATG", "AAA", "TAA")}


def test_guides(spark):
    def find(seq):
        d = sequences.find_pam_sites(spark.createDataFrame([(1, seq)], "id long, seq string"))
        return [(r.strand, r.start, r.guide) for r in d.collect()]

    low, six, most, above = "A" * 15 + "GCGCG", "A" * 14 + "GCGCGC", "GC" * 7 + "ATATAT", "GC" * 7 + "GATATA"
    assert [sum(c in "GC" for c in g) for g in (low, six, most, above)] == [5, 6, 14, 15]
    assert find(low + "AGG") == [] and find(above + "TGG") == []
    assert find(most + "CGG") == [("+", 0, most)] and find(six + "CGG") == [("+", 0, six)]
    assert find(most.replace("ATATAT", "ATTTTA") + "CGG") == [] and find(most[:-1] + "N" + "CGG") == []
    back = (most + "CGG").translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert ("-", 0, most) in find(back) and ("-", 3, most) in find("AAA" + back) and ("-", 0, most) in find((back + "AA").lower())
    d = spark.createDataFrame([(4, 100), (5, 100), (65, 100), (66, 100)], "start long, n long")
    assert [r.start for r in sequences.within_cds(d).collect()] == [5, 65]


def test_qc_failures_count_for_nothing_further(spark):
    d = spark.createDataFrame([(1 | 2 | 64,), (1 | 2 | 64 | 512 | 1024,), (4,), (256,), (2048 | 1,), (1024,)], "flag int")
    r = reads.flagstat(d).first()
    assert (r.records, r.secondary, r.supplementary, r.primary, r.qc_fail) == (6, 1, 1, 4, 1)
    assert (r.mapped, r.paired, r.proper, r.duplicate, r.duplicate_rate) == (2, 1, 1, 1, 0.5)


def test_variant_records(spark):
    rows = [("A", "G,AT", 0.0, "PASS"), ("A", "G,C", None, "."), ("AC", "GT", 50.0, "low"), ("A", "<DEL>", 10.0, None), ("C", "T", 20.0, "PASS")]
    r = variants.vcf_stats(spark.createDataFrame(rows, "ref string, alt string, qual double, filter string")).first()
    assert (r.records, r.snps, r.indels, r.other, r.ti, r.tv, r.passed, r.filtered, r.mean_qual) == (5, 2, 2, 1, 2, 1, 4, 1, 20.0)


def test_peaks_of_the_fragment_histogram(spark):
    proper = 1 | 2 | 64

    def peak(sizes, flag=proper):
        rows = [("q", "c", 0, 50, 100, s, 60, flag) for s, k in sizes.items() for _ in range(k)]
        return [(r.peak, r.height) for r in reads.fragment_histogram_peak(spark.createDataFrame(rows, READ)).collect()]

    assert peak({200: 50, 170: 5}) == [(202.5, 50)]
    assert peak({-200: 50}) == [(202.5, 50)] and peak({200: 5}, flag=1 | 2 | 128) == [] and peak({1600: 5, 300: 4}) == []
    assert peak({180: 30, 220: 40}) == [(222.5, 40)]  # the lower one is nearer than 50 bases
    assert peak({160: 30, 220: 20}) == [(162.5, 30)]
    assert reads.histogram_peaks([0, 3, 3, 0, 5, 0], 1, 1) == [1, 4]
    assert reads.histogram_peaks([0, 5, 4, 5, 0], 2, 2) == [1, 3] and reads.histogram_peaks([0, 5, 4, 5, 0], 3, 2) == [3] and reads.histogram_peaks([5, 1, 5], 1, 1) == []


def test_library_complexity(spark):
    pair = 1 | 2 | 64
    rows = [("a", "c", 100, 150, 200, 150, 60, pair), ("b", "c", 200, 250, 100, -150, 60, pair | 16), ("c", "c", 100, 150, 200, 151, 30, pair | 1024), ("a", "c", 200, 250, 100, -150, 60, 1 | 2 | 128)]
    rows += [("d", "chrM", 1, 51, 1, 90, 60, pair), ("e", "c", 1, 51, 1, 90, 29, pair), ("f", "c", 1, 51, 1, 0, 60, pair), ("g", "c", 1, 51, 1, 90, 60, 4), ("h", "c", 1, 51, 1, 90, 60, pair | 256)]
    d = spark.createDataFrame(rows, READ)
    r = reads.library_complexity(d).first()
    assert (r["mode"], r.total, r.distinct, r.nrf, r.pbc1, r.pbc2) == ("paired", 3, 2, pytest.approx(2 / 3), 0.5, 1.0)
    assert (r.excluded_contig, r.below_mapq, r.flagged_duplicates, r.warning) == (1, 1, 1, None)
    r = reads.library_complexity(d, mode="single").first()
    assert (r.total, r.distinct) == (5, 4)  # a and c at 100, b at its stop, the second read of a at 200, f at 1
    one = reads.library_complexity(d.where("qname = 'a'")).first()
    assert one.total == 1 and one.pbc2 is None and one.warning.startswith("every position is unique")
    assert reads.library_complexity(d.where("qname = 'g'")).first().total == 0


def test_fragments_around_sites(spark):
    pair = 1 | 2 | 64
    rows = [("a", "c", 1000, 1050, 1100, 150, 60, pair), ("b", "c", 990, 1040, 1090, 150, 60, pair), ("x", "c", 1000, 1050, 1100, 600, 60, pair), ("y", "c", 1000, 1050, 1100, 150, 60, 1 | 2 | 128)]
    d = spark.createDataFrame(rows, READ)
    s = spark.createDataFrame([("c", 1065, "+"), ("c", 1085, "-"), ("c", 5000, "+"), ("other", 5, "+")], "contig string, at long, strand string")
    known = spark.createDataFrame([("c",)], "contig string")

    def plot(sites, flank):
        return {(r["size"], r["offset"]): r.per_site for r in reads.v_plot(d, sites, flank=flank, contigs=known).collect()}

    third = pytest.approx(1 / 3)  # of the three sites on c; centres are 1075 and 1065
    assert plot(s, 50) == {(150, 10): pytest.approx(2 / 3), (150, 0): third, (150, 20): third}
    assert plot(s, 20) == {(150, 10): third}  # the other reads end before the flanks begin
    ends = spark.createDataFrame([("c", 1025, "+"), ("c", 1025, "-")], "contig string, at long, strand string")
    assert plot(ends, 50) == {(150, 40): 0.5, (150, -40): 0.5, (150, -50): 0.5}  # 50 itself is out
    with pytest.raises(ValueError):
        reads.v_plot(d, s.where("contig = 'none'"))


def test_consensus_peaks_lose_to_blacklisted_ones_and_end_with_the_contig(spark):
    peaks = spark.createDataFrame([("c", 300, 9.0, 1), ("c", 350, 5.0, 2), ("c", 900, 3.0, 3), ("c", 40, 8.0, 4)], "contig string, summit long, score double, id long")
    black = spark.createDataFrame([("c", 210, 215)], "contig string, start long, stop long")
    size = spark.createDataFrame([("c", 950)], "contig string, length long")
    got = intervals.consensus_peaks(peaks, half=100, blacklist=black, contigs=size).collect()
    assert [(r.start, r.stop, r.id) for r in got] == [(800, 950, 3)]  # 2 lost against 1; 4 would begin before the contig
    assert intervals.to_saf(spark.createDataFrame([("c", 800, 950)], "contig string, start long, stop long")).first().asDict() == {"GeneID": "c_800_950", "Chr": "c", "Start": 801, "End": 950, "Strand": "+"}


def test_precision_asks_every_day(spark):
    def run(days, level="mid"):
        d = spark.createDataFrame([(level, k, float(v)) for k, day in enumerate(days) for v in day], "level string, day int, value double")
        return matrix.precision_components(d).first()

    steady = [[100, 101, 99], [100, 102, 98], [101, 99, 100]]
    assert run(steady)["pass"] and not run([*steady, [60, 100, 140]])["pass"]
    wide = [[84, 100, 116], [83, 100, 117]]  # 16 and 17 %
    assert not run(wide)["pass"] and run(wide, "LLOQ")["pass"]
    r = run([[10, 12], [20, 22]])
    assert r.intra_cv == pytest.approx(2**0.5 / 11) and r.inter_cv == pytest.approx((2 + 49) ** 0.5 / 16)
    for bad in ([[1, 2]], [[1, 2], [1, 2, 3]]):
        with pytest.raises(ValueError):
            run(bad)


def test_columns_without_residues_and_ties(spark):
    a = spark.createDataFrame([(1, "T-A"), (2, "A-A"), (3, "A-C"), (4, "T-A")], "id long, seq string")
    got = {r.col: (r.residue, r.share, r.consensus) for r in sequences.consensus_sequence(a).collect()}
    assert got == {0: ("T", 0.5, "T"), 1: (None, 0.0, "-"), 2: ("A", 0.75, "A")}
    j = {r.col: (r.jsd, r.smoothed) for r in sequences.jsd_conservation(a, dict.fromkeys("ACGT", 0.25), half=1).collect()}
    assert j[1][0] == 0.0 and j[1][1] == pytest.approx((j[0][0] + j[2][0]) / 4) and j[0][1] == pytest.approx(j[0][0] / 2)


def test_loading_flags_are_for_too_little_only(spark):
    total = {"a1": 100, "a2": 100, "a3": 50, "a4": 400, "b1": 60}
    rows = [(s, f"f{k}", t / (7 if s == "a2" else 10)) for s, t in total.items() for k in range(7 if s == "a2" else 10)]
    g = spark.createDataFrame([(s, s[0]) for s in total], "sample string, grp string")
    r = {x.sample: x for x in matrix.sample_raw_qc(spark.createDataFrame(rows, "sample string, feature string, value double"), g).collect()}
    assert {s: x.flag for s, x in r.items()} == {"a1": False, "a2": True, "a3": True, "a4": False, "b1": False}
    assert (r["a3"].fold, r["a2"].ids_fold, r["b1"].baseline, r["b1"].fold, r["a1"].median) == (pytest.approx(0.5), 0.7, "all samples", pytest.approx(0.6), 10.0)


def test_left_censored_values_are_drawn_on_intensities(spark):
    rows = [("f", k, float(1000 + k)) for k in range(50)] + [("f", k, None) for k in range(50, 450)] + [("one", 1, 8.0), ("one", 2, None)]
    got = matrix.impute_left_censored(spark.createDataFrame(rows, "feature string, sample int, x double")).collect()
    new = [r.imputed for r in got if r.feature == "f" and r.x is None]
    sd = np.std(np.arange(50), ddof=1) * 0.1
    assert len(new) == 400 and abs(np.mean(new) - 1000.49) < 4 * sd / 20 and abs(np.std(new) / sd - 1) < 0.15
    assert [r.imputed for r in got if r.feature == "one" and r.x is None] == [8.0]


def test_sampling_depth_is_the_shallowest_plateau(spark):
    totals = spark.createDataFrame([(k,) for k in "abcd"], "sample string")
    curve = [(s, d, e) for s in "abcd" for d, e in ((1000, 50.0), (2000, 60.0), (3000, 60.3), (4000, 60.4))] + [("a", 5000, 61.0)]
    c = spark.createDataFrame(curve, "sample string, depth int, expected double")
    r = matrix.pick_depth(totals, c).first()
    assert (r.depth, r.kept, r.plateau) == (2000, 1.0, True) and r.gain_per_1000 == pytest.approx(0.3 / 60)
    r = matrix.pick_depth(totals, c, gain=1e-6).first()
    assert (r.depth, r.plateau) == (4000, False)
    assert matrix.pick_depth(totals, c, gain=1e-6, kept=0.2).first().depth == 5000


def test_narrowpeak_rows_are_checked(spark, tmp_path):
    def read(*rows):
        p = tmp_path / f"{abs(hash(rows))}.narrowPeak"
        p.write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
        return text.read_narrowpeak(spark, str(p)).select("id").collect()

    good = ("c", 10, 60, "p", 0, ".", 5.5, -1, -1, 49)
    assert len(read(("# comment",), good)) == 1
    for at, value in ((1, 60), (1, "x"), (2, 10), (9, 50), (9, -1), (9, "s")):
        with pytest.raises(Exception):
            read((*good[:at], value, *good[at + 1 :]))
    with pytest.raises(Exception):
        read(good[:9])
    with pytest.raises(ValueError):
        read(("# nothing",))


def test_methods_of_one_comparison_overlap(spark):
    rows = [(k, k < 10, k < 8, k % 2 == 0, False) for k in range(40)]
    got = {(r.a, r.b): r for r in proteins.method_overlap(spark.createDataFrame(rows, "gene int, x boolean, y boolean, z boolean, none boolean"), ["x", "y", "z", "none"]).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    r = got["x", "y"]
    assert (r.genes, r.hits_a, r.hits_b, r.shared, r.expected, r.enriched) == (40, 10, 8, 8, 2.0, True)
    assert r.p == pytest.approx(math.comb(10, 8) / math.comb(40, 8)) and not got["x", "z"].enriched


def test_identity_by_ion_ratio(spark):
    s = spark.createDataFrame([("a", 1, 24500.0, 9600.0), ("a", 2, 58500.0, 9200.0), ("b", 3, 1.0, 0.39), ("a", 4, 0.0, 1.0)], "analyte string, sample int, quantifier double, qualifier double")
    got = {r.sample: r.id_confirmed for r in matrix.confirm_by_ion_ratio(s, spark.createDataFrame([("a", 0.39)], "analyte string, ratio double")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_shallow_genotypes_are_missing(spark):
    rows = [(s, k, "0/1", 60, 30 if (s, k) != (0, 0) else 5) for s in range(2) for k in range(2)]
    d = spark.createDataFrame(rows, "site int, sample int, gt string, gq int, dp int")
    assert variants.iterative_missingness(d, min_depth=8, depth=F.col("dp"), sample_rate=0.5, site_rate=0.9).select("site").distinct().collect()[0].site == 1
    assert variants.iterative_missingness(d, sample_rate=0.5, site_rate=0.9).count() == 4
