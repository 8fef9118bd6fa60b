"""Alignment tables: filters, counters, fragment sizes, duplicates, depth, pileup, junctions.

Reads are rows with contig, start (0-based), stop, flag bits and, where an
operator needs it, a CIGAR string.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import interval_join

#: Bits of the flag column: fixed values of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))
CONSUMES_REFERENCE, CONSUMES_QUERY = "MDN=X", "MIS=X"


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(bit) > 0


def primary() -> Column:
    return ~has(SECONDARY) & ~has(SUPPLEMENTARY)


def filter_reads(df: DataFrame, *, min_mapq: int = 20, proper_only: bool = True, duplicates: bool = False, region: str | None = None) -> DataFrame:
    """Primary mapped reads of at least ``min_mapq``, without duplicates, properly paired, in a region ('chr:start-stop', 1-based, inclusive)."""
    ok = ~has(UNMAPPED) & primary() & (F.col("mapq") >= min_mapq)
    if not duplicates:
        ok = ok & ~has(DUPLICATE)
    if proper_only:
        ok = ok & has(PROPER)
    if region:
        contig, start, stop = parse_region_text(region)
        ok = ok & (F.col("contig") == contig)
        if start is not None:
            ok = ok & (F.col("start") < stop) & (F.col("stop") > start)
    return df.where(ok)


def parse_region_text(region: str) -> tuple[str, int | None, int | None]:
    m = re.fullmatch(r"(.+):([\d,]+)-([\d,]+)", region)
    return (m[1], int(m[2].replace(",", "")) - 1, int(m[3].replace(",", ""))) if m else (region, None, None)


def parse_region(df: DataFrame, *, region: str = "region", contigs: list[str] | None = None) -> DataFrame:
    """Adds contig, 0-based start and stop of 'chr:start-stop'; a whole string that names a known contig is that contig."""
    r = F.col(region)
    pattern = r"^(.+):([\d,]+)-([\d,]+)$"
    whole = ~r.rlike(pattern) if contigs is None else r.isin(contigs) | ~r.rlike(pattern)
    number = lambda k: F.regexp_replace(F.regexp_extract(r, pattern, k), ",", "").try_cast("long")
    return df.withColumn("contig", F.when(whole, r).otherwise(F.regexp_extract(r, pattern, 1))).withColumn("start", F.when(~whole, number(2) - 1)).withColumn("stop", F.when(~whole, number(3)))


def hash_subsample(df: DataFrame, *, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose key hashes below the fraction: all rows of a key go together, whatever the partitioning."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(h < fraction)


def flagstat(df: DataFrame) -> DataFrame:
    """One row of counters; all but the first three are of primary records, and those after qc_fail of ones that passed QC."""
    n, p = F.count_if, primary()
    ok = p & ~has(QC_FAIL)
    return df.agg(
        F.count(F.lit(1)).alias("records"), n(has(SECONDARY)).alias("secondary"), n(has(SUPPLEMENTARY)).alias("supplementary"), n(p).alias("primary"), n(p & has(QC_FAIL)).alias("qc_fail"),
        n(ok & ~has(UNMAPPED)).alias("mapped"), n(ok & has(PAIRED)).alias("paired"), n(ok & has(PROPER)).alias("proper"), n(ok & has(DUPLICATE)).alias("duplicate"),
        (n(ok & has(DUPLICATE)) / F.nullif(n(ok & ~has(UNMAPPED)), F.lit(0))).alias("duplicate_rate"),
    )


def insert_stats(df: DataFrame, *, tlen: str = "tlen", upper_median: bool = False) -> DataFrame:
    """n, mean, population sd and exact median (or the upper of the two middle values) of the insert sizes of primary, mapped, proper pairs, from their histogram, and a grade of the median."""
    h = df.where(primary() & ~has(UNMAPPED) & has(PAIRED) & has(PROPER) & (F.col(tlen) > 0)).groupBy(F.col(tlen).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("v")  # one row per insert size
    c = h.withColumn("c", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))
    lo, hi = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda r: F.min(F.when(F.col("c") >= r, F.col("v")))
    s1, s2, n = F.sum(F.col("v") * F.col("k")), F.sum(F.col("v").cast("double") * F.col("v") * F.col("k")), F.sum("k")
    g = c.agg(n.alias("n"), (s1 / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n))).alias("sd"), (at(hi).cast("double") if upper_median else (at(lo) + at(hi)) / 2).alias("median"))
    return g.withColumn("grade", F.when(F.col("median").between(150, 600), "good").when(F.col("median").between(100, 1000), "borderline").otherwise("bad"))


def fragment_size_qc(df: DataFrame, *, length: str = "tlen", most: int = 600) -> DataFrame:
    """n, mode (least of tied), median, shares of 90-150 and of over 250 of primary proper pairs that aren't duplicates or QC failures, with a length of 1 to ``most``; and counts of the reasons that records don't count for (they may overlap). Without fragments the values are 0."""
    size = F.col(length)
    used = has(PROPER) & ~has(UNMAPPED) & primary() & ~has(DUPLICATE) & ~has(QC_FAIL) & size.between(1, most)
    top = df.where(used).groupBy(size.cast("long").alias("v")).agg(F.count(F.lit(1)).alias("k")).agg(F.min_by("v", F.struct((-F.col("k")).alias("k"), "v")).alias("mode"))
    n, count = F.count_if(used), F.count_if
    share = lambda c: count(used & c) / F.nullif(n, F.lit(0))
    g = df.agg(
        n.alias("n"), F.percentile(F.when(used, size), 0.5).alias("median"), share(size.between(90, 150)).alias("short_share"), share(size > 250).alias("long_share"),
        F.count(F.lit(1)).alias("input_records"), count(has(UNMAPPED)).alias("unmapped"), count(~has(PROPER)).alias("not_proper_pair"), count(has(SECONDARY)).alias("secondary"), count(has(SUPPLEMENTARY)).alias("supplementary"),
        count(has(DUPLICATE)).alias("duplicate"), count(has(QC_FAIL)).alias("qc_fail"), count(size <= 0).alias("nonpositive_length"), count(size > most).alias("over_max_size"),
    )
    return g.crossJoin(top).fillna(0, ["mode", "median", "short_share", "long_share"])  # one row each


def histogram_peaks(y: list[int], distance: int, prominence: float) -> list[int]:
    """Positions of local maxima (the middle of a flat top), none nearer than ``distance`` to a higher one that stays (of equal ones the later stays), of at least that prominence."""
    tops, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            tops.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(tops, key=lambda p: (-y[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def base(p: int, step: int) -> int:
        low, i = y[p], p
        while 0 <= i < len(y) and y[i] <= y[p]:
            low, i = min(low, y[i]), i + step
        return low

    return sorted(p for p in kept if y[p] - max(base(p, -1), base(p, 1)) >= prominence)


def fragment_histogram_peak(df: DataFrame, *, length: str = "tlen", bin_width: int = 5, limit: int = 1500, low: float = 150, high: float = 250, separation: int = 50, prominence: float = 0.05) -> DataFrame:
    """The tallest peak of the fragment lengths between ``low`` and ``high``: peak (a bin's centre), height; no row without one.

    Lengths are those of read 1 of proper pairs, below ``limit``. Peaks are at
    least ``separation`` bases apart and rise by a share of the tallest bin over
    what surrounds them. The histogram has ``limit / bin_width`` bins.
    """
    n, size = limit // bin_width, F.abs(F.col(length))
    h = df.where(has(PROPER) & has(READ1) & (size > 0) & (size < limit)).groupBy(F.floor(size / bin_width).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("k"))

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        y = [0] * n
        for v, k in zip(pdf["v"], pdf["k"]):
            y[int(v)] = int(k)
        found = [(p + 0.5) * bin_width for p in histogram_peaks(y, separation // bin_width, prominence * max(y))]
        inside = [(-y[int(c // bin_width)], c) for c in found if low < c < high]
        return pd.DataFrame([(c, -k) for k, c in sorted(inside)[:1]], columns=["peak", "height"])

    return h.groupBy(F.lit(1).alias("_")).applyInPandas(peak, "peak double, height long")


#: Contigs that don't count for the complexity of a library: fixed values.
MITOCHONDRIAL = ("chrM", "MT", "M", "chrMT")


def library_complexity(df: DataFrame, *, mode: str = "auto", min_mapq: int = 30, exclude: tuple[str, ...] = MITOCHONDRIAL) -> DataFrame:
    """One row: mode, total, distinct, nrf, pbc1, pbc2, excluded_contig, below_mapq, flagged_duplicates, warning.

    Mapped primary records count unless on an excluded contig or below
    ``min_mapq``. In paired mode ('auto': where any such record is paired) a
    fragment counts once, by read 1 of a proper pair with a length, at (contig,
    leftmost start of the pair, that plus the length); in single mode a read at
    (contig, 5' end, strand). Flagged duplicates count. The columns are contig,
    start, stop, mapq, flag and, in paired mode, mate_start and tlen.
    """
    base = primary() & ~has(UNMAPPED)
    if mode == "auto":
        mode = "paired" if df.where(base & has(PAIRED)).limit(1).count() else "single"
    off, low = F.col("contig").isin(*exclude), F.col("mapq") < min_mapq
    use = base & ~off & ~low
    if mode == "paired":
        use = use & has(PAIRED) & has(READ1) & has(PROPER) & (F.col("tlen") != 0)
        first = F.least("start", "mate_start")
        key = F.struct("contig", first.alias("a"), (first + F.abs("tlen")).alias("z"))
    else:
        key = F.struct("contig", F.when(has(REVERSE), F.col("stop")).otherwise(F.col("start")).alias("a"), has(REVERSE).alias("z"))
    n = F.count_if
    seen = df.agg(n(base & off).alias("excluded_contig"), n(base & ~off & low).alias("below_mapq"), n(use & has(DUPLICATE)).alias("flagged_duplicates"))
    c = df.where(use).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("k_n"))
    g = c.agg(F.coalesce(F.sum("k_n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"), n(F.col("k_n") == 1).alias("_1"), n(F.col("k_n") == 2).alias("_2")).crossJoin(seen)  # one row each
    unique = (F.col("total") > 0) & (F.col("flagged_duplicates") == 0) & (F.col("_1") == F.col("distinct"))
    zero = F.lit(0)
    return g.select(
        F.lit(mode).alias("mode"), "total", "distinct", (F.col("distinct") / F.nullif("total", zero)).alias("nrf"), (F.col("_1") / F.nullif("distinct", zero)).alias("pbc1"), (F.col("_1") / F.nullif("_2", zero)).alias("pbc2"),
        "excluded_contig", "below_mapq", "flagged_duplicates", F.when(unique, "every position is unique: the reads look deduplicated").alias("warning"),
    )


def cigar_ops(cigar: str = "cigar") -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))


def with_unclipped_ends(df: DataFrame) -> DataFrame:
    """Adds u_start and u_stop: where the read would begin and end had nothing been clipped (S and H, both where both occur)."""
    total = lambda text, pattern: F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    clip = r"(\d+)[SH]"
    lead, tail = F.regexp_extract("cigar", r"^((?:\d+[SH])+)", 1), F.regexp_extract("cigar", r"((?:\d+[SH])+)$", 1)
    return df.withColumn("u_start", F.col("start") - total(lead, clip)).withColumn("u_stop", F.col("start") + total(F.col("cigar"), r"(\d+)[MDN=X]") + total(tail, clip))


def mark_duplicates(df: DataFrame, *, library: str = "library", quality: str = "quality") -> DataFrame:
    """Adds ``duplicate``: all but one primary template per (library, unclipped 5' ends, orientations); the template of greatest quality sum stays, ties by name. No record is dropped.

    Reads have qname, contig, flag, u_start, u_stop and a quality sum.
    """
    five = F.when(has(REVERSE), F.col("u_stop")).otherwise(F.col("u_start"))
    end = F.struct("contig", five.alias("at"), has(REVERSE).alias("reverse"))
    t = df.where(primary() & ~has(UNMAPPED)).groupBy(library, "qname").agg(F.array_sort(F.collect_list(end)).alias("ends"), F.sum(quality).alias("total"))
    keep = t.groupBy(library, "ends").agg(F.min(F.struct((-F.col("total")).alias("q"), "qname")).alias("best"))
    dup = t.join(keep, [library, "ends"]).where(F.col("qname") != F.col("best.qname")).select(library, "qname", F.lit(True).alias("duplicate"))
    return df.join(dup, [library, "qname"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def depth_runs(df: DataFrame, *, by: list[str] | None = None, tile: int = 1 << 20) -> DataFrame:
    """Runs of equal depth per contig: contig, start, stop, depth (above 0).

    Reads are cut at tile borders, so each (contig, tile) is a window of its
    own and none depends on another.
    """
    by = by or []
    cut = F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile)))
    d = df.where("start < stop").select(*by, "contig", "start", "stop", cut.alias("_t"))
    d = d.select(*by, "contig", "_t", F.greatest(F.col("start"), F.col("_t") * tile).alias("_a"), F.least(F.col("stop"), (F.col("_t") + 1) * tile).alias("_z"))
    e = d.select(*by, "contig", "_t", F.explode(F.array(F.struct(F.col("_a").alias("p"), F.lit(1).alias("d")), F.struct(F.col("_z").alias("p"), F.lit(-1).alias("d")))).alias("e"))
    e = e.groupBy(*by, "contig", "_t", F.col("e.p").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by, "contig", "_t").orderBy("start")
    runs = e.withColumn("depth", F.sum("d").over(w)).withColumn("stop", F.lead("start").over(w))
    return runs.where("depth > 0 and stop is not null").select(*by, "contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("depth").cast("long").alias("depth"))


def depth(df: DataFrame, *, contigs: DataFrame | None = None) -> DataFrame:
    """Per-base depth: contig, pos (0-based), depth; with ``contigs`` (contig, length) uncovered bases come as 0."""
    runs = depth_runs(df)
    out = runs.select("contig", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), "depth")
    if contigs is not None:
        every = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("pos"))
        out = every.join(out, ["contig", "pos"], "left").fillna(0, ["depth"])
    return out


def once_per_fragment(df: DataFrame) -> DataFrame:
    """Reads of a fragment as its covered stretch: overlapping mates count once (contig, start, stop per name)."""
    w = Window.partitionBy("qname", "contig").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_g", F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("qname", "contig", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def coverage_summary(df: DataFrame, contigs: DataFrame, *, thresholds: tuple[int, ...] = (1, 10, 20)) -> DataFrame:
    """Per contig (contig, length): reads, covered bases, percent, mean depth and breadth at thresholds; uncovered bases count as 0."""
    size = F.col("stop") - F.col("start")
    c = depth_runs(df).groupBy("contig").agg(F.sum(size).alias("covered"), F.sum(size * F.col("depth")).alias("bases"), *[F.sum(F.when(F.col("depth") >= t, size).otherwise(0)).alias(f"at_{t}") for t in thresholds])
    n = df.groupBy("contig").agg(F.count(F.lit(1)).alias("reads"))
    j = contigs.join(n, "contig", "left").join(c, "contig", "left").fillna(0)
    return j.select("contig", "reads", "covered", (100 * F.col("covered") / F.col("length")).alias("percent"), (F.col("bases") / F.col("length")).alias("mean_depth"), *[(F.col(f"at_{t}") / F.col("length")).alias(f"breadth_{t}") for t in thresholds])


def region_depth(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean depth over each region (contig, start, stop, id)."""
    j = interval_join(regions, depth_runs(df))
    inside = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    g = j.groupBy(F.col("a_id").alias("id")).agg(F.sum(inside * F.col("b_depth")).alias("_b"))
    return regions.join(g, "id", "left").select("id", (F.coalesce("_b", F.lit(0)) / (F.col("stop") - F.col("start"))).alias("mean_depth"))


def aligned_bases(start: int, cigar: str, seq: str, quals: list[int] | None, min_q: int) -> list[tuple[int, str]]:
    """(position, base) of a read's aligned bases; DEL where the read lacks a base of the reference; skipped introns give nothing."""
    at, q, out = start, 0, []
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            out += [(at + k, seq[q + k]) for k in range(n) if quals is None or quals[q + k] >= min_q]
        elif op == "D":
            out += [(at + k, "DEL") for k in range(n)]
        if op in CONSUMES_REFERENCE:
            at += n
        if op in CONSUMES_QUERY:
            q += n
    return out


def pileup_alleles(df: DataFrame, *, min_mapq: int = 20, min_baseq: int = 20) -> DataFrame:
    """(contig, pos, base, n, frequency) of reads with contig, start, cigar, seq, quals, mapq; N is left out, DEL is counted but not in the frequency's denominator."""

    @F.pandas_udf("array<struct<pos:long,base:string>>")
    def bases(start: pd.Series, cigar: pd.Series, seq: pd.Series, quals: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": p, "base": b} for p, b in aligned_bases(int(s), c, x, None if q is None else list(q), min_baseq)] for s, c, x, q in zip(start, cigar, seq, quals)])

    x = df.where(F.col("mapq") >= min_mapq).select("contig", F.explode(bases("start", "cigar", "seq", "quals")).alias("b"))
    g = x.where("b.base <> 'N'").groupBy("contig", F.col("b.pos").alias("pos"), F.col("b.base").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.when(F.col("base") != "DEL", F.col("n"))).over(Window.partitionBy("contig", "pos"))
    return g.withColumn("frequency", F.when(F.col("base") != "DEL", F.col("n") / total)).withColumn("depth", total)


def call_snvs(pileup: DataFrame, reference: DataFrame, *, min_depth: int = 10, min_frequency: float = 0.1) -> DataFrame:
    """Alleles other than the reference base (contig, pos from 0, ref) at enough depth and frequency, with 1-based positions; N in the reference is skipped."""
    j = pileup.join(reference.withColumn("ref", F.upper("ref")), ["contig", "pos"])
    return j.where((F.col("ref") != "N") & (F.col("base") != F.col("ref")) & (F.col("base") != "DEL") & (F.col("depth") >= min_depth) & (F.col("frequency") >= min_frequency)).select("contig", (F.col("pos") + 1).alias("pos"), "ref", F.col("base").alias("alt"), "n", "depth", "frequency")


def v_plot(df: DataFrame, sites: DataFrame, *, flank: int = 1000, max_size: int = 600, contigs: DataFrame | None = None) -> DataFrame:
    """(size, offset, per_site): centres of fragments around stranded sites (contig, at, strand), mirrored on the minus strand, over the number of sites.

    A fragment is read 1 of a proper pair (contig, start, stop, mate_start,
    tlen, flag) with a length below ``max_size``, and is met where the read
    itself overlaps the flanks. Offsets run from -flank to flank - 1. Sites of
    contigs that aren't in ``contigs`` don't count; no site at all is an error.
    """
    if contigs is not None:
        sites = sites.join(contigs.select("contig").distinct(), "contig", "left_semi")
    n = sites.count()
    if not n:
        raise ValueError("no sites on known contigs")
    size = F.abs(F.col("tlen")).cast("long")
    f = df.where(has(PROPER) & has(READ1) & (size > 0) & (size < max_size)).withColumn("size", size)
    f = f.select("contig", F.col("start").alias("read_start"), F.col("stop").alias("read_stop"), "size", (F.least("start", "mate_start") + F.floor(F.col("size") / 2)).alias("start"))
    f = f.withColumn("stop", F.col("start") + 1)
    minus = (F.col("strand") == "-").cast("int")
    s = sites.select("contig", (F.col("at") - flank + minus).alias("start"), (F.col("at") + flank + minus).alias("stop"), "at", "strand")
    met = (F.col("a_read_start") < F.col("b_at") + flank) & (F.col("a_read_stop") > F.greatest(F.lit(0), F.col("b_at") - flank))
    off = F.when(F.col("b_strand") == "-", F.col("b_at") - F.col("a_start")).otherwise(F.col("a_start") - F.col("b_at"))
    return interval_join(f, s, condition=met).groupBy(F.col("a_size").alias("size"), off.alias("offset")).agg((F.count(F.lit(1)) / n).alias("per_site"))


def tss_enrichment(fragments: DataFrame, sites: DataFrame, *, flank: int = 2000, contigs: DataFrame | None = None) -> DataFrame:
    """Mean signal of the central 100 bases over that of the outer 100 at both ends; signal is depth around the sites, strand-aware. Sites whose window leaves the contig (contig, length) are skipped and counted."""
    fits = F.col("at") >= flank
    if contigs is not None:
        sites = sites.join(F.broadcast(contigs.select("contig", F.col("length").alias("_len"))), "contig", "left")
        fits = fits & F.coalesce(F.col("at") + flank <= F.col("_len"), F.lit(False))
    s = sites.where(fits).select("contig", (F.col("at") - flank).alias("start"), (F.col("at") + flank).alias("stop"), "at", "strand")
    skipped, n = sites.where(~fits).count(), s.count()
    j = interval_join(depth_runs(fragments), s)
    x = j.select(F.explode(F.sequence(F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop") - 1)).alias("p"), "b_at", "b_strand", F.col("a_depth").alias("d"))
    off = F.when(F.col("b_strand") == "-", F.col("b_at") - F.col("p") - 1).otherwise(F.col("p") - F.col("b_at"))
    g = x.groupBy(off.alias("offset")).agg(F.sum("d").alias("d"))
    centre = F.sum(F.when(F.col("offset").between(-50, 49), F.col("d")).otherwise(0)) / (100.0 * max(n, 1))
    outer = F.sum(F.when((F.col("offset") < -flank + 100) | (F.col("offset") >= flank - 100), F.col("d")).otherwise(0)) / (200.0 * max(n, 1))
    return g.agg(F.lit(n).cast("long").alias("sites"), F.lit(skipped).cast("long").alias("skipped"), (centre / F.nullif(outer, F.lit(0.0))).alias("score"))


def introns(df: DataFrame) -> DataFrame:
    """One row per spliced gap of a read: all columns, i_start, i_stop and the shorter of the matched blocks beside it (overhang)."""
    ops = cigar_ops()
    walk = F.aggregate(
        ops,
        F.struct(F.col("start").cast("long").alias("at"), F.lit(0).alias("block"), F.expr("cast(array() as array<struct<a:long,z:long,left:int,right:int>>)").alias("out")),
        lambda s, x: F.struct(
            F.when(F.lit(CONSUMES_REFERENCE).contains(x["op"]), s["at"] + x["n"]).otherwise(s["at"]).alias("at"),
            F.when(x["op"] == "N", 0).when(x["op"].isin("M", "=", "X"), s["block"] + x["n"]).otherwise(s["block"]).alias("block"),
            F.when(x["op"] == "N", F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), (s["at"] + x["n"]).alias("z"), s["block"].alias("left"), F.lit(0).alias("right")))))
            .when(x["op"].isin("M", "=", "X") & (F.size(s["out"]) > 0), F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(F.get(s["out"], F.size(s["out"]) - 1)["a"].alias("a"), F.get(s["out"], F.size(s["out"]) - 1)["z"].alias("z"), F.get(s["out"], F.size(s["out"]) - 1)["left"].alias("left"), (F.get(s["out"], F.size(s["out"]) - 1)["right"] + x["n"]).alias("right")))))
            .otherwise(s["out"]).alias("out"),
        ),
    )
    d = df.where(F.col("cigar").contains("N")).withColumn("_j", F.explode(walk["out"]))
    return d.select(*df.columns, F.col("_j.a").alias("i_start"), F.col("_j.z").alias("i_stop"), F.least("_j.left", "_j.right").alias("overhang"))


def junction_support(df: DataFrame, *, min_overhang: int = 8, min_mapq: int = 255) -> DataFrame:
    """Per junction: fragments anchored well on both sides, all fragments, and the greatest overhang; unique reads are those with nh = 1, or mapq where nh is null."""
    u = introns(df.where(primary() & ~has(UNMAPPED) & (F.coalesce(F.col("nh") == 1, F.col("mapq") >= min_mapq))))
    return u.groupBy("contig", "i_start", "i_stop").agg(F.count_distinct(F.when(F.col("overhang") >= min_overhang, F.col("qname"))).alias("reads"), F.count_distinct("qname").alias("reads_all"), F.max("overhang").alias("max_overhang"))


def junction_class_summary(junctions: DataFrame, known_junctions: DataFrame, *, classes: tuple[str, ...] = ("known", "partial", "novel")) -> DataFrame:
    """Per class (both ends known, in whatever pairing, one end known, none): share of junctions and of reads, median support, and the verdict by the share of known reads; an absent class has 0."""
    k = known_junctions.select("contig", "i_start", "i_stop")
    j = junctions.join(k.select("contig", "i_start").distinct().withColumn("_a", F.lit(1)), ["contig", "i_start"], "left").join(k.select("contig", "i_stop").distinct().withColumn("_z", F.lit(1)), ["contig", "i_stop"], "left")
    ends = F.coalesce("_a", F.lit(0)) + F.coalesce("_z", F.lit(0))
    j = j.withColumn("class", F.when(ends == 2, "known").when(ends == 1, "partial").otherwise("novel"))
    g = j.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("reads").alias("r"), F.percentile("reads", 0.5).alias("median_reads"))
    every = junctions.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(g, "class", "left").fillna(0)
    w = Window.partitionBy(F.lit(1))
    known = F.sum(F.when(F.col("class") == "known", F.col("r"))).over(w) / F.nullif(F.sum("r").over(w), F.lit(0))
    status = F.when(known >= 0.8, "Healthy").when(known >= 0.6, "Acceptable").when(known.isNotNull(), "Suspect or interesting")
    return every.select("class", F.col("n").alias("junctions"), (F.col("n") / F.nullif(F.sum("n").over(w), F.lit(0))).alias("junction_share"), (F.col("r") / F.nullif(F.sum("r").over(w), F.lit(0))).alias("read_share"), "median_reads", status.alias("status"))


def junction_saturation(reads: DataFrame, *, steps: int = 20, plateau: float = 0.02, seed: int = 0) -> DataFrame:
    """Junctions seen at 5 %, 10 %, ... of the reads (by hash of the name), all and known, and the verdict: rows (qname, junction, known)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("qname").cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    first = reads.groupBy("junction", "known").agg(F.min((F.floor(h * steps) + 1).cast("int")).alias("step"))
    g = first.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("k"))
    grid = reads.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy("step")
    c = grid.join(g, "step", "left").fillna(0).select((F.col("step") / steps).alias("share"), F.sum("n").over(w).alias("all_junctions"), F.sum("k").over(w).alias("known_junctions"))
    at = lambda s: F.max(F.when(F.abs(F.col("share") - s) < 1e-9, F.col("all_junctions"))).over(Window.partitionBy(F.lit(1)))
    return c.withColumn("verdict", F.when((at(1.0) - at(0.8)) / F.nullif(at(0.8), F.lit(0)) < plateau, "plateau").otherwise("rising"))


def contig_counts(df: DataFrame, *, mito: str = "chrM", x: str = "chrX", y: str = "chrY", top: int = 25) -> DataFrame:
    """The busiest contigs with mapped reads, the share on the mitochondrion and the X to Y ratio (1 added below)."""
    g = df.where(~has(UNMAPPED) & primary()).groupBy("contig").agg(F.count(F.lit(1)).alias("mapped"))
    t = g.agg(F.sum("mapped").alias("_t"), F.sum(F.when(F.col("contig") == mito, F.col("mapped")).otherwise(0)).alias("_m"), F.sum(F.when(F.col("contig") == x, F.col("mapped")).otherwise(0)).alias("_x"), F.sum(F.when(F.col("contig") == y, F.col("mapped")).otherwise(0)).alias("_y"))
    return g.orderBy(F.col("mapped").desc(), "contig").limit(top).crossJoin(t).select("contig", "mapped", (F.col("_m") / F.col("_t")).alias("mito_share"), (F.col("_x") / (F.col("_y") + 1)).alias("x_to_y"))  # one row of totals


def orientation_share(df: DataFrame, *, tag: str = "ts") -> DataFrame:
    """Share of primary mapped reads with the tag that have '+'."""
    return df.where(primary() & ~has(UNMAPPED) & F.col(tag).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(tag) == "+").cast("double")).alias("plus_share"))


def ase_per_peak(snps: DataFrame, haplotypes: DataFrame, peaks: DataFrame, *, min_depth: int = 30, min_snps: int = 2) -> DataFrame:
    """Haplotype totals per peak coordinates and phase set, the share of the first, a binomial p and its BH value where there are SNPs enough, and the status.

    snps: contig, pos (0-based), ref, alt, ref_count, alt_count; haplotypes: contig, pos, ref, alt, phase_set, hap1; peaks: contig, start, stop.
    A SNP of enough depth that the haplotypes lack is an error.
    """
    from strandloom.functions import tails
    from strandloom.operators.stats import adjust_p

    s = snps.where(F.col("ref_count") + F.col("alt_count") >= min_depth).join(haplotypes, ["contig", "pos", "ref", "alt"], "left")
    s = s.withColumn("hap1", F.coalesce("hap1", F.raise_error(F.concat_ws(" ", F.lit("no haplotype for"), "contig", F.col("pos").cast("string"), "ref", "alt"))))
    one = F.when(F.col("hap1") == F.col("ref"), F.col("ref_count")).otherwise(F.col("alt_count"))
    s = s.withColumn("h1", one).withColumn("h2", F.col("ref_count") + F.col("alt_count") - one).withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + 1)
    j = interval_join(s, peaks.select("contig", "start", "stop").distinct())
    g = j.groupBy(F.col("b_contig").alias("contig"), F.col("b_start").alias("start"), F.col("b_stop").alias("stop"), F.col("a_phase_set").alias("phase_set")).agg(F.count(F.lit(1)).alias("snps"), F.sum("a_h1").alias("hap1"), F.sum("a_h2").alias("hap2"))
    total = F.col("hap1") + F.col("hap2")
    g = g.withColumn("hap1_share", F.col("hap1") / F.nullif(total, F.lit(0)))
    q = adjust_p(g.withColumn("p", F.when((F.col("snps") >= min_snps) & (total > 0), tails.binom_p("hap1", total))))
    sure, wide = F.coalesce(F.col("q") < 0.05, F.lit(False)), F.abs(F.col("hap1_share") - 0.5) >= 0.2
    return q.withColumn("status", F.when(F.col("snps") < min_snps, "underpowered_snp_count").when(sure & wide, "significant_imbalance").when(sure, "below_effect_threshold").otherwise("non_significant"))
