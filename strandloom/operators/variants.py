"""Variant tables: splitting, classing, normalising, filtering, comparing, genotype counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.scratch import Scratch

KEY = ["chrom", "pos", "ref", "alt"]
#: Transitions, as pairs of bases.
TRANSITIONS = ["AG", "GA", "CT", "TC"]


def split_multiallelic(df: DataFrame, *, alt: str = "alt") -> DataFrame:
    """One row per ALT."""
    return df.withColumn(alt, F.explode(F.split(alt, ",")))


def variant_class(ref: Column, alt: Column) -> Column:
    """snp, indel, mnp or other, of one ALT."""
    bases = ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$")
    return F.when(~bases, "other").when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").when(F.length(ref) == F.length(alt), "mnp").otherwise("indel")


def classify_variant(df: DataFrame, *, ref: str = "ref", alt: str = "alt", out: str = "class") -> DataFrame:
    """Class over all ALTs of a record: snp, mnp or indel if all are, else other; and whether it has several ALTs."""
    alts = F.split(alt, ",")
    kinds = F.array_distinct(F.transform(alts, lambda a: variant_class(F.col(ref), a)))
    return df.withColumn(out, F.when(F.size(kinds) == 1, kinds[0]).otherwise("other")).withColumn("multi_alt", F.size(alts) > 1)


def needs_normalizing(df: DataFrame, *, ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Flags rows whose alleles share a last base, or a first base beyond an anchor."""
    r, a = F.col(ref), F.col(alt)
    last = (F.least(F.length(r), F.length(a)) > 1) & (F.right(r, F.lit(1)) == F.right(a, F.lit(1)))
    first = (F.least(F.length(r), F.length(a)) > 1) & (F.substring(r, 1, 1) == F.substring(a, 1, 1))
    return df.withColumn("needs_normalizing", last | first)


def atomize_mnp(df: DataFrame, *, pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Substitutions of several bases as one row per changed base; other rows stay."""
    several = (F.length(ref) == F.length(alt)) & (F.length(ref) > 1)
    parts = F.transform(F.sequence(F.lit(0), F.length(ref) - 1), lambda i: F.struct((F.col(pos) + i).alias("p"), F.substr(F.col(ref), i + 1, F.lit(1)).alias("r"), F.substr(F.col(alt), i + 1, F.lit(1)).alias("a")))
    own = F.array(F.struct(F.col(pos).cast("long").alias("p"), F.col(ref).alias("r"), F.col(alt).alias("a")))
    x = df.withColumn("_x", F.explode(F.when(several, F.filter(F.transform(parts, lambda e: F.struct(e["p"].cast("long").alias("p"), e["r"].alias("r"), e["a"].alias("a"))), lambda e: e["r"] != e["a"])).otherwise(own)))
    return x.withColumn(pos, F.col("_x.p")).withColumn(ref, F.col("_x.r")).withColumn(alt, F.col("_x.a")).drop("_x")


def _shared(a: Column, b: Column) -> Column:
    """How many first characters two strings share."""
    same = lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n)
    return F.aggregate(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when(i == 0, n).otherwise(same(n, i)))


def _trimmed(df: DataFrame) -> DataFrame:
    """Last, then first bases that both alleles share are cut off, down to one base each."""
    shortest = F.least(F.length("ref"), F.length("alt")) - 1
    cut = F.when(F.col("ref") != F.col("alt"), F.least(_shared(F.reverse("ref"), F.reverse("alt")), shortest)).otherwise(0)
    d = df.withColumn("_k", cut).withColumn("ref", F.expr("left(ref, length(ref) - _k)")).withColumn("alt", F.expr("left(alt, length(alt) - _k)"))
    d = d.withColumn("_k", F.when(F.col("ref") != F.col("alt"), F.least(_shared(F.col("ref"), F.col("alt")), F.least(F.length("ref"), F.length("alt")) - 1)).otherwise(0))
    return d.withColumn("pos", F.col("pos") + F.col("_k")).withColumn("ref", F.expr("substring(ref, _k + 1)")).withColumn("alt", F.expr("substring(alt, _k + 1)")).drop("_k")


def roll_left(unit: str, before: str) -> int:
    """How many bases an inserted or deleted ``unit`` can move to the left through the bases ``before`` it."""
    s = 0
    while s < len(before) and before[-1 - s] == unit[-1 - s % len(unit)]:
        s += 1
    return s


def _rolls(unit: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([roll_left(u, b) for u, b in zip(unit, before)], dtype="int32")


def normalize_variant(variants: DataFrame, reference: DataFrame, *, chunk: int = 10_000, look: int = 64, anchor_after: bool = False) -> DataFrame:
    """Rows of one ALT each, trimmed and left-aligned against ``reference`` (chrom, chunk, seq: consecutive stretches of ``chunk`` bases); positions are 1-based.

    Substitutions never need the reference: they are trimmed by built-ins. An
    insertion or deletion, where one allele ends with the other, is joined to
    the stretch with the base before it and moves left through the ``look``
    bases there; those that reach the end of what they see go into another
    round, from where they are and through whole stretches, until none is left.
    At the start of a contig there is no base before to anchor on: an allele
    stays empty, or with ``anchor_after`` both end with the base after, as VCF
    has it (but where an allele came in empty there). A stretch that a variant
    needs and ``reference`` lacks is an error.
    Rows with a null allele or position stay as they are.
    """
    s, rolls = Scratch(variants.sparkSession, "normalize"), F.pandas_udf(_rolls, "int")
    keep = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    v = variants.withColumn("pos", F.col("pos").cast("long"))
    shift = (F.length("ref") != F.length("alt")) & (F.endswith("ref", F.col("alt")) | F.endswith("alt", F.col("ref"))) & F.col("pos").isNotNull() & F.col("chrom").isNotNull()
    shift = F.coalesce(shift, F.lit(False))
    rest = v.where(~shift)
    alone = F.col("ref").isNull() | F.col("alt").isNull() | ((F.length("ref") == 1) & (F.length("alt") == 1))
    done = [rest.where(alone).select(*keep, "pos", "ref", "alt"), _trimmed(rest.where(~alone)).select(*keep, "pos", "ref", "alt")]
    n = F.abs(F.length("ref") - F.length("alt"))
    todo = v.where(shift).withColumn("deleted", F.length("ref") > F.length("alt")).withColumn("unit", F.when(F.col("deleted"), F.left("ref", n)).otherwise(F.left("alt", n)))
    after = F.left(F.when(F.col("deleted"), F.col("alt")).otherwise(F.col("ref")), F.lit(1))  # the first base that both end with
    todo = s.saved(todo.select(*keep, "pos", "deleted", "unit", after.alias("_after")), "todo")
    stretch = reference.select("chrom", F.col("chunk").cast("long").alias("_chunk"), F.col("seq").alias("_seq"))
    while not todo.isEmpty():
        j = todo.withColumn("_chunk", F.floor((F.col("pos") - 2) / chunk).cast("long")).join(stretch, ["chrom", "_chunk"], "left")
        if not j.where("pos > 1 and (_seq is null or length(_seq) < pos - 1 - _chunk * %d)" % chunk).isEmpty():
            raise ValueError("the reference lacks a stretch that a variant needs")
        seen = F.when(F.col("pos") > 1, F.expr(f"right(left(_seq, cast(pos - 1 - _chunk * {chunk} as int)), {look})")).otherwise("")
        j = j.withColumn("_seen", seen).withColumn("_s", rolls("unit", "_seen")).drop("_seq", "_chunk")
        turn = F.col("_s") % F.length("unit")
        j = j.withColumn("unit", F.concat(F.right("unit", turn), F.expr("left(unit, length(unit) - _s % length(unit))"))).withColumn("pos", F.col("pos") - F.col("_s"))
        j = j.withColumn("_after", F.when(F.col("_s") > 0, F.left("unit", F.lit(1))).otherwise(F.col("_after")))  # a unit that has moved begins with the base after it
        at_start = F.col("pos") == 1
        j = s.saved(j.withColumn("_open", (F.col("_s") == F.length("_seen")) & ~at_start), "rolled", stays=True)
        anchor = F.when(at_start, "").otherwise(F.substr("_seen", F.length("_seen") - F.col("_s"), F.lit(1)))
        end = j.where("not _open").withColumn("_a", anchor)
        tail = F.when(at_start, F.col("_after")).otherwise("") if anchor_after else F.lit("")
        long, short = F.concat("_a", "unit", tail), F.concat("_a", tail)
        done.append(end.select(*keep, (F.col("pos") - F.length("_a")).alias("pos"), F.when(F.col("deleted"), long).otherwise(short).alias("ref"), F.when(F.col("deleted"), short).otherwise(long).alias("alt")))
        todo, look = j.where("_open").select(*keep, "pos", "deleted", "unit", "_after"), chunk
    s.close()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def hard_filter_variants(df: DataFrame, *, snp: dict[str, tuple[str, float]], indel: dict[str, tuple[str, float]], ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Rows that pass the thresholds of their kind; rules are column: (operator, value). A missing value passes."""

    def passes(rules: dict[str, tuple[str, float]]) -> Column:
        ok = F.lit(True)
        for c, (op, v) in rules.items():
            x = F.col(c)
            ok = ok & (x.isNull() | {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op])
        return ok

    kind = variant_class(F.col(ref), F.col(alt))
    return df.where(F.when(kind == "snp", passes(snp)).otherwise(passes(indel)))


def flag_excluded_region(df: DataFrame, *, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Labels positions in long regions of linkage on hg38: fixed values, the MHC and the inversion of 8p23."""
    c = F.regexp_replace(F.col(chrom).cast("string"), "^chr", "")
    mhc = (c == "6") & F.col(pos).between(25_000_000, 34_000_000)
    inv = (c == "8") & F.col(pos).between(7_000_000, 13_000_000)
    return df.withColumn("excluded", F.when(mhc, "MHC").when(inv, "chr8_inversion"))


def annotate_by_key(variants: DataFrame, reference: DataFrame, *, columns: list[str], prefix: str = "ref_", key: list[str] = KEY) -> DataFrame:
    """Left join on the variant key; annotation columns get a prefix so that no own value is taken for one."""
    return variants.join(reference.select(*key, *[F.col(c).alias(prefix + c) for c in columns]), key, "left")


def rare_variant_filter(variants: DataFrame, frequency: DataFrame, *, af: str = "af", below: float = 0.01, key: list[str] = KEY) -> DataFrame:
    """Variants that are absent from the table, have no frequency there, or one below the limit."""
    j = variants.join(frequency.select(*key, F.col(af).alias("_af")), key, "left")
    return j.where(F.col("_af").isNull() | (F.col("_af") < below)).drop("_af")


def membership(sets: dict[str, DataFrame], *, key: list[str] = KEY) -> DataFrame:
    """Each key once, with the number of sets that hold it and their names in order."""
    names = sorted(sets)
    tagged = None
    for i, name in enumerate(names):
        t = sets[name].select(*key, F.lit(1 << i).alias("_bit"))
        tagged = t if tagged is None else tagged.unionByName(t)
    g = tagged.groupBy(*key).agg(F.bit_or("_bit").alias("mask"))
    return g.withColumn("n_sets", F.bit_count("mask")).withColumn("members", F.concat_ws("+", *[F.when(F.col("mask").bitwiseAND(1 << i) > 0, n) for i, n in enumerate(names)]))


def compare_callsets(sets: dict[str, DataFrame], *, key: list[str] = KEY) -> DataFrame:
    """Count of variants by the sets that hold them."""
    return membership(sets, key=key).groupBy("members", "n_sets").agg(F.count(F.lit(1)).alias("n"))


def merge_callsets(calls: DataFrame, *, key: list[str] = KEY, sample: str = "sample", value: str = "gt", samples: list) -> DataFrame:
    """A row per variant and a column per sample; a sample without a call stays null, not reference."""
    return calls.groupBy(*key).pivot(sample, samples).agg(F.min(value))


def concat_dedup(parts: list[DataFrame], *, key: list[str] = KEY) -> DataFrame:
    """All regions' rows with exact duplicates of the key dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(key)


def vcf_stats(df: DataFrame) -> DataFrame:
    """One row of totals: records, snps, indels, other, passed, filtered, ti, tv, mean_qual.

    A record whose alleles are all of one base is an SNP; else one with a longer
    REF or an ALT of other length is an indel, unless an ALT is symbolic or a
    breakend. ti and tv are counted per ALT, in SNP records only. A QUAL of 0
    counts in the mean, a missing one doesn't.
    """
    alts, n = F.split("alt", ","), F.count_if
    snp = (F.length("ref") == 1) & F.forall(alts, lambda a: a.rlike("^[ACGTN*]$"))
    odd = F.exists(alts, lambda a: a.rlike("[<\\[\\]]"))
    indel = ~snp & ~odd & ((F.length("ref") > 1) | F.exists(alts, lambda a: (a == ".") | (F.length(a) != F.length("ref"))))
    ti = F.when(snp, F.size(F.filter(alts, lambda a: F.concat("ref", a).isin(TRANSITIONS)))).otherwise(0)
    all_alts = F.when(snp, F.size(alts)).otherwise(0)
    passed = F.col("filter").isNull() | F.col("filter").isin("PASS", ".")
    return df.agg(F.count(F.lit(1)).alias("records"), n(snp).alias("snps"), n(indel).alias("indels"), n(~snp & ~indel).alias("other"), n(passed).alias("passed"), n(~passed).alias("filtered"), F.sum(ti).alias("ti"), F.sum(all_alts - ti).alias("tv"), F.avg("qual").alias("mean_qual"))


def sample_qc(calls: DataFrame) -> DataFrame:
    """Per sample: het, hom_alt, het_hom_ratio, call_rate, mean_het_ab (allele balance of heterozygotes with depth)."""
    het, hom, called = F.col("gt") == "0/1", F.col("gt") == "1/1", F.col("gt") != "./."
    depth = F.col("ref_depth") + F.col("alt_depth")
    g = calls.groupBy("sample").agg(F.count_if(het).alias("het"), F.count_if(hom).alias("hom_alt"), (F.count_if(called) / F.count(F.lit(1))).alias("call_rate"), F.avg(F.when(het & (depth > 0), F.col("alt_depth") / depth)).alias("mean_het_ab"))
    return g.withColumn("het_hom_ratio", F.col("het") / F.nullif("hom_alt", F.lit(0)))


def site_qc(calls: DataFrame) -> DataFrame:
    """Per site: call_rate, genotype counts, one-sided exact p of an excess of heterozygotes."""
    g = calls.groupBy("site").agg((F.count_if(F.col("gt") != "./.") / F.count(F.lit(1))).alias("call_rate"), *[F.count_if(F.col("gt") == v).alias(k) for k, v in (("hom_ref", "0/0"), ("het", "0/1"), ("hom_alt", "1/1"))])
    return g.withColumn("excess_het_p", tails.excess_het("het", "hom_ref", "hom_alt"))


def iterative_missingness(calls: DataFrame, *, min_gq: int = 0, min_depth: int = 0, depth: Column | None = None, sample_rate: float = 0.8, site_rate: float = 0.8) -> DataFrame:
    """Calls of the samples and sites that stay: genotypes of low quality or ``depth`` (an expression) are missing, then poor samples go, then poor sites, until nothing goes.

    Each round's names of samples and sites are written, not its calls, so the
    plan reads the input and two small tables whatever the round.
    """
    s = Scratch(calls.sparkSession, "missingness")
    good = F.col("gq") >= min_gq
    if depth is not None:
        good = good & (depth >= min_depth)
    d = s.saved(calls.withColumn("gt", F.when(good, F.col("gt")).otherwise("./.")), "calls", stays=True)
    rate = F.avg((F.col("gt") != "./.").cast("double"))
    samples, sites, n = None, None, None

    def left() -> DataFrame:
        x = d if samples is None else d.join(samples, "sample", "left_semi")
        return x if sites is None else x.join(sites, "site", "left_semi")

    while True:
        samples = s.saved(left().groupBy("sample").agg(rate.alias("_r")).where(F.col("_r") >= sample_rate).select("sample"), "samples", stays=True)
        sites = s.saved(left().groupBy("site").agg(rate.alias("_r")).where(F.col("_r") >= site_rate).select("site"), "sites", stays=True)
        now = (samples.count(), sites.count())
        if now == n:
            return left()
        n = now


def novel_fraction(variants: DataFrame, known: DataFrame, *, stratum: str, key: list[str] = KEY) -> DataFrame:
    """Per stratum: n, share not in ``known``, and Ti/Tv of the novel SNPs."""
    j = variants.join(known.select(*key).distinct().withColumn("_known", F.lit(True)), key, "left")
    novel = F.col("_known").isNull()
    pair = F.concat("ref", "alt")
    snp = novel & (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt"))
    g = j.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(novel.cast("double")).alias("novel"), F.count_if(snp & pair.isin(TRANSITIONS)).alias("_ti"), F.count_if(snp & ~pair.isin(TRANSITIONS)).alias("_tv"))
    return g.select(stratum, "n", "novel", (F.col("_ti") / F.nullif("_tv", F.lit(0))).alias("titv_novel"))


def genotype_discordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pair of samples (of ``a`` and ``b``) with called sites in common: sites, discordance. Pairs grow with samples squared per site; give it fingerprint sites."""
    x = a.where("gt <> './.'").select("site", F.col("sample").alias("sample_a"), F.col("gt").alias("_a"))
    y = b.where("gt <> './.'").select("site", F.col("sample").alias("sample_b"), F.col("gt").alias("_b"))
    return x.join(y, "site").groupBy("sample_a", "sample_b").agg(F.count(F.lit(1)).alias("sites"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("discordance"))


def recompute_ac_an(calls: DataFrame) -> DataFrame:
    """Per site after subsetting: ac, an, af."""
    alleles = F.filter(F.split("gt", "[/|]"), lambda g: g != ".")
    g = calls.groupBy("site").agg(F.sum(F.size(F.filter(alleles, lambda x: x != "0"))).alias("ac"), F.sum(F.size(alleles)).alias("an"))
    return g.withColumn("af", F.col("ac") / F.nullif("an", F.lit(0)))


def frequency_code(df: DataFrame, *, exome: str = "faf_exome", genome: str = "faf_genome", prevalence: float, genetic: float = 1.0, allelic: float = 1.0, penetrance: float = 1.0) -> DataFrame:
    """BA1, BS1 or PM2 from the filtering frequency (exome before genome) and the largest credible one."""
    most = prevalence * genetic * allelic / (2 * penetrance)
    f = F.coalesce(exome, genome)
    return df.withColumn("faf", f).withColumn("max_credible", F.lit(most)).withColumn("code", F.when(f > 0.05, "BA1").when(f > most, "BS1").when(f.isNull() | (f == 0), "PM2"))


def interval_label(df: DataFrame, bands: list[tuple[float | None, bool, float | None, bool, str]], *, value: str, out: str = "label") -> DataFrame:
    """Label of the band a value lies in; bands are (low, low closed, high, high closed, label), null ends are open."""
    c, v = F.lit(None).cast("string"), F.col(value)
    for lo, lo_in, hi, hi_in, name in reversed(bands):
        ok = F.lit(True)
        if lo is not None:
            ok = ok & ((v >= lo) if lo_in else (v > lo))
        if hi is not None:
            ok = ok & ((v <= hi) if hi_in else (v < hi))
        c = F.when(v.isNotNull() & ok, name).otherwise(c)
    return df.withColumn(out, c)


#: Points of each criterion at each strength: fixed values of the published point scale. A criterion's family is its name before '_'.
POINTS = {
    "PVS1_VeryStrong": 8, "PVS1_Strong": 4, "PVS1_Moderate": 2, "PVS1_Supporting": 1, "PS1": 4, "PS2": 4, "PS3_VeryStrong": 8, "PS3": 4, "PS3_Moderate": 2, "PS3_Supporting": 1, "PS4": 4, "PS4_Moderate": 2, "PS4_Supporting": 1,
    "PM1": 2, "PM2_Supporting": 1, "PM2": 1, "PM3": 2, "PM3_Strong": 4, "PM3_VeryStrong": 8, "PM4": 2, "PM5": 2, "PM6": 2, "PP1": 1, "PP1_Moderate": 2, "PP1_Strong": 4, "PP2": 1, "PP3_Supporting": 1, "PP3_Moderate": 2, "PP3_3pt": 3, "PP3_Strong": 4, "PP4": 1,
    "BA1": -100, "BS1": -4, "BS2": -4, "BS3": -4, "BS3_Moderate": -2, "BS3_Supporting": -1, "BS4": -4, "BP1": -1, "BP2": -1, "BP3": -1, "BP4_Supporting": -1, "BP4_Moderate": -2, "BP4_3pt": -3, "BP4_Strong": -4, "BP4_VeryStrong": -8, "BP5": -1, "BP7": -1,
}
#: Criteria that are no longer used: fixed values.
RETIRED = ["PP5", "BP6"]


def evidence_points(df: DataFrame, *, criteria: str = "criteria") -> DataFrame:
    """Sum of points and class of an array of criteria such as PVS1_Strong, PM2, BP4_Moderate.

    Beside any PVS1, PP3 and PM4 don't count; BA1 is always Benign. Retired,
    unknown or repeated criteria, two of one family, and PP3 beside BP4 are a
    problem: it is named, and points and class are null.
    """
    c = F.col(criteria)
    family = lambda x: F.split(x, "_")[0]
    families = F.transform(c, family)
    problem = (
        F.when(F.exists(c, lambda x: x.isin(RETIRED)), "retired criterion")
        .when(F.exists(c, lambda x: ~F.coalesce(x.isin(list(POINTS)), F.lit(False))), "unknown criterion")
        .when(F.size(F.array_distinct(c)) < F.size(c), "repeated criterion")
        .when(F.size(F.array_distinct(families)) < F.size(c), "several of one family")
        .when(F.array_contains(families, "PP3") & F.array_contains(families, "BP4"), "conflicting family")
    )
    counted = F.when(F.array_contains(families, "PVS1"), F.filter(c, lambda x: ~family(x).isin("PP3") & (x != "PM4"))).otherwise(c)
    table = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    points = F.aggregate(counted, F.lit(0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0)))
    p = F.col("points")
    d = df.withColumn("problem", problem).withColumn("points", F.when(F.col("problem").isNull(), points))
    label = F.when(p.isNull(), F.lit(None)).when(F.array_contains(c, "BA1"), "Benign").when(p >= 10, "Pathogenic").when(p >= 6, "Likely Pathogenic").when(p >= 0, "VUS").when(p >= -6, "Likely Benign").otherwise("Benign")
    return d.withColumn("class", label)


def gene_by_sample_matrix(mutations: DataFrame, cohort: DataFrame, *, top: int = 20) -> DataFrame:
    """(gene, sample, classes, gene_rank) of the genes mutated in most samples; every cohort sample appears with every top gene."""
    per = mutations.groupBy("gene", "sample").agg(F.array_join(F.array_sort(F.collect_set("class")), ";").alias("classes"))
    genes = per.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gene").limit(top)
    genes = genes.withColumn("gene_rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "gene"))).select("gene", "gene_rank")
    grid = genes.crossJoin(cohort.select("sample").distinct())  # a few top genes by the cohort
    return grid.join(per, ["gene", "sample"], "left").fillna("", ["classes"])


def mutation_burden(mutations: DataFrame, cohort: DataFrame) -> DataFrame:
    """Mutations per cohort sample, missing as 0, with the rank by (-burden, sample)."""
    g = mutations.groupBy("sample").agg(F.count(F.lit(1)).alias("burden"))
    j = cohort.select("sample").distinct().join(g, "sample", "left").fillna(0, ["burden"])
    return j.withColumn("rank", F.row_number().over(Window.orderBy(F.col("burden").desc(), "sample")))


def gene_burden(carriers: DataFrame, genes: DataFrame, phenotype: DataFrame, *, max_af: float = 0.01) -> DataFrame:
    """Burden score test per gene over carriers (variant, sample, dosage, af): genes, carriers, score, var, z, p.

    Weights are Beta(af; 1, 25). With phenotype residuals y - mean, the score is
    sum(w g (y - mean)); samples without a rare allele add zero and are counted in closed form.
    """
    n, mean, var = phenotype.agg(F.count("y"), F.avg("y"), F.var_pop("y")).first()
    w = 25 * F.pow(1 - F.col("af"), 24)
    d = carriers.where(F.col("af") <= max_af).join(genes, "variant").groupBy("gene", "sample").agg(F.sum(w * F.col("dosage")).alias("b"))
    d = d.join(phenotype, "sample")
    g = d.groupBy("gene").agg(F.count(F.lit(1)).alias("carriers"), F.sum(F.col("b") * (F.col("y") - mean)).alias("score"), F.sum("b").alias("_s1"), F.sum(F.col("b") * F.col("b")).alias("_s2"))
    v = var * (F.col("_s2") - F.col("_s1") * F.col("_s1") / n)
    return g.select("gene", "carriers", "score", v.alias("var"), F.when(v > 0, F.col("score") / F.sqrt(v)).alias("z")).withColumn("p", tails.norm_two_sided("z"))


def score_concordance(inputs: DataFrame, tools: dict[str, tuple[DataFrame, float, bool]], *, key: list[str] = KEY) -> DataFrame:
    """Left join of inputs to each tool's best score per variant; how many tools scored it and reached their threshold, and the class.

    A tool is (table, threshold, whether its score is signed): a signed score
    is the one of largest magnitude and its magnitude is compared; others are
    the largest. Fewer than two scores are insufficient.
    """
    out = inputs.select(*key).distinct()
    scored, above = F.lit(0), F.lit(0)
    for name, (t, least, signed) in tools.items():
        best = t.groupBy(*key).agg((F.max_by("score", F.abs("score")) if signed else F.max("score")).alias(name))
        out = out.join(best, key, "left")
        scored = scored + F.col(name).isNotNull().cast("int")
        above = above + F.coalesce(((F.abs(name) if signed else F.col(name)) >= least).cast("int"), F.lit(0))
    out = out.withColumn("n_scored", scored).withColumn("n_above", above)
    n, a = F.col("n_scored"), F.col("n_above")
    label = F.when(n < 2, "insufficient_tools").when(a == 0, "none_predict_disruption").when(a == n, "all_predict_disruption").when(a * 2 > n, "majority_predict_disruption").otherwise("discordant")
    return out.withColumn("class", label)


def unscored_report(inputs: DataFrame, scored: DataFrame, *, key: list[str] = KEY) -> DataFrame:
    """Inputs that a tool skipped."""
    return inputs.join(scored.select(*key), key, "left_anti")


def coordinate_sort(df: DataFrame, *, contigs: list[str] | None = None, contig: str = "chrom", pos: str = "pos") -> DataFrame:
    """Rows by contig (in the given order, else by name) and position, sorted across range partitions."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, contigs)), F.col(contig)), F.lit(0)) if contigs else F.col(contig)
    return df.withColumn("_o", order).repartitionByRange("_o", pos).sortWithinPartitions("_o", pos).drop("_o")
