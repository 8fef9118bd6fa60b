"""Feature by sample tables in long form: quality, normalising, screens, abundance, proteomics matrices, metabolites, taxa."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators.intervals import point_in_segment
from strandloom.operators.principal import leading_components
from strandloom.operators.stats import adjust_p, quantiles, rank_sums, ranked
from strandloom.scratch import Scratch


def median(c: str | Column) -> Column:
    return F.percentile(c, 0.5)


def melt(df: DataFrame, *, ids: list[str], pattern: str | None = None, name: str = "sample", value: str = "value") -> DataFrame:
    """Wide to long: the columns that match the pattern (all others than ids without one)."""
    cols = [c for c in df.columns if c not in ids and (pattern is None or __import__("re").search(pattern, c))]
    return df.unpivot(ids, cols, name, value)


def pivot_matrix(df: DataFrame, *, rows: list[str], column: str, value: str, values: list) -> DataFrame:
    """Long to wide with an explicit list of columns; the first value in order where a cell has several."""
    return df.groupBy(*rows).pivot(column, values).agg(F.min(value))


def drop_bookkeeping_rows(df: DataFrame, *, flags: list[str], ids: str = "protein_ids") -> DataFrame:
    """Rows without a '+' in any flag column, with the leading id."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & (F.coalesce(F.col(f), F.lit("")) != "+")
    return df.where(ok).withColumn("leading_id", F.split(ids, ";")[0])


def zero_to_null_log2(df: DataFrame, *, value: str = "value", out: str = "log2") -> DataFrame:
    """log2 of a value; 0 means not quantified."""
    return df.withColumn(out, F.when(F.col(value) > 0, F.log2(F.col(value).cast("double"))))


def completeness_filter(df: DataFrame, samples: DataFrame, *, share: float = 0.7, feature: str = "feature", sample: str = "sample", group: str = "grp", value: str = "value") -> DataFrame:
    """Rows of features with values in at least ``share`` of the samples of some group; the sample sheet gives the denominators."""
    size = samples.groupBy(group).agg(F.count_distinct(sample).alias("_n"))
    seen = df.where(F.col(value).isNotNull()).join(samples.select(sample, group), sample).groupBy(feature, group).agg(F.count_distinct(sample).alias("_k"))
    keep = seen.join(F.broadcast(size), group).where(F.col("_k") >= share * F.col("_n")).select(feature).distinct()
    return df.join(keep, feature, "left_semi")


def prevalence_filter(df: DataFrame, *, least: int, feature: str = "feature", sample: str = "sample", value: str = "n") -> DataFrame:
    """Rows of features above 0 in at least ``least`` samples."""
    keep = df.where(F.col(value) > 0).groupBy(feature).agg(F.count_distinct(sample).alias("_k")).where(F.col("_k") >= least).select(feature)
    return df.join(keep, feature, "left_semi")


def library_representation(df: DataFrame, *, sample: str = "sample", value: str = "n", features: int | None = None) -> DataFrame:
    """Per sample: detected, percent zero, percent below 30, median, p10, p90, skew (p90 / p10)."""
    v = F.col(value)
    p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(sample).agg(F.count_if(v > 0).alias("detected"), (100 * F.avg((v == 0).cast("double"))).alias("pct_zero"), (100 * F.avg((v < 30).cast("double"))).alias("pct_below_30"), p.alias("_p"))
    return g.select(sample, "detected", "pct_zero", "pct_below_30", F.col("_p")[1].alias("median"), F.col("_p")[0].alias("p10"), F.col("_p")[2].alias("p90"), (F.col("_p")[2] / F.nullif(F.col("_p")[0], F.lit(0.0))).alias("skew"))


def gini(df: DataFrame, *, sample: str = "sample", value: str = "n", feature: str = "feature") -> DataFrame:
    """Gini coefficient of the positive counts of each sample; null if there is none."""
    d = ranked(df.where(F.col(value) > 0), value, by=[sample], tie_break=[feature], out="_i")
    g = d.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_i").cast("double") * F.col(value)).alias("_w"), F.sum(value).alias("_s"))
    return g.select(sample, "n", (2 * F.col("_w") / (F.col("n") * F.col("_s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def sample_correlations(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "x", group: str | None = None) -> DataFrame:
    """Pearson and Spearman of all pairs of samples (of one group, where given) over common features."""
    d = ranked(df.where(F.col(value).isNotNull()), value, by=[sample], ties="average", out="_r")
    cols = [feature, sample, value, "_r", *([group] if group else [])]
    a, b = (d.select(F.col(feature), *[F.col(c).alias(f"{c}_{k}") for c in cols[1:]]) for k in "ab")
    j = a.join(b, feature).where(F.col(f"{sample}_a") < F.col(f"{sample}_b"))
    if group:
        j = j.where(F.col(f"{group}_a") == F.col(f"{group}_b"))
    return j.groupBy(f"{sample}_a", f"{sample}_b").agg(F.count(F.lit(1)).alias("features"), F.corr(f"{value}_a", f"{value}_b").alias("pearson"), F.corr("_r_a", "_r_b").alias("spearman"))


def unmeasurable_groups(samples: DataFrame, *, group: str = "grp") -> DataFrame:
    """Groups of one sample, whose replicates can't be compared."""
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n = 1")


def sample_swap_check(df: DataFrame, samples: DataFrame, *, top: int = 300, feature: str = "feature", sample: str = "sample", group: str = "grp", value: str = "x") -> DataFrame:
    """Mean correlation of each sample to its own group and to the best one, over complete features of greatest variance, centred per feature. A group of one can't be measured; ties go to the first group."""
    n = samples.count()
    f = df.where(F.col(value).isNotNull()).groupBy(feature).agg(F.count(F.lit(1)).alias("k"), F.var_samp(value).alias("v"), F.avg(value).alias("_m")).where(F.col("k") == n).orderBy(F.col("v").desc(), feature).limit(top)
    d = df.join(f.select(feature, "_m"), feature).withColumn(value, F.col(value) - F.col("_m")).drop("_m")
    c = sample_correlations(d, feature=feature, sample=sample, value=value)
    both = c.select(F.col(f"{sample}_a").alias(sample), F.col(f"{sample}_b").alias("_o"), "pearson").unionByName(c.select(F.col(f"{sample}_b").alias(sample), F.col(f"{sample}_a").alias("_o"), "pearson"))
    m = both.join(samples.select(F.col(sample).alias("_o"), F.col(group).alias("_g")), "_o").groupBy(sample, "_g").agg(F.avg("pearson").alias("_c"))
    best = m.groupBy(sample).agg(F.min(F.struct((-F.col("_c")).alias("c"), "_g")).alias("_b")).select(sample, F.col("_b._g").alias("best_group"), (-F.col("_b.c")).alias("r_best"))
    own = m.select(sample, F.col("_g").alias(group), F.col("_c").alias("r_own"))
    j = samples.select(sample, group).join(best, sample, "left").join(own, [sample, group], "left")
    return j.withColumn("status", F.when(F.col("r_own").isNotNull(), "measured").otherwise("not_measurable_n1")).withColumn("possible_swap", F.when(F.col("r_own").isNotNull(), F.col(group) != F.col("best_group")))


def normalize_cpm_log(df: DataFrame, *, sample: str = "sample", value: str = "n", scale: float | str = 1e6, log: str = "log2", offset: float = 1.0, out: str = "x") -> DataFrame:
    """Counts scaled to a common total per sample (``scale`` or 'median'), then log2(x + offset) or log1p."""
    total = df.groupBy(sample).agg(F.sum(value).alias("_t"))
    to = F.lit(float(scale)) if scale != "median" else F.col("_scale")
    d = df.join(total, sample)
    if scale == "median":
        d = d.crossJoin(total.agg(median("_t").alias("_scale")))  # one row
    x = F.col(value) / F.nullif("_t", F.lit(0)) * to
    return d.withColumn(out, F.log2(x + offset) if log == "log2" else F.log1p(x) if log == "log1p" else x).drop("_t", "_scale")


def guide_lfc(df: DataFrame, *, late: list, plasmid, controls: Column, feature: str = "feature", sample: str = "sample", value: str = "x", pseudo: float = 0.5) -> DataFrame:
    """Mean log2 fold change of late samples over the plasmid, centred on the median of the control features. ``value`` is scaled counts."""
    g = df.groupBy(feature).agg(F.avg(F.when(F.col(sample) == plasmid, F.col(value))).alias("_p"), *[F.avg(F.when(F.col(sample) == s, F.col(value))).alias(f"_l{i}") for i, s in enumerate(late)])
    g = g.fillna(0, ["_p", *[f"_l{i}" for i in range(len(late))]])
    lfc = sum((F.log2((F.col(f"_l{i}") + pseudo) / (F.col("_p") + pseudo)) for i in range(len(late))), F.lit(0.0)) / len(late)
    g = g.select(feature, lfc.alias("lfc"))
    mid = quantiles(g.where(controls), "lfc", [0.5])[0] or 0.0
    return g.select(feature, (F.col("lfc") - F.lit(mid)).alias("lfc"))


def gene_zscore(df: DataFrame, *, controls: Column | None = None, gene: str = "gene", value: str = "lfc") -> DataFrame:
    """Per gene: mean, sd, n, z of its mean against the median and sd of the control genes' means (of all genes without controls), p and BH."""
    g = df.groupBy(gene).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    own = g if controls is None else g.where(controls)
    g = g.crossJoin(own.agg(F.lit(quantiles(own, "mean", [0.5])[0]).cast("double").alias("_m"), F.stddev_samp("mean").alias("_s"))).withColumn("z", (F.col("mean") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")  # one row
    return adjust_p(g.withColumn("p", tails.norm_two_sided("z")))


def second_best(df: DataFrame, *, gene: str = "gene", value: str = "lfc", guide: str = "guide") -> DataFrame:
    """The second most extreme value per gene; null and a flag where there is one guide only."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(gene).orderBy(F.abs(value).desc(), guide)))
    return r.groupBy(gene).agg(F.count(F.lit(1)).alias("guides"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second_best")).withColumn("single_guide", F.col("guides") < 2)


def gene_rank_test(df: DataFrame, null: DataFrame, *, gene: str = "gene", value: str = "lfc", floor: float = -1.0, alpha: float = 0.05) -> DataFrame:
    """Per gene: median, one-sided rank test against the null guides (lower), BH and call.

    p is exact where either side has eight values at most and none are tied,
    else normal with continuity correction. The null set is a bounded list of
    control guides.
    """
    genes = df.select(gene).distinct()
    both = df.select(gene, value, F.lit(True).alias("is_case")).unionByName(genes.crossJoin(F.broadcast(null.select(value))).select(gene, value, F.lit(False).alias("is_case")))
    t = rank_sums(both, feature=gene, value=value).withColumn("p", tails.rank_less_p("u", "n1", "n2", "ties"))
    m = df.groupBy(gene).agg(median(value).alias("median_lfc"))
    q = adjust_p(m.join(t.select(gene, "u", "p"), gene))
    return q.withColumn("call", (F.col("q") < alpha) & (F.col("median_lfc") <= floor))


def copy_number_correct(df: DataFrame, segments: DataFrame, *, gene: str = "gene", value: str = "lfc", least_genes: int = 5, cut: float = 0.3) -> DataFrame:
    """Guide values minus their segment's median where it holds enough genes and its copy number is off 2. Rows have contig and at (the gene's midpoint)."""
    d = point_in_segment(df, segments.withColumn("segment_cn", F.struct("start", "copy_number")), value="segment_cn")
    seg = d.where("segment_cn is not null").groupBy("contig", "segment_cn").agg(F.count_distinct(gene).alias("_g"), median(value).alias("_m"))
    off = (F.col("_g") >= least_genes) & (F.abs(F.log2(F.col("segment_cn.copy_number") / 2)) > cut)
    return d.join(seg, ["contig", "segment_cn"], "left").withColumn("copy_number", F.col("segment_cn.copy_number")).withColumn("residual", F.col(value) - F.coalesce(F.when(off, F.col("_m")), F.lit(0.0))).drop("_g", "_m", "segment_cn")


def cn_bias(df: DataFrame, *, value: str = "lfc", cn: str = "copy_number", bins: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row, a row per bin) of the dependence of gene values on copy number.

    The row has Spearman's rho and its p, amplified (> 4) and diploid (1.5 to
    2.5) genes, their means, the gap and the rank test's p that amplified genes
    are lower (with three on each side), and the flag. Bins are quantiles of
    copy number, closed on the right.
    """
    r = ranked(ranked(df.select(value, cn), value, ties="average", out="rank_v"), cn, ties="average", out="rank_cn")
    amp, dip = F.col(cn) > 4, F.col(cn).between(1.5, 2.5)
    g = r.agg(F.corr("rank_v", "rank_cn").alias("rho"), F.count(F.lit(1)).alias("n"), F.count_if(amp).alias("amplified"), F.count_if(dip).alias("diploid"), F.avg(F.when(amp, F.col(value))).alias("amplified_mean"), F.avg(F.when(dip, F.col(value))).alias("diploid_mean"))
    t = rank_sums(df.where(amp | dip).select(F.lit(1).alias("feature"), F.col(value).alias("value"), amp.alias("is_case"))).withColumn("_p", tails.rank_less_p("u", "n1", "n2", "ties")).select("_p")
    j = g.join(t, F.lit(True), "left")  # one row each
    enough = (F.col("amplified") >= 3) & (F.col("diploid") >= 3)
    j = j.withColumn("p", tails.t_p(F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0))), (F.col("n") - 2).cast("double")))
    j = j.withColumn("gap", F.when(enough, F.col("amplified_mean") - F.col("diploid_mean"))).withColumn("p_gap", F.when(enough, F.col("_p")))
    flag = ((F.col("rho") < -0.1) & (F.col("p") < 0.01)) | F.coalesce((F.col("gap") < -0.5) & (F.col("p_gap") < 0.01), F.lit(False))
    edges = sorted({x for x in quantiles(df, cn, [k / bins for k in range(1, bins)]) if x is not None})
    d = df.withColumn("bin", sum(((F.lit(x) < F.col(cn)).cast("int") for x in edges), F.lit(0)))
    per = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), median(value).alias("median"), F.stddev_samp(value).alias("sd"))
    return j.select("rho", "p", "n", "amplified", "diploid", "amplified_mean", "diploid_mean", "gap", "p_gap", F.coalesce(flag, F.lit(False)).alias("cn_bias")), per


def genetic_interaction(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """Interaction of gene pairs (a, b, lfc) against the sum of single effects (gene, lfc): gi, z (population sd), p, BH, class."""
    g = pairs.groupBy("a", "b").agg(F.avg("lfc").alias("mean"), F.stddev_samp("lfc").alias("sd"), F.count("lfc").alias("n"))
    s = singles.groupBy("gene").agg(F.avg("lfc").alias("single"))
    g = g.join(s.select(F.col("gene").alias("a"), F.col("single").alias("_a")), "a").join(s.select(F.col("gene").alias("b"), F.col("single").alias("_b")), "b")
    g = g.withColumn("expected", F.col("_a") + F.col("_b")).withColumn("gi", F.col("mean") - F.col("expected")).drop("_a", "_b")
    g = g.crossJoin(g.agg(F.avg("gi").alias("_m"), F.stddev_pop("gi").alias("_s"))).withColumn("z", (F.col("gi") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")  # one row
    q = adjust_p(g.withColumn("p", tails.norm_two_sided("z")))
    return q.withColumn("class", F.when((F.col("q") < 0.05) & (F.col("z") < 0), "synthetic_lethal").when((F.col("q") < 0.05) & (F.col("z") > 0), "synthetic_rescue").otherwise("no_interaction"))


def dose_consistent(df: DataFrame, *, gene: str = "gene", dose: str = "dose", effect: str = "effect", fdr: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """Genes with an effect at every dose of the table, of one sign, and significant at the top dose, with whether the effect grows with every step."""
    doses = df.agg(F.count_distinct(dose).alias("_doses"))
    w = Window.partitionBy(gene).orderBy(dose)
    d = df.where(F.col(effect).isNotNull()).withColumn("_step", F.abs(effect) >= F.coalesce(F.abs(F.lag(effect).over(w)), F.lit(0.0)))
    g = d.groupBy(gene).agg(F.min(F.signum(effect)).alias("_a"), F.max(F.signum(effect)).alias("_b"), F.max_by(fdr, dose).alias("top_fdr"), F.max_by(effect, dose).alias("top_effect"), F.min("_step").alias("monotonic"), F.count_distinct(dose).alias("_k"))
    return g.crossJoin(doses).where((F.col("_k") == F.col("_doses")) & (F.col("_a") == F.col("_b")) & (F.col("_a") != 0) & (F.col("top_fdr") < alpha)).select(gene, "top_effect", "top_fdr", "monotonic")  # one row


def variant_scores(scores: DataFrame, annotation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean, sd and count per variant over guides without bystander edits, and the other guides."""
    j = scores.join(annotation, "guide")
    clean = j.where("bystanders = 0").groupBy("variant").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n"))
    return clean, j.where("bystanders > 0")


def assign_guide_per_cell(df: DataFrame, *, cell: str = "cell", guide: str = "guide", value: str = "n", least: int = 5) -> DataFrame:
    """A cell's guide, 'multiplet' or 'none', by the number of guides at the threshold; ties go to the first guide."""
    g = df.groupBy(cell).agg(F.count_if(F.col(value) >= least).alias("guides"), F.min(F.struct((-F.col(value)).alias("k"), F.col(guide).alias("g"))).alias("_t"))
    return g.select(cell, "guides", F.when(F.col("guides") == 0, "none").when(F.col("guides") > 1, "multiplet").otherwise(F.col("_t.g").cast("string")).alias("assignment"))


def median_center(df: DataFrame, *, sample: str = "sample", value: str = "x") -> DataFrame:
    """Log values with each sample's median taken to the median of medians."""
    m = df.groupBy(sample).agg(median(value).alias("_m"))
    return df.join(m, sample).crossJoin(m.agg(median("_m").alias("_all"))).withColumn("centred", F.col(value) - F.col("_m") + F.col("_all")).drop("_m", "_all")  # one row


def loading_normalize(df: DataFrame, *, sample: str = "sample", value: str = "value") -> DataFrame:
    """Values scaled so that every sample has the mean total."""
    t = df.groupBy(sample).agg(F.sum(value).alias("_t"))
    return df.join(t, sample).crossJoin(t.agg(F.avg("_t").alias("_m"))).withColumn("scaled", F.col(value) * F.col("_m") / F.nullif("_t", F.lit(0.0))).drop("_t", "_m")  # one row


def irs_bridge(df: DataFrame, *, feature: str = "feature", plex: str = "plex", is_reference: str = "is_ref", value: str = "value") -> DataFrame:
    """Values scaled per feature so that the plexes' reference channels share their geometric mean; features without references in all plexes get null."""
    n = df.select(plex).distinct().count()
    r = df.where(F.col(is_reference) & (F.col(value) > 0)).groupBy(feature, plex).agg(F.exp(F.avg(F.log(value))).alias("_r"))
    t = r.groupBy(feature).agg(F.exp(F.avg(F.log("_r"))).alias("_g"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == n)
    return df.join(r, [feature, plex], "left").join(t, feature, "left").withColumn("bridged", F.col(value) * F.col("_g") / F.col("_r")).drop("_r", "_g", "_k")


def apms_score(df: DataFrame, *, prey: str = "prey", run: str = "run", is_control: str = "is_control", value: str = "value", cut: float = 2.0, least_baits: int | None = None) -> DataFrame:
    """log2 enrichment of preys (prey, run, is_control, value; 0 and missing: not detected) in baits over controls, and the call.

    A control run without a prey counts at its own floor (its least value);
    control runs without data are left out. The worst case is the weakest bait
    over the strongest control. Called are preys in ``least_baits`` bait runs
    (all of them) that no control has or whose enrichment reaches ``cut``.
    """
    c, seen = F.col(is_control), F.col(value) > 0
    runs = df.groupBy(run).agg(F.max(c).alias("_c"), F.min(F.when(seen, F.log2(F.col(value).cast("double")))).alias("_floor"))
    n_baits, n_alive, n_controls = runs.agg(F.count_if(~F.col("_c")), F.count_if(F.col("_c") & F.col("_floor").isNotNull()), F.count_if("_c")).first()
    if n_controls and not n_alive:
        raise ValueError("every control run is empty")
    d = df.where(seen).select(prey, run, c.alias("_c"), F.log2(F.col(value).cast("double")).alias("_l"))
    floors = runs.where("_c and _floor is not null").select(run, "_floor")
    grid = df.select(prey).distinct().crossJoin(F.broadcast(floors))  # control runs are few
    con = grid.join(d.where("_c"), [prey, run], "left").groupBy(prey).agg(F.count("_l").alias("n_ctrl"), F.avg(F.coalesce("_l", "_floor")).alias("_mean"), F.max(F.coalesce("_l", "_floor")).alias("_max"))
    bait = d.where("not _c").groupBy(prey).agg(F.count(F.lit(1)).alias("n_bait"), F.avg("_l").alias("_b"), F.min("_l").alias("_low"))
    j = con.join(bait, prey, "left").fillna(0, ["n_bait"])
    enrich = F.col("_b") - F.col("_mean")
    call = (F.col("n_bait") >= (least_baits or n_baits)) & ((F.col("n_ctrl") == 0) | F.coalesce(enrich >= cut, F.lit(False)))
    return j.select(prey, "n_bait", "n_ctrl", F.lit(n_alive).cast("long").alias("n_ctrl_runs_used"), enrich.alias("log2_enrichment"), (F.col("_low") - F.col("_max")).alias("worst_case_log2"), call.alias("interactor"))


def silac_checks(df: DataFrame, *, heavy: str = "heavy", light: str = "light", prolines: str = "prolines") -> DataFrame:
    """One row: incorporation over proline-free peptides with signal, their median and how many are below 95 %, the bias it gives a 1:1 mix, and the slope of log2 H/L on the number of prolines."""
    h, t = F.coalesce(F.col(heavy), F.lit(0.0)), F.coalesce(F.col(heavy), F.lit(0.0)) + F.coalesce(F.col(light), F.lit(0.0))
    use = (t > 0) & (F.col(prolines) == 0)
    share = F.when(use, h / F.nullif(t, F.lit(0.0)))
    ratio = F.when((F.col(heavy) > 0) & (F.col(light) > 0), F.log2(F.col(heavy) / F.col(light)))
    g = df.agg(F.count_if(use).alias("n_peptides"), F.count_if(t > 0).alias("n_signal_peptides"), (F.sum(F.when(use, h)) / F.sum(F.when(use, t))).alias("incorporation"), median(share).alias("median_peptide_incorporation"), F.count_if(share < 0.95).alias("peptides_below_95pct"), F.regr_slope(ratio, F.when(ratio.isNotNull(), F.col(prolines).cast("double"))).alias("log2_slope_per_proline"))
    e = F.col("incorporation")
    return g.withColumn("expected_log2_bias_at_1to1", F.log2(e / (2 - e))).withColumn("conversion_per_proline", 1 - F.pow(F.lit(2.0), F.col("log2_slope_per_proline"))).withColumn("pass_95pct", e >= 0.95)


def cv_and_missingness(df: DataFrame, samples: DataFrame, *, feature: str = "feature", sample: str = "sample", group: str = "grp", value: str = "value") -> DataFrame:
    """Per group: median CV (linear scale), median geometric CV, features with one value only."""
    d = df.where(F.col(value) > 0).join(samples, sample)
    g = d.groupBy(group, feature).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(value) / F.avg(value)).alias("cv"), F.sqrt(F.exp(F.var_samp(F.log(value))) - 1).alias("gcv"))
    return g.groupBy(group).agg(median("cv").alias("median_cv"), median("gcv").alias("median_gcv"), F.count_if(F.col("n") == 1).alias("singletons"))


def presence_by_abundance(df: DataFrame, *, samples: int, feature: str = "feature", value: str = "value", bins: int = 10) -> DataFrame:
    """Share of samples with a value by decile of the features' mean log2 value."""
    g = df.where(F.col(value) > 0).groupBy(feature).agg(F.avg(F.log2(F.col(value).cast("double"))).alias("a"), (F.count(F.lit(1)) / samples).alias("present"))
    e = g.agg(F.percentile("a", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_e"))
    return g.crossJoin(F.broadcast(e)).withColumn("bin", F.size(F.filter("_e", lambda x: x <= F.col("a")))).groupBy("bin").agg(F.count(F.lit(1)).alias("features"), F.avg("present").alias("present"))  # one row


def expand_site_multiplicity(df: DataFrame, *, ids: list[str], probability: str = "probability", least: float = 0.75, pattern: str = r"^(.+)___(\d)$") -> DataFrame:
    """Wide site intensities (columns run___k) to (ids, run, multiplicity, log2), for sites localised well enough; zeros go."""
    d = melt(df.where(F.col(probability) >= least), ids=[*ids, probability], pattern=pattern, name="_c")
    return d.where(F.col("value") > 0).select(*ids, F.regexp_extract("_c", pattern, 1).alias("run"), F.regexp_extract("_c", pattern, 2).cast("int").alias("multiplicity"), F.log2(F.col("value").cast("double")).alias("log2"))


def _ols(moments: list[np.ndarray], k: int, at: int) -> pd.DataFrame:
    """Slope, unscaled variance, residual variance and degrees of freedom of design column ``at`` of many features, from their counts and their covariances (upper triangles by row, the value last)."""
    n, m = moments[0], np.empty((len(moments[0]), k + 1, k + 1))
    for (i, j), c in zip([(i, j) for i in range(k + 1) for j in range(i, k + 1)], moments[1:]):
        m[:, i, j] = m[:, j, i] = c * n
    out = np.full((4, len(n)), np.nan)
    sd = np.sqrt(np.diagonal(m, axis1=1, axis2=2)[:, :k])
    some = np.flatnonzero((n > k + 1) & np.isfinite(m).all(axis=(1, 2)) & (sd > 0).all(axis=1))
    r = m[some][:, :k, :k] / (sd[some][:, :, None] * sd[some][:, None, :])
    full = np.linalg.eigvalsh(r)[:, 0] > 1e-11 if len(some) else np.zeros(0, bool)
    some, r = some[full], r[full]
    if len(some):
        inverse = np.linalg.inv(r) / (sd[some][:, :, None] * sd[some][:, None, :])
        xy, yy, df = m[some][:, :k, k], m[some][:, k, k], n[some] - k - 1
        beta = np.einsum("nij,nj->ni", inverse, xy)
        rest = yy - (beta * xy).sum(axis=1)
        out[:, some] = beta[:, at], inverse[:, at, at], np.where(rest > 1e-13 * yy, rest, 0.0) / df, df
    return pd.DataFrame(dict(zip(("beta", "unscaled", "s2", "df"), out)))


def feature_ols(df: DataFrame, *, design: list[str], term: str, feature: str = "feature", value: str = "x") -> DataFrame:
    """Least squares per feature on numeric covariates over observed values: n, beta, se, s2, df, t, p for one term; rank-deficient features are null.

    A feature's covariances come from one aggregation, so none lies in a task
    whole. Covariates whose correlations have an eigenvalue of 1e-11 or less
    are rank-deficient; residuals below 1e-13 of the value's own squares are
    rounding and count as 0.
    """
    names = [*design, value]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = df.select(feature, *[F.when(ok, F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    g = d.groupBy(feature).agg(F.count("_0").alias("n"), *[F.covar_pop(f"_{i}", f"_{j}").alias(f"_{i}_{j}") for i, j in pairs])

    @F.pandas_udf("beta double, unscaled double, s2 double, df double")
    def solved(*moments: pd.Series) -> pd.DataFrame:
        return _ols([m.to_numpy(float, na_value=np.nan) for m in moments], len(design), design.index(term))

    g = g.withColumn("_f", solved("n", *[f"_{i}_{j}" for i, j in pairs])).select(feature, "n", "_f.*")
    g = g.withColumn("se", F.sqrt(F.col("unscaled") * F.col("s2"))).withColumn("t", F.col("beta") / F.nullif("se", F.lit(0.0)))
    return g.withColumn("p", tails.t_p("t", "df"))


def moderated_t(df: DataFrame) -> DataFrame:
    """Variances of ``feature_ols`` shrunk to a common prior (by moments of their logs), with the t and p that follow."""

    def each(d: pd.Series, f) -> np.ndarray:
        """f of half the degrees of freedom, once for each distinct number of them; NaN for none."""
        return d.map({b: f(b / 2) for b in d.dropna().unique() if b > 0}).to_numpy(float, na_value=np.nan)

    @F.pandas_udf("double")
    def e_of(s2: pd.Series, d: pd.Series) -> pd.Series:
        a = s2.where(s2 > 0).to_numpy(float, na_value=np.nan)
        return pd.Series(np.log(a) - each(d, lambda h: tails.digamma(h) - math.log(h)))

    @F.pandas_udf("double")
    def tri(d: pd.Series) -> pd.Series:
        return pd.Series(each(d, tails.trigamma))

    df = Scratch(df.sparkSession, "moderated").saved(df, "terms", stays=True)
    m = df.withColumn("_e", e_of("s2", "df")).agg(F.avg("_e"), F.var_samp("_e"), F.avg(tri("df"))).first()
    if m[0] is None or m[1] is None:
        return df.withColumn("s2_post", F.col("s2")).withColumn("df_total", F.col("df")).withColumn("t_mod", F.col("t")).withColumn("p_mod", F.col("p"))
    spread = m[1] - m[2]
    d0 = 2 * tails.trigamma_inverse(spread) if spread > 0 else float("inf")
    s0 = float(np.exp(m[0] + (tails.digamma(d0 / 2) - np.log(d0 / 2) if np.isfinite(d0) else 0.0)))
    post = (F.lit(d0) * s0 + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df")) if np.isfinite(d0) else F.lit(s0)
    total = F.least(F.lit(d0), F.lit(1e9)) + F.col("df")
    d = df.withColumn("s2_post", post).withColumn("df_total", total).withColumn("t_mod", F.col("beta") / F.sqrt(F.col("unscaled") * F.col("s2_post")))
    return d.withColumn("p_mod", tails.t_p("t_mod", "df_total"))


def qc_feature_filter(df: DataFrame, *, feature: str = "feature", value: str = "value", is_qc: str = "is_qc", samples: int, detection: float = 0.5, rsd: float = 0.3, d_ratio: float = 0.5) -> DataFrame:
    """Per feature: detection share, QC RSD, MAD(QC) / MAD(biological) (MADs x 1.4826), kept; null never keeps."""
    q = F.col(is_qc)
    m = df.groupBy(feature).agg((F.count(F.when(F.col(value) > 0, 1)) / samples).alias("detection"), (F.stddev_samp(F.when(q, F.col(value))) / F.avg(F.when(q, F.col(value)))).alias("qc_rsd"), median(F.when(q, F.col(value))).alias("_q"), median(F.when(~q, F.col(value))).alias("_b"))
    d = df.join(m.select(feature, "_q", "_b"), feature).groupBy(feature).agg((1.4826 * median(F.when(q, F.abs(F.col(value) - F.col("_q"))))).alias("_mq"), (1.4826 * median(F.when(~q, F.abs(F.col(value) - F.col("_b"))))).alias("_mb"))
    j = m.join(d, feature).withColumn("d_ratio", F.col("_mq") / F.nullif("_mb", F.lit(0.0)))
    ok = (F.col("detection") >= detection) & (F.col("qc_rsd") <= rsd) & (F.col("d_ratio") <= d_ratio)
    return j.select(feature, "detection", "qc_rsd", "d_ratio", F.coalesce(ok, F.lit(False)).alias("kept"))


def loess_weights(x: np.ndarray, at: np.ndarray, span: float = 0.75) -> np.ndarray:
    """What each point at ``x`` adds to a local quadratic fit at each of ``at``, with tricube weights over the nearest share of points."""
    n = max(3, int(np.floor(span * len(x) + 1e-5)))
    out = np.empty((len(at), len(x)))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        h = np.sort(d)[min(n, len(x)) - 1] * (1 if n <= len(x) else span) or 1.0
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
        m = np.column_stack([np.ones(len(x)), x - a, (x - a) ** 2])
        out[i] = np.linalg.pinv(m * w[:, None], rcond=np.finfo(float).eps * max(m.shape))[0] * w
    return out


def drift_correct(df: DataFrame, *, feature: str = "feature", order: str = "order", value: str = "value", is_qc: str = "is_qc", span: float = 0.75) -> DataFrame:
    """Values over the QC trend on injection order, times the QC median; fewer than 4 QCs leave a feature alone, and outside the QCs' range or at a trend of 0 or less the QC median stands for the trend.

    A trend is linear in the QC values: features measured at the same places
    share the matrix that makes it, which is worked out once. A feature's rows
    are one row of arrays.
    """

    kept: dict = {}  # one for each worker

    def trend_of(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix that takes QC values to trends, the same for features measured at the same places, and where there is none."""
        key = x.tobytes(), at.tobytes()
        if key not in kept:
            if len(kept) >= 5_000:
                kept.clear()
            kept[key] = loess_weights(x, at, span), (at < x.min()) | (at > x.max())
        return kept[key]

    @F.pandas_udf("array<double>")
    def corrected(at: pd.Series, values: pd.Series, qc: pd.Series) -> pd.Series:
        out, alike = [None] * len(at), {}
        for i, (a, v, q) in enumerate(zip(at, values, qc)):
            a, v = np.asarray(a, float), np.asarray(v, float)
            used = np.asarray(q, bool) & ~np.isnan(v)
            out[i] = v
            if used.sum() >= 4:
                alike.setdefault((a.tobytes(), used.tobytes()), (a, used, []))[2].append(i)
        for a, used, some in alike.values():
            m, outside = trend_of(a[used], a)
            v = np.stack([out[i] for i in some])
            mid = np.median(v[:, used], axis=1)[:, None]
            trend = v[:, used] @ m.T
            v = v / np.where(outside | (trend <= 0), mid, trend) * mid
            for i, x in zip(some, v):
                out[i] = x
        return pd.Series(out)

    s = df.select(feature, order, F.col(value).cast("double").alias(value), F.coalesce(F.col(is_qc), F.lit(False)).alias(is_qc))
    g = s.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct(order, value, is_qc))).alias("_r"))
    g = g.withColumn("_c", corrected(F.transform("_r", lambda r: r[order].cast("double")), F.col(f"_r.{value}"), F.col(f"_r.{is_qc}")))
    return g.select(feature, F.explode(F.arrays_zip("_r", "_c")).alias("_z")).select(feature, "_z._r.*", F.nullif("_z._c", F.lit(float("nan"))).alias("corrected"))


def pqn_normalize(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "value", reference: Column | None = None) -> DataFrame:
    """Values over each sample's median quotient to the median reference spectrum, and that factor."""
    ref = (df if reference is None else df.where(reference)).where(F.col(value) > 0).groupBy(feature).agg(median(value).alias("_r"))
    q = df.join(ref, feature).where((F.col("_r") > 0) & (F.col(value) > 0)).groupBy(sample).agg(median(F.col(value) / F.col("_r")).alias("factor"))
    return df.join(q, sample).withColumn("normalised", F.col(value) / F.col("factor"))


def unit_hash(*parts, seed: int = 1) -> Column:
    """A uniform number that depends on the given columns alone, so that reruns agree."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256)
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def impute_left_censored(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "x", seed: int = 1) -> DataFrame:
    """Missing intensities drawn from a normal at the feature's 1 % quantile with a tenth of its sd, not below half its minimum. Draws depend on seed, feature and sample alone."""
    s = df.groupBy(feature).agg(F.percentile(value, 0.01).alias("_q"), F.stddev_samp(value).alias("_s"), F.min(value).alias("_m"))
    u, v = unit_hash(feature, sample, seed=seed), unit_hash(sample, feature, seed=seed + 1)
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    draw = F.col("_q") + 0.1 * F.coalesce("_s", F.lit(0.0)) * normal
    return df.join(s, feature).withColumn("imputed", F.coalesce(F.col(value), F.greatest(draw, 0.5 * F.col("_m")))).drop("_q", "_s", "_m")


def factor_group_permutation(df: DataFrame, *, sample: str = "sample", factor: str = "factor", group: str = "is_case", times: int = 999, seed: int = 1) -> DataFrame:
    """Correlation of a sample factor with the group and its permutation p, (b + 1) / (n + 1). Rows are samples."""
    base = df.select(sample, factor, F.col(group).cast("double").alias("_g"))
    n = base.withColumn("_i", F.row_number().over(Window.orderBy(sample)))
    p = n.select("_i", factor).crossJoin(df.sparkSession.range(1, times + 1).withColumnRenamed("id", "_p"))  # samples by permutations, both few
    p = p.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(unit_hash("_p", "_i", seed=seed))))
    r = p.join(n.select(F.col("_i").alias("_k"), "_g"), "_k").groupBy("_p").agg(F.corr(factor, "_g").alias("_r"))
    o = base.agg(F.corr(factor, "_g").alias("r"))
    return o.crossJoin(r).groupBy("r").agg(((F.count_if(F.abs("_r") >= F.abs("r") - 1e-12) + 1) / (times + 1)).alias("p"))  # one row


def weighted_calibration(standards: DataFrame, samples: DataFrame) -> DataFrame:
    """1/x^2 weighted line per analyte from standards (analyte, x, y), lowest acceptable level (within 15 %, 20 % at the lowest), and concentrations of samples (analyte, sample, y); below it they are null."""
    w = 1 / (F.col("x") * F.col("x"))
    g = standards.where("x > 0").groupBy("analyte").agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * F.col("x") * F.col("y")).alias("wxy"), F.min("x").alias("lowest"))
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    g = g.withColumn("slope", slope).withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    j = standards.join(g.select("analyte", "slope", "intercept", "lowest"), "analyte").withColumn("_e", F.abs((F.col("y") - F.col("intercept")) / F.col("slope") / F.col("x") - 1))
    ok = j.where(F.col("_e") <= F.when(F.col("x") == F.col("lowest"), 0.2).otherwise(0.15)).groupBy("analyte").agg(F.min("x").alias("lloq"))
    s = samples.join(g.select("analyte", "slope", "intercept"), "analyte").join(ok, "analyte", "left").withColumn("_c", (F.col("y") - F.col("intercept")) / F.col("slope"))
    return s.select("analyte", "sample", "slope", "intercept", "lloq", F.when(F.col("_c") >= F.col("lloq"), F.col("_c")).alias("concentration"))


def confirm_by_ion_ratio(samples: DataFrame, ratios: DataFrame, *, tolerance: float = 0.30) -> DataFrame:
    """Adds ion_ratio (qualifier over quantifier) and id_confirmed: it is within ``tolerance`` of the calibrators' ratio of the analyte (analyte, ratio). An analyte without one isn't confirmed."""
    d = samples.join(ratios.select("analyte", F.col("ratio").alias("_ratio")), "analyte", "left").withColumn("ion_ratio", F.col("qualifier") / F.nullif("quantifier", F.lit(0.0)))
    return d.withColumn("id_confirmed", F.coalesce(F.abs(F.col("ion_ratio") - F.col("_ratio")) / F.col("_ratio") <= tolerance, F.lit(False))).drop("_ratio")


def isotope_matrix(carbons: int, natural: float = 0.0107) -> np.ndarray:
    """Chance of measuring mass shift i where j carbons are labelled: binomial in the others."""
    from math import comb

    m = np.zeros((carbons + 1, carbons + 1))
    for j in range(carbons + 1):
        for i in range(j, carbons + 1):
            m[i, j] = comb(carbons - j, i - j) * natural ** (i - j) * (1 - natural) ** (carbons - i)
    return m


def isotope_correct(df: DataFrame, *, areas: str = "areas", carbons: str = "carbons", purity: str = "purity") -> DataFrame:
    """Mass isotopologue distribution of an array of areas (M+0, M+1, ...), corrected for natural isotopes and then for the tracer's purity, and the mean enrichment per carbon."""

    @F.pandas_udf("mid array<double>, enrichment double")
    def correct(a: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
        out, kept = [], {}
        for v, c, q in zip(a, n, p):
            c = int(c)
            m = kept.setdefault(c, isotope_matrix(c))
            y = np.zeros(c + 1)
            v = np.asarray(v, float)[: c + 1]
            y[: len(v)] = v
            x = np.clip(np.linalg.lstsq(m, y, rcond=None)[0], 0, None)
            if q < 1:
                x = np.clip(np.linalg.lstsq(kept.setdefault((c, q), isotope_matrix(c, 1 - q)), x, rcond=None)[0], 0, None)
            x = x / x.sum() if x.sum() else x
            out.append((x.tolist(), float((x * np.arange(c + 1)).sum() / c) if c and x.sum() else None))
        return pd.DataFrame(out, columns=["mid", "enrichment"])

    return df.withColumn("_c", correct(areas, carbons, purity)).withColumn("mid", F.col("_c.mid")).withColumn("enrichment", F.col("_c.enrichment")).drop("_c")


def alpha_diversity(df: DataFrame, *, sample: str = "sample", value: str = "n") -> DataFrame:
    """observed, shannon (natural log), effective (its exp), inverse_simpson."""
    t = df.where(F.col(value) > 0).groupBy(sample).agg(F.sum(value).alias("_n"), F.count(F.lit(1)).alias("observed"), F.sum(F.col(value) * F.log(F.col(value).cast("double"))).alias("_l"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_q"))
    h = F.log(F.col("_n").cast("double")) - F.col("_l") / F.col("_n")
    return t.select(sample, "observed", h.alias("shannon"), F.exp(h).alias("effective"), (F.col("_n").cast("double") * F.col("_n") / F.col("_q")).alias("inverse_simpson"))


def beta_diversity(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "n") -> DataFrame:
    """Bray-Curtis of all pairs of samples, from the sums of the smaller counts over shared features."""
    d = df.where(F.col(value) > 0)
    t = d.groupBy(sample).agg(F.sum(value).alias("_t"))
    a, b = (d.select(feature, F.col(sample).alias(f"sample_{k}"), F.col(value).alias(f"_{k}")) for k in "ab")
    m = a.join(b, feature).where("sample_a < sample_b").groupBy("sample_a", "sample_b").agg(F.sum(F.least("_a", "_b")).alias("_m"))
    x, y = (t.select(F.col(sample).alias(f"sample_{k}"), F.col("_t").alias(f"_t{k}")) for k in "ab")
    pairs = x.crossJoin(y).where("sample_a < sample_b")  # pairs of samples are the result
    return pairs.join(m, ["sample_a", "sample_b"], "left").select("sample_a", "sample_b", (1 - 2 * F.coalesce("_m", F.lit(0)) / (F.col("_ta") + F.col("_tb"))).alias("bray_curtis"))


#: log x! less (x + 1/2) log x - x + log(2 pi) / 2, for x from 1 to 9; above that four terms of its series are exact to 1e-12.
_STIRLING_REST = [math.lgamma(x + 1) - ((x + 0.5) * math.log(x) - x + 0.5 * math.log(2 * math.pi)) for x in range(1, 10)]


def log_never_drawn(total: Column, n: Column, depth: Column) -> Column:
    """log(C(total - n, depth) / C(total, depth)) for n + depth <= total.

    Logarithms of four factorials near total log total would leave its last
    digits; here each is taken relative to the total, so what cancels is of the
    size of n and depth.
    """
    t = total.cast("double")

    def rest(x: Column) -> Column:
        y = 1 / x
        few = F.element_at(F.array(*[F.lit(c) for c in _STIRLING_REST]), F.least(x, F.lit(9.0)).cast("int"))
        return F.when(x < 10, few).otherwise(y / 12 - F.pow(y, 3) / 360 + F.pow(y, 5) / 1260 - F.pow(y, 7) / 1680)

    def part(out: Column) -> tuple[Column, Column]:
        """max(total - out, 1), whose factorial is the same, and (that + 1/2) log(that / total) + rest."""
        x = F.greatest(t - out, F.lit(1.0))
        return x, (x + 0.5) * F.when(2 * out < t, F.log1p(-out / t)).otherwise(F.log(x / t)) + rest(x)

    x, y, z = (part(c.cast("double")) for c in (n, depth, n + depth))
    return x[1] + y[1] - z[1] - rest(t) + (x[0] + y[0] - z[0] - t) * (F.log(t) - 1)


def rarefaction_curve(df: DataFrame, depths: list[int], *, sample: str = "sample", value: str = "n") -> DataFrame:
    """Expected features at each depth that a sample reaches: sum(1 - C(N - n, d) / C(N, d)), once for each distinct n of a sample."""
    d = df.where(F.col(value) > 0)
    totals = d.groupBy(sample).agg(F.sum(value).alias("_n"))
    d = d.groupBy(sample, value).agg(F.count(F.lit(1)).alias("_k"))
    d = d.join(totals, sample).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in depths]))).where(F.col("depth") <= F.col("_n"))
    seen = F.when(F.col("_n") - F.col(value) >= F.col("depth"), -F.expm1(log_never_drawn(F.col("_n"), F.col(value), F.col("depth")))).otherwise(1.0)
    return d.groupBy(sample, "depth").agg(F.sum(F.col("_k") * seen).alias("expected"))


def pick_depth(totals: DataFrame, curve: DataFrame, *, sample: str = "sample", kept: float = 0.85, gain: float = 0.01) -> DataFrame:
    """One row (depth, kept, mean_expected, gain_per_1000, plateau): the shallowest plateau among the depths that keep enough of the samples (``totals``: a row each), else the deepest of them.

    A depth's gain is the growth of the mean expected features to the next depth
    of the curve, over the samples that reach that one, relative and per 1,000
    reads; it is a plateau below ``gain``.
    """
    n = totals.count()
    steps = curve.select("depth").distinct().withColumn("next", F.lead("depth").over(Window.orderBy("depth")))  # one row per depth
    c = curve.join(F.broadcast(steps), "depth")
    on = curve.select(sample, F.col("depth").alias("next"), F.col("expected").alias("_then"))
    j = c.join(on, [sample, "next"], "left")
    both = F.when(F.col("_then").isNotNull(), F.col("expected"))
    g = j.groupBy("depth", "next").agg((F.count(F.lit(1)) / n).alias("kept"), F.avg("expected").alias("mean_expected"), (F.avg(F.col("_then") - both) / F.avg(both)).alias("_g"))
    g = g.withColumn("gain_per_1000", F.col("_g") / ((F.col("next") - F.col("depth")) / 1000)).where(F.col("kept") >= kept)
    g = g.withColumn("plateau", F.coalesce(F.col("gain_per_1000") < gain, F.lit(False)))
    return g.orderBy(F.col("plateau").desc(), F.when(F.col("plateau"), F.col("depth")).otherwise(-F.col("depth"))).limit(1).select("depth", "kept", "mean_expected", "gain_per_1000", "plateau")


def rarefy(df: DataFrame, *, depth: int, seed: int = 1, feature: str = "feature", sample: str = "sample", value: str = "n", bucket_features: int = 50_000) -> DataFrame:
    """Counts drawn without replacement to one depth; shallower samples go. Rerun with the same table and seed, the draw is the same.

    A sample's features are dealt by hash to buckets of about ``bucket_features``.
    The buckets' totals share the depth by one multivariate hypergeometric draw,
    then each bucket draws its share from its own features; both together are
    one draw without replacement. No task holds more of a sample than a bucket,
    or than its buckets' totals. A sample may have up to 10^9 reads in all.
    """
    s = Scratch(df.sparkSession, "rarefy")
    fk, sk = (df.schema[c].dataType.simpleString() for c in (feature, sample))
    d = df.where(F.col(value) > 0).select(sample, feature, F.col(value).cast("long").alias(value))
    size = d.groupBy(sample).agg(F.count(F.lit(1)).alias("k"), F.sum(value).alias("t"))
    most, deepest = size.agg(F.max("k"), F.max("t")).first()
    if (deepest or 0) >= 10**9:
        raise ValueError("a sample has 10^9 reads or more")
    buckets = max(1, -(-(most or 1) // bucket_features))
    d = s.saved(d.join(size.where(F.col("t") >= depth).select(sample), sample).withColumn("_b", F.pmod(F.xxhash64(feature, F.lit(seed)), F.lit(buckets))), "rows", stays=True)

    def rng(*parts) -> np.random.Generator:
        return np.random.default_rng([seed, zlib.crc32(":".join(map(str, parts)).encode())])

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        return pdf.assign(_d=rng(pdf[sample].iloc[0]).multivariate_hypergeometric(pdf["_t"].to_numpy(np.int64), depth))[[sample, "_b", "_d"]]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(feature)
        pdf = pdf.assign(**{value: rng(pdf[sample].iloc[0], pdf["_b"].iloc[0]).multivariate_hypergeometric(pdf[value].to_numpy(np.int64), int(pdf["_d"].iloc[0]))})
        return pdf[pdf[value] > 0][[sample, feature, value]]

    shares = s.saved(d.groupBy(sample, "_b").agg(F.sum(value).alias("_t")).groupBy(sample).applyInPandas(share, f"{sample} {sk}, _b long, _d long"), "shares", stays=True)
    return d.join(shares.where("_d > 0"), [sample, "_b"]).groupBy(sample, "_b").applyInPandas(draw, f"{sample} {sk}, {feature} {fk}, {value} long")


def complete_grid(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "n") -> DataFrame:
    """Every kept feature in every sample, 0 where it wasn't seen."""
    grid = df.select(feature).distinct().crossJoin(df.select(sample).distinct())  # the dense matrix is what is asked for
    return grid.join(df.groupBy(feature, sample).agg(F.sum(value).alias(value)), [feature, sample], "left").fillna(0, [value])


def clr_transform(df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "n", pseudo: float = 0.5) -> DataFrame:
    """log(x + pseudo) minus the sample's mean over all kept features, zeros included."""
    g = complete_grid(df, feature=feature, sample=sample, value=value).withColumn("_l", F.log(F.col(value) + pseudo))
    m = g.groupBy(sample).agg(F.avg("_l").alias("_m"))
    return g.join(m, sample).select(feature, sample, (F.col("_l") - F.col("_m")).alias("clr"))


def differential_taxa(df: DataFrame, samples: DataFrame, *, design: list[str], term: str, least: int = 3, feature: str = "feature", sample: str = "sample", value: str = "n") -> DataFrame:
    """Prevalence filter, CLR, least squares per taxon with covariates, BH."""
    kept = Scratch(df.sparkSession, "taxa").saved(prevalence_filter(df, least=least, feature=feature, sample=sample, value=value), "kept", stays=True)  # read several times
    c = clr_transform(kept, feature=feature, sample=sample, value=value)
    t = feature_ols(c.join(samples, sample), design=design, term=term, feature=feature, value="clr")
    return adjust_p(t.select(feature, "n", "beta", "se", "df", "t", "p"))


def reads_dropped_share(nsti: DataFrame, counts: DataFrame, *, cut: float = 2.0, feature: str = "feature", value: str = "n") -> DataFrame:
    """Taxa above the NSTI cut and their share of the reads."""
    j = counts.join(nsti, feature, "left")
    gone = F.col("nsti") > cut
    return j.agg(F.count_distinct(F.when(gone, F.col(feature))).alias("dropped_taxa"), (F.sum(F.when(gone, F.col(value)).otherwise(0)) / F.sum(value)).alias("dropped_share"))


def sample_raw_qc(df: DataFrame, samples: DataFrame, *, sample: str = "sample", group: str = "grp", value: str = "value", feature: str = "feature", contaminant: Column | None = None, features: int | None = None, least_fold: float = 0.5, least_ids: float = 0.8) -> DataFrame:
    """Per sample: total, median, ids, missing percent, both against its group's medians (those of all samples for a group of one), flag, contaminant share.

    A sample is flagged for half its baseline's total or less, or for less than
    0.8 of its identified features; more than the baseline is no fault.
    """
    n = features or df.select(feature).distinct().count()
    con = F.sum(F.when(contaminant, F.col(value)).otherwise(0.0)) if contaminant is not None else F.lit(0.0)
    s = df.where(F.col(value) > 0).groupBy(sample).agg(F.sum(value).alias("total"), median(value).alias("median"), F.count(F.lit(1)).alias("ids"), con.alias("_c")).join(samples, sample)
    g = s.groupBy(group).agg(median("total").alias("_g"), median("ids").alias("_i"), F.count(F.lit(1)).alias("_k"))
    j = s.join(g, group).crossJoin(s.agg(median("total").alias("_all"), median("ids").alias("_all_i")))  # one row
    own = F.col("_k") > 1
    fold = F.col("total") / F.when(own, F.col("_g")).otherwise(F.col("_all"))
    ids = F.col("ids") / F.when(own, F.col("_i")).otherwise(F.col("_all_i"))
    return j.select(sample, group, "total", "median", "ids", (100 * (1 - F.col("ids") / n)).alias("missing_pct"), fold.alias("fold"), ids.alias("ids_fold"), F.when(own, "group").otherwise("all samples").alias("baseline"), ((fold <= least_fold) | (ids < least_ids)).alias("flag"), (F.col("_c") / F.col("total")).alias("contaminant_share"))


def run_metrics(df: DataFrame, *, run: str = "run", rt: str = "rt", predicted: str = "predicted", width: str = "width", q: str = "q", alpha: float = 0.01) -> DataFrame:
    """Per run: rows at the q cut, r2 of retention time on its prediction, median peak width, flag (r2 below 0.99 or width over 1.25 of the median)."""
    g = df.where((F.col(q) <= alpha) & F.col(rt).isNotNull() & F.col(predicted).isNotNull() & F.col(width).isNotNull()).groupBy(run).agg(F.count(F.lit(1)).alias("rows"), F.pow(F.corr(rt, predicted), 2).alias("r2"), median(width).alias("median_width"))
    return g.crossJoin(g.agg(median("median_width").alias("_m"))).select(run, "rows", "r2", "median_width", (F.col("median_width") / F.col("_m")).alias("width_vs_median"), ((F.col("r2") < 0.99) | (F.col("median_width") / F.col("_m") > 1.25)).alias("flag"))  # one row


def guide_efficacy_summary(scores: DataFrame, mapping: DataFrame, *, low: float = 0.3) -> DataFrame:
    """One row: guides, unmapped, share below ``low``, quartiles, genes whose guides are all low. scores: guide, efficacy; mapping: guide, gene."""
    j = scores.join(mapping, "guide", "left")
    g = j.where("gene is not null").groupBy("gene").agg(F.max("efficacy").alias("_m")).agg(F.count_if(F.col("_m") < low).alias("genes_all_low"))
    q = F.percentile("efficacy", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return j.agg(F.count(F.lit(1)).alias("guides"), F.count_if(F.col("gene").isNull()).alias("unmapped"), F.avg((F.col("efficacy") < low).cast("double")).alias("low_share"), q.alias("_q")).crossJoin(g).select("guides", "unmapped", "low_share", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "genes_all_low")  # one row each


def cross_validate_hits(a: DataFrame, b: DataFrame, *, key: str = "gene", alpha: float = 0.05) -> DataFrame:
    """Rows significant in both tables (key, effect, fdr) with the same sign."""
    x, y = (t.where(F.col("fdr") < alpha).select(key, F.col("effect").alias(f"effect_{k}")) for k, t in (("a", a), ("b", b)))
    return x.join(y, key).where(F.signum("effect_a") == F.signum("effect_b"))


def call_by_threshold(df: DataFrame, *, score: str, essential: float = 6.0, suppressor: float | None = None, controls: Column | None = None) -> DataFrame:
    """essential strictly above one cut, tumor_suppressor strictly below another where an enrichment screen gives one, else neutral; without control rows."""
    d = df if controls is None else df.where(~controls)
    call = F.when(F.col(score) > essential, "essential")
    if suppressor is not None:
        call = call.when(F.col(score) < suppressor, "tumor_suppressor")
    return d.withColumn("call", call.otherwise("neutral"))


def edit_pattern_partition(df: DataFrame, *, target: int, bystanders: list[int]) -> DataFrame:
    """Percent of reads by whether the target and each bystander differ from the reference; positions are 1-based, rows have aligned, reference, pct."""
    differs = lambda k: F.substring("aligned", k, 1) != F.substring("reference", k, 1)
    return df.groupBy(differs(target).alias("target_edited"), *[differs(k).alias(f"bystander_{k}_edited") for k in bystanders]).agg(F.sum("pct").alias("pct"))


def top_designs(df: DataFrame, *, by: str = "sequence", score: str = "score", cut: float, n: int, tie: str = "design") -> DataFrame:
    """The best n designs of each sequence strictly above the cut."""
    return df.where(F.col(score) > cut).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= n)


def reference_set_check(df: DataFrame, essential: DataFrame, other: DataFrame, *, gene: str = "gene", value: str = "lfc", least: int = 100) -> DataFrame:
    """How many of two reference gene sets are present, their means and the verdict."""
    g = df.groupBy(gene).agg(F.avg(value).alias("_v"))
    e, o = (g.join(s.select(gene).distinct(), gene, "left_semi").agg(F.count(F.lit(1)).alias(f"{k}_present"), F.avg("_v").alias(f"{k}_mean")) for k, s in (("essential", essential), ("other", other)))
    j = e.crossJoin(o)  # one row each
    return j.withColumn("verdict", F.when((F.col("essential_present") < least) | (F.col("other_present") < least), "too few").when(F.col("essential_mean") < F.col("other_mean"), "ok").otherwise("not separated"))


def precision_components(df: DataFrame, *, lowest: str = "LLOQ", lowest_cut: float = 0.20, cut: float = 0.15) -> DataFrame:
    """Per level, from replicates (level, day, value): mean, the greatest CV of a day, the inter-day CV by one-way variance components, and whether every day's and the inter-day one are within the cut (that of the level named ``lowest`` is wider).

    A level needs two days or more with equal numbers of replicates; another is an error.
    """
    d = df.groupBy("level", "day").agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = d.groupBy("level").agg(F.min("k").alias("k"), F.max("k").alias("_b"), F.count(F.lit(1)).alias("_days"), F.avg("m").alias("mean"), F.avg("v").alias("msw"), F.var_samp("m").alias("vm"), F.max(F.sqrt("v") / F.col("m")).alias("intra_cv"))
    bad = g.where("k <> _b or _days < 2").first()
    if bad is not None:
        raise ValueError(f"level {bad.level}: two days or more with equal numbers of replicates are needed")
    between = F.greatest(F.lit(0.0), F.col("vm") - F.col("msw") / F.col("k"))
    g = g.withColumn("inter_cv", F.sqrt(F.col("msw") + between) / F.col("mean"))
    limit = F.when(F.col("level").cast("string") == lowest, lowest_cut).otherwise(cut)
    return g.select("level", "mean", "intra_cv", "inter_cv", F.coalesce((F.col("intra_cv") <= limit) & (F.col("inter_cv") <= limit), F.lit(False)).alias("pass"))


def matrix_factor(df: DataFrame, *, least_lots: int = 6, cut: float = 0.15) -> DataFrame:
    """Per level: mean matrix factor over lots (lot, level, analyte_matrix, analyte_neat, is_matrix, is_neat), its CV and whether it passes."""
    r = (F.col("analyte_matrix") / F.col("analyte_neat")) / (F.col("is_matrix") / F.col("is_neat"))
    g = df.groupBy("level").agg(F.count_distinct("lot").alias("lots"), F.avg(r).alias("factor"), (F.stddev_samp(r) / F.avg(r)).alias("cv"))
    return g.withColumn("pass", (F.col("lots") >= least_lots) & (F.col("cv") <= cut))


def recovery(df: DataFrame) -> DataFrame:
    """Per level: mean of spiked before over mean of spiked after extraction (level, stage, area)."""
    m = lambda s: F.avg(F.when(F.col("stage") == s, F.col("area")))
    return df.groupBy("level").agg((m("pre") / m("post")).alias("recovery"))


def carryover(df: DataFrame, *, cut: float = 0.2) -> DataFrame:
    """Largest blank response after a high sample over the mean of the lowest level (kind, area)."""
    return df.agg((F.max(F.when(F.col("kind") == "blank", F.col("area"))) / F.avg(F.when(F.col("kind") == "lowest", F.col("area")))).alias("carryover")).withColumn("pass", F.col("carryover") <= cut)


def grade_metrics(df: DataFrame, thresholds: dict[str, tuple[float, float, bool]], *, sample: str = "sample") -> DataFrame:
    """Grade of each metric (good cut, poor cut, higher is better) and overall: FAIL before INCOMPLETE before WARN before PASS; missing is NA."""
    long = df.unpivot([sample], list(thresholds), "metric", "value")
    grade = F.lit(None).cast("string")
    for m, (good, poor, up) in thresholds.items():
        v = F.col("value")
        g = F.when(v.isNull(), "NA").when((v >= good) if up else (v <= good), "PASS").when((v >= poor) if up else (v <= poor), "WARN").otherwise("FAIL")
        grade = F.when(F.col("metric") == m, g).otherwise(grade)
    level = F.create_map(*[F.lit(x) for kv in {"PASS": 0, "WARN": 1, "NA": 2, "FAIL": 3}.items() for x in kv])
    d = long.withColumn("grade", grade)
    worst = F.max(F.element_at(level, F.col("grade"))).over(Window.partitionBy(sample))
    return d.withColumn("overall", F.element_at(F.array(*map(F.lit, ["PASS", "WARN", "INCOMPLETE", "FAIL"])), (worst + 1).cast("int")))


def feature_level_filter(df: DataFrame, *, fill: str = "fill", tag: str = "tag", spectrum: str = "ms2_matched", least: float = 0.7) -> DataFrame:
    """Rows filled often enough, with the identification level by tag and spectrum; unknown is null."""
    return df.where(F.col(fill) >= least).withColumn("level", F.when((F.col(tag) == "reference") & F.col(spectrum), 1).when((F.col(tag) == "library") & F.col(spectrum), 2).when(F.col(tag) == "library", 3))


def sample_scores(df: DataFrame, *, components: int = 5, feature: str = "feature", sample: str = "sample", value: str = "n", dense_samples: int = 2_000) -> DataFrame:
    """Principal components of samples over log10(value + 1), features centred, missing cells 0: sample, pc, score, explained.

    Up to ``dense_samples`` samples, tasks sum the products of samples over
    their features and the samples' matrix is solved in one task; of more, the
    leading components are found without it (``leading_components``), with the
    same result. A component's sign makes its largest score positive.
    """
    names = [r[0] for r in df.select(sample).distinct().orderBy(sample).limit(dense_samples + 1).collect()]
    if len(names) > dense_samples:
        x = df.groupBy(F.col(feature).alias("feature"), F.col(sample).alias("sample")).agg(F.log10(F.sum(value).cast("double") + 1).alias("x"))
        return leading_components(x, components=components).withColumnRenamed("sample", sample)
    n, at, kind = len(names), {x: i for i, x in enumerate(names)}, df.schema[sample].dataType.simpleString()
    rows = df.groupBy(feature, sample).agg(F.log10(F.sum(value).cast("double") + 1).alias("x")).groupBy(feature).agg(F.collect_list(F.struct(F.col(sample).alias("s"), "x")).alias("v"))

    def products(batches):
        c = np.zeros((n, n))
        for pdf in batches:
            m = np.zeros((len(pdf), n))
            for i, v in enumerate(pdf["v"]):
                for r in v:
                    m[i, at[r["s"]]] = r["x"]
            c += m.T @ m
        yield pd.DataFrame({"i": range(n), "row": list(c)})

    cells = rows.select("v").mapInPandas(products, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((n, n))
        c[pdf["i"], pdf["j"]] = pdf["c"]
        h = np.eye(n) - 1.0 / n
        values, vectors = np.linalg.eigh(h @ c @ h)
        values = np.clip(values[::-1], 0, None)
        out = []
        for k in range(min(components, n)):
            v = vectors[:, ::-1][:, k] * values[k] ** 0.5
            v = v if v[np.abs(v).argmax()] >= 0 else -v
            out += [(s, k + 1, float(x), float(values[k] / values.sum()) if values.sum() else None) for s, x in zip(names, v)]
        return pd.DataFrame(out, columns=[sample, "pc", "score", "explained"])

    return cells.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(solve, f"{sample} {kind}, pc int, score double, explained double")


def pca_batch_diagnostic(scores: DataFrame, samples: DataFrame, *, factors: tuple[str, ...] = ("batch", "condition"), sample: str = "sample") -> DataFrame:
    """One-way F and p of each factor of the samples on each component: pc, factor, levels, f, p; null without freedom. Samples in one table only are left out."""
    x = scores.join(samples, sample)
    d = x.select("pc", "score", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("_f")).select("pc", "score", "_f.*")
    g = d.groupBy("pc", "factor", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("pc", "factor")) / F.sum("n").over(Window.partitionBy("pc", "factor"))
    g = g.withColumn("_d", F.col("m") - mean).groupBy("pc", "factor").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("_b"), F.sum(F.col("n") * F.col("v")).alias("_w"))
    a, b = F.col("levels") - 1, F.col("_n") - F.col("levels")
    f = F.when((a > 0) & (b > 0) & (F.col("_w") > 0), F.col("_b") / F.nullif(a, F.lit(0)) / (F.col("_w") / F.nullif(b, F.lit(0))))
    g = g.withColumn("f", f)
    return g.select("pc", "factor", "levels", "f", F.when(F.col("f").isNotNull(), tails.f_p("f", a.cast("double"), b.cast("double"))).alias("p"))


def hotelling_t2(scores: DataFrame, *, alpha: float = 0.05, sample: str = "sample") -> DataFrame:
    """T2 per sample over its component scores, the critical value and whether it is beyond: sample, t2, crit, outlier; crit is null where the components leave no freedom."""
    v = scores.groupBy("pc").agg((F.sum(F.col("score") * F.col("score")) / (F.count(F.lit(1)) - 1)).alias("_v"))
    a, n = scores.agg(F.count_distinct("pc"), F.count_distinct(sample)).first()
    crit = a * (n - 1) / (n - a) * tails.f_quantile(1 - alpha, a, n - a) if n > a > 0 else None
    t = scores.join(F.broadcast(v), "pc").groupBy(sample).agg(F.sum(F.col("score") * F.col("score") / F.nullif("_v", F.lit(0.0))).alias("t2"))  # a row per component
    return t.select(sample, "t2", F.lit(crit).cast("double").alias("crit"), (F.col("t2") > F.lit(crit).cast("double")).alias("outlier"))
