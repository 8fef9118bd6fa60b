"""Summary statistics: harmonising, instruments, Mendelian randomisation sums, colocalisation, credible sets, gene evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.scratch import Scratch


def harmonise_alleles(a: DataFrame, b: DataFrame, *, key: str = "snp", ambiguous: float = 0.42) -> DataFrame:
    """Rows of both studies (snp, a1, a2, beta, se, maf) on the alleles of the first: same, flipped, on the other strand or both; flips negate the second beta and take 1 - maf. Palindromic pairs of high maf and pairs that don't match go."""
    comp = lambda c: F.translate(c, "ACGT", "TGCA")
    y = b.select(key, *[F.col(c).alias(f"{c}_2") for c in ("a1", "a2", "beta", "se", "maf")])
    j = a.join(y, key)
    same = (F.col("a1") == F.col("a1_2")) & (F.col("a2") == F.col("a2_2"))
    flip = (F.col("a1") == F.col("a2_2")) & (F.col("a2") == F.col("a1_2"))
    c_same = (F.col("a1") == comp("a1_2")) & (F.col("a2") == comp("a2_2"))
    c_flip = (F.col("a1") == comp("a2_2")) & (F.col("a2") == comp("a1_2"))
    how = F.when(same, "same").when(flip, "flip").when(c_same, "complement").when(c_flip, "complement_flip")
    palindrome = F.col("a1") == comp("a2")
    d = j.withColumn("how", how).where(F.col("how").isNotNull() & ~(palindrome & (F.col("maf") > ambiguous)))
    turned = F.col("how").isin("flip", "complement_flip")
    return d.withColumn("beta_2", F.when(turned, -F.col("beta_2")).otherwise(F.col("beta_2"))).withColumn("maf_2", F.when(turned, 1 - F.col("maf_2")).otherwise(F.col("maf_2"))).drop("a1_2", "a2_2")


def select_instruments(df: DataFrame, *, p: str | None = "p", cut: float = 5e-8, f: float = 10.0) -> DataFrame:
    """Rows below the p cut with F = (beta / se)^2 of at least ``f``."""
    ok = F.pow(F.col("beta") / F.col("se"), 2) >= f
    return df.where(ok & (F.col(p) < cut) if p else ok)


def ld_pairs(genotypes: DataFrame, *, window: int = 1_000_000, variant: str = "snp") -> DataFrame:
    """r2 of variants of one locus within a distance: genotypes (locus, snp, pos, sample, dosage). Variants meet in bins of the window and the next one."""
    d = genotypes.select("locus", "sample", F.col(variant).alias("snp"), "pos", "dosage").withColumn("_b", F.floor(F.col("pos") / window))
    a = d.select("locus", "sample", "_b", *[F.col(c).alias(f"{c}_1") for c in ("snp", "pos", "dosage")])
    b = d.select("locus", "sample", F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"), *[F.col(c).alias(f"{c}_2") for c in ("snp", "pos", "dosage")])
    after = F.struct("pos_1", "snp_1") < F.struct(F.col("pos_2").alias("pos_1"), F.col("snp_2").alias("snp_1"))
    j = a.join(b, ["locus", "sample", "_b"]).where(after & (F.col("pos_2") - F.col("pos_1") <= window))
    return j.groupBy("locus", F.least("snp_1", "snp_2").alias("snp_a"), F.greatest("snp_1", "snp_2").alias("snp_b")).agg(F.pow(F.corr("dosage_1", "dosage_2"), 2).alias("r2"))


def ld_clump(df: DataFrame, ld: DataFrame, *, r2: float = 0.1, most_rounds: int = 1_000) -> DataFrame:
    """Instruments (locus, snp, p) kept in order of p, those of the locus in LD with a kept one dropped; a null p comes last.

    A round keeps all that come first among their neighbours and drops what is
    in LD with them, which is the choice in order.
    """
    s = Scratch(df.sparkSession, "clump")
    rank = F.struct(F.col("p").isNull().alias("none"), F.col("p").cast("double").alias("p"), F.col("snp").alias("snp"))
    x = df.groupBy("locus", "snp").agg(F.min("p").alias("p")).select("locus", "snp", rank.alias("rank"))
    pairs = ld.where((F.col("r2") >= r2) & (F.col("snp_a") != F.col("snp_b")))
    pairs = pairs.select(F.col("snp_a").alias("snp"), F.col("snp_b").alias("o")).unionByName(pairs.select(F.col("snp_b").alias("snp"), F.col("snp_a").alias("o"))).distinct()
    near = s.saved(x.join(pairs, "snp").join(x.select("locus", F.col("snp").alias("o"), F.col("rank").alias("rank_o")), ["locus", "o"]), "near")
    left, out = s.saved(x, "left", stays=True), None
    for _ in range(most_rounds):
        if left.isEmpty():
            out = left if out is None else out
            s.close()
            return out.select("locus", "snp", F.col("rank.p").alias("p"))
        now = s.saved(left.join(near.where("rank_o < rank").select("locus", "snp"), ["locus", "snp"], "left_anti"), "kept", stays=True)
        out = now if out is None else out.unionByName(now)
        gone = near.join(now.select("locus", F.col("snp").alias("o")), ["locus", "o"], "left_semi").select("locus", "snp")
        left = s.saved(left.join(now, ["locus", "snp"], "left_anti").join(gone, ["locus", "snp"], "left_anti"), "left", stays=True)
        near = s.saved(near.join(left, ["locus", "snp"], "left_semi").join(left.select("locus", F.col("snp").alias("o")), ["locus", "o"], "left_semi"), "near")
    raise RuntimeError("the clumps did not end")


def mr_ivw(df: DataFrame, *, by: list[str], bx: str = "beta", by_: str = "beta_2", sy: str = "se_2") -> DataFrame:
    """Inverse-variance weighted estimate per outcome: snps, estimate, se, q (heterogeneity), q_df, p."""
    w = 1 / (F.col(sy) * F.col(sy))
    g = df.where(f"{bx} <> 0").groupBy(*by).agg(F.count(F.lit(1)).alias("snps"), F.sum(w * F.col(bx) * F.col(by_)).alias("_xy"), F.sum(w * F.col(bx) * F.col(bx)).alias("_xx"), F.sum(w * F.col(by_) * F.col(by_)).alias("_yy"))
    e = F.col("_xy") / F.col("_xx")
    g = g.select(*by, "snps", e.alias("estimate"), (1 / F.sqrt("_xx")).alias("se"), (F.col("_yy") - e * F.col("_xy")).alias("q"), (F.col("snps") - 1).alias("q_df"))
    return g.withColumn("p", tails.norm_two_sided(F.col("estimate") / F.col("se")))


def wald_ratio(df: DataFrame, *, bx: str = "beta", by_: str = "beta_2", sy: str = "se_2") -> DataFrame:
    """Ratio estimate of each single variant."""
    return df.where(f"{bx} <> 0").withColumn("wald", F.col(by_) / F.col(bx)).withColumn("wald_se", F.col(sy) / F.abs(bx))


def mr_egger(df: DataFrame, *, by: list[str], bx: str = "beta", by_: str = "beta_2", sy: str = "se_2") -> DataFrame:
    """Weighted regression with intercept after turning exposure effects positive: snps, intercept, slope, and their se."""
    s = F.signum(bx)
    x, y, w = F.abs(bx), s * F.col(by_), 1 / (F.col(sy) * F.col(sy))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("snps"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"))
    d = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    b = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.nullif(d, F.lit(0.0))
    a = (F.col("wy") - b * F.col("wx")) / F.col("w")
    g = g.withColumn("slope", b).withColumn("intercept", a)
    rss = F.col("wyy") - F.col("intercept") * F.col("wy") - F.col("slope") * F.col("wxy")
    s2 = F.greatest(F.lit(1.0), rss / F.nullif(F.col("snps") - 2, F.lit(0)))
    return g.select(*by, "snps", "intercept", F.sqrt(s2 * F.col("wxx") / d).alias("intercept_se"), "slope", F.sqrt(s2 * F.col("w") / d).alias("slope_se"))


def weighted_median(df: DataFrame, *, by: list[str], bx: str = "beta", by_: str = "beta_2", sy: str = "se_2", key: str = "snp") -> DataFrame:
    """Weighted median of the ratio estimates (weights (bx / sy)^2), by interpolation at half of the weight."""
    d = df.where(f"{bx} <> 0").withColumn("_r", F.col(by_) / F.col(bx)).withColumn("_w", F.pow(F.col(bx) / F.col(sy), 2))
    w = Window.partitionBy(*by).orderBy("_r", key)
    d = d.withColumn("_c", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w") / 2).withColumn("_p", F.col("_c") / F.sum("_w").over(Window.partitionBy(*by)))
    d = d.withColumn("_r2", F.lead("_r").over(w)).withColumn("_p2", F.lead("_p").over(w))
    at = F.col("_r") + (F.col("_r2") - F.col("_r")) * (0.5 - F.col("_p")) / (F.col("_p2") - F.col("_p"))
    inside = (F.col("_p") <= 0.5) & (F.col("_p2") > 0.5)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("snps"), F.coalesce(F.max(F.when(inside, at)), F.min("_r")).alias("weighted_median"))


def leave_one_out(df: DataFrame, *, by: list[str], key: str = "snp", bx: str = "beta", by_: str = "beta_2", sy: str = "se_2") -> DataFrame:
    """The weighted estimate without each variant, from the totals less its own terms."""
    w = 1 / (F.col(sy) * F.col(sy))
    d = df.select(*by, key, (w * F.col(bx) * F.col(by_)).alias("_xy"), (w * F.col(bx) * F.col(bx)).alias("_xx"))
    t = d.groupBy(*by).agg(F.sum("_xy").alias("_sxy"), F.sum("_xx").alias("_sxx"))
    return d.join(t, by).select(*by, key, ((F.col("_sxy") - F.col("_xy")) / F.nullif(F.col("_sxx") - F.col("_xx"), F.lit(0.0))).alias("estimate"))


def cis_mr_correlated(df: DataFrame, ld: DataFrame, *, by: str = "gene", ridge: float = 1e-10) -> DataFrame:
    """Generalised least squares per gene with LD among instruments (gene, snp, beta, beta_2, se_2; ld snp_a, snp_b, r): snps, estimate, se."""
    d = df.select(by, "snp", "beta", "beta_2", "se_2")
    pairs = d.select(by, F.col("snp").alias("snp_a")).join(ld, "snp_a").join(d.select(by, F.col("snp").alias("snp_b")), [by, "snp_b"]).select(by, "snp_a", "snp_b", "r")
    g = d.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("snp", "beta", "beta_2", "se_2"))).alias("x")).join(pairs.groupBy(by).agg(F.collect_list(F.struct("snp_a", "snp_b", "r")).alias("l")), by, "left")

    @F.pandas_udf("snps long, estimate double, se double")
    def gls(xs: pd.Series, ls: pd.Series) -> pd.DataFrame:
        out = []
        for x, l in zip(xs, ls):
            at = {r["snp"]: i for i, r in enumerate(x)}
            m = np.eye(len(x)) * (1 + ridge)
            for p in [] if l is None else l:
                m[at[p["snp_a"]], at[p["snp_b"]]] = m[at[p["snp_b"]], at[p["snp_a"]]] = p["r"]
            s = np.array([r["se_2"] for r in x])
            bx, y = (np.array([r[c] for r in x]) for c in ("beta", "beta_2"))
            inv = np.linalg.pinv(m * np.outer(s, s))
            v = 1 / float(bx @ inv @ bx)
            out.append((len(x), v * float(bx @ inv @ y), v**0.5))
        return pd.DataFrame(out, columns=["snps", "estimate", "se"])

    return g.withColumn("_g", gls("x", "l")).select(by, "_g.*")


def log_abf(beta: str, se: str, prior_sd: float) -> Column:
    """Log approximate Bayes factor of a variant."""
    v, w = F.col(se) * F.col(se), F.lit(prior_sd * prior_sd)
    z2 = F.pow(F.col(beta) / F.col(se), 2)
    return 0.5 * (F.log(v / (v + w)) + z2 * w / (v + w))


def _log_sum(c: Column, by: list[str]) -> tuple[Column, Column]:
    top = F.max(c).over(Window.partitionBy(*by))
    return top, F.exp(c - top)


def coloc_abf(df: DataFrame, *, by: list[str], p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5, prior_sd: float = 0.15) -> DataFrame:
    """Posterior of no, one, other, two distinct and one shared causal variant per locus, from harmonised rows (beta, se, beta_2, se_2)."""
    d = df.withColumn("_a", log_abf("beta", "se", prior_sd)).withColumn("_b", log_abf("beta_2", "se_2", prior_sd)).withColumn("_c", F.col("_a") + F.col("_b"))
    for k in "abc":
        top, e = _log_sum(F.col(f"_{k}"), by)
        d = d.withColumn(f"_m{k}", top).withColumn(f"_e{k}", e)
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("snps"), *[(F.max(f"_m{k}") + F.log(F.sum(f"_e{k}"))).alias(f"_{k}") for k in "abc"])
    g = g.withColumn("l1", F.log(F.lit(p1)) + F.col("_a")).withColumn("l2", F.log(F.lit(p2)) + F.col("_b")).withColumn("l4", F.log(F.lit(p12)) + F.col("_c"))
    both = F.col("_a") + F.col("_b")
    g = g.withColumn("l3", F.log(F.lit(p1 * p2)) + both + F.log(F.greatest(F.lit(1e-300), 1 - F.exp(F.least(F.lit(0.0), F.col("_c") - both)))))
    top = F.greatest(F.lit(0.0), "l1", "l2", "l3", "l4")
    total = F.exp(-top) + F.exp(F.col("l1") - top) + F.exp(F.col("l2") - top) + F.exp(F.col("l3") - top) + F.exp(F.col("l4") - top)
    return g.select(*by, "snps", (F.exp(-top) / total).alias("h0"), *[(F.exp(F.col(f"l{k}") - top) / total).alias(f"h{k}") for k in (1, 2, 3, 4)])


def single_causal_credible_set(df: DataFrame, *, by: list[str], key: str = "snp", coverage: float = 0.95, prior_sd: float = 0.15) -> DataFrame:
    """Posterior of each variant if one is causal, the running sum from the largest, and the variants that reach the coverage."""
    d = df.withColumn("_a", log_abf("beta", "se", prior_sd))
    _, e = _log_sum(F.col("_a"), by)
    d = d.withColumn("_e", e).withColumn("pip", F.col("_e") / F.sum("_e").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(F.col("pip").desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cumulative", F.sum("pip").over(w)).withColumn("in_set", F.col("cumulative") - F.col("pip") < coverage).drop("_a", "_e")


def concordance_tier(df: DataFrame) -> DataFrame:
    """How many of six evidence streams pass (missing values don't), how many are available, and the tier.

    Streams: fine mapping (pip_top_variant and credible_set_purity above 0.5),
    coloc_pph4 from 0.7, distance_to_tss up to 100 kb, pops_decile_rank 1,
    l2g_score from 0.5, and abc_score from 0.02 or encode_re2g_score from 0.5.
    """
    c = F.col
    streams = [
        ((c("pip_top_variant") > 0.5) & (c("credible_set_purity") > 0.5), c("pip_top_variant").isNotNull() & c("credible_set_purity").isNotNull()),
        (c("coloc_pph4") >= 0.7, c("coloc_pph4").isNotNull()),
        (c("distance_to_tss") <= 100_000, c("distance_to_tss").isNotNull()),
        (c("pops_decile_rank") == 1, c("pops_decile_rank").isNotNull()),
        (c("l2g_score") >= 0.5, c("l2g_score").isNotNull()),
        ((c("abc_score") >= 0.02) | (c("encode_re2g_score") >= 0.5), c("abc_score").isNotNull() | c("encode_re2g_score").isNotNull()),
    ]
    passed = sum((F.coalesce(p, F.lit(False)).cast("int") for p, _ in streams), F.lit(0))
    there = sum((a.cast("int") for _, a in streams), F.lit(0))
    n = F.col("concordance")
    tier = F.when(n >= 5, "near_certain").when(n >= 4, "strong").when(n >= 3, "high").when(n >= 2, "suggestive").otherwise("associational_only")
    return df.withColumn("concordance", passed).withColumn("n_streams_available", there).withColumn("tier", tier)


def snp_to_gene(variants: DataFrame, scores: DataFrame, *, key: str = "snp") -> tuple[DataFrame, DataFrame]:
    """Gene totals of the variants' scores (snp, gene, score), and the variants without one."""
    g = variants.join(scores, key).groupBy("gene").agg(F.sum("score").alias("score"), F.count_distinct(key).alias("snps"))
    return g, variants.join(scores.select(key), key, "left_anti")


def loci_evidence_count(credible: DataFrame, classes: list[str], genes: DataFrame, *, locus: str = "locus") -> DataFrame:
    """Per locus: variants, protein-altering ones by consequence class, and the genes with evidence among them."""
    hit = F.col("consequence").isin(classes)
    j = credible.join(genes.select("gene").distinct().withColumn("_g", F.lit(True)), "gene", "left")
    return j.groupBy(locus).agg(F.count(F.lit(1)).alias("variants"), F.count_if(hit).alias("altering"), F.count_distinct(F.when(hit & F.col("_g"), F.col("gene"))).alias("genes"))
