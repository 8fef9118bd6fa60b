"""Single-cell tables: (cell, gene, n) triplets and cell metadata. Zeros are never stored; they enter in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators.stats import adjust_p, quantiles, rank_sum_test
from strandloom.scratch import Scratch


def cell_qc(df: DataFrame, *, mito: Column, ribo: Column, top: int = 20) -> DataFrame:
    """Per cell: total, genes, percent mitochondrial and ribosomal, percent in the ``top`` genes."""
    r = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("n").desc(), "gene"))
    d = df.where("n > 0").withColumn("_r", r)
    s = lambda c: 100 * F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    return d.groupBy("cell").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("genes"), s(mito).alias("pct_mito"), s(ribo).alias("pct_ribo"), s(F.col("_r") <= top).alias("pct_top"))


def mad_outliers(df: DataFrame, *, metric: str, nmads: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """Adds the MAD (per group) and flags values beyond median +- nmads MADs. A MAD of 0 can't tell outliers and is an error; use fixed cutoffs then."""
    if by:
        m = df.groupBy(*by).agg(F.percentile(metric, 0.5).alias("_m"))
        d = df.join(m, by)
        a = d.groupBy(*by).agg(F.percentile(F.abs(F.col(metric) - F.col("_m")), 0.5).alias("mad"))
        flat = not a.where("mad = 0").isEmpty()
        d = d.join(a, by)
    else:
        mid = quantiles(df, metric, [0.5])[0]
        d = df.withColumn("_m", F.lit(mid).cast("double"))
        mad = quantiles(d.select(F.abs(F.col(metric) - F.col("_m")).alias("x")), "x", [0.5])[0]
        flat, d = mad == 0, d.withColumn("mad", F.lit(mad).cast("double"))
    if flat:
        raise ValueError(f"the MAD of {metric} is 0: use fixed cutoffs")
    mid, reach = F.col("_m"), nmads * F.col("mad")
    return d.withColumn("outlier", (F.col(metric) < mid - reach) | (F.col(metric) > mid + reach)).drop("_m")


def mad_filter(df: DataFrame, *, metrics: dict[str, float], by: list[str] | None = None, hard: Column | None = None, least: float = 0.8) -> DataFrame:
    """Rows that are no outlier in any of ``metrics`` ({column: MADs}) nor beyond the fixed limit ``hard``. A group of which less than ``least`` would stay is an error."""
    s, d, bad = Scratch(df.sparkSession, "mad_filter"), df, F.coalesce(hard, F.lit(False)) if hard is not None else F.lit(False)
    for k, (metric, nmads) in enumerate(metrics.items()):
        d = mad_outliers(d, metric=metric, nmads=nmads, by=by).drop("mad").withColumnRenamed("outlier", f"_out{k}")
        bad = bad | F.coalesce(f"_out{k}", F.lit(False))
    d = s.saved(d.withColumn("_bad", bad), "flagged", stays=True)
    low = d.groupBy(*(by or [])).agg(F.avg((~F.col("_bad")).cast("double")).alias("share")).where(F.col("share") < least).first()
    if low is not None:
        raise ValueError(f"only {low.share:.1%} of the rows of a group would stay: inspect the MADs and use fixed cutoffs")
    return d.where("not _bad").select(*[F.col(f"`{c}`") for c in df.columns])


def filter_cells_genes(df: DataFrame, *, mito: Column, min_genes: int = 200, max_genes: int = 5000, max_mito: float = 20.0, min_cells: int = 3) -> DataFrame:
    """Triplets of genes that ``min_cells`` cells of ``min_genes`` genes or more have, in those of these cells with fewer than ``max_genes`` genes and less than ``max_mito`` percent. Both counts of a cell are of all its genes."""
    c = df.where("n > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("_g"), (100 * F.sum(F.when(mito, F.col("n")).otherwise(0)) / F.sum("n")).alias("_m")).where(F.col("_g") >= min_genes)
    d = df.join(c, "cell")
    g = d.where("n > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_cells).select("gene")
    d = d.where((F.col("_g") < max_genes) & (F.col("_m") < max_mito)).join(g, "gene", "left_semi")
    return d.select(*[F.col(f"`{c}`") for c in df.columns])


def log_normalize(df: DataFrame, *, scale: float = 1e4) -> DataFrame:
    """Adds x = log1p(n / total * scale)."""
    t = df.groupBy("cell").agg(F.sum("n").alias("_t"))
    return df.join(t, "cell").withColumn("x", F.log1p(F.col("n") / F.col("_t") * scale)).drop("_t")


def highly_variable(df: DataFrame, *, cells: int, top: int = 2000, bins: int = 20) -> DataFrame:
    """Genes by dispersion (variance over mean of expm1(x), zeros included) scaled within bins of the mean: gene, mean, dispersion, normalised, rank."""
    e = F.expm1("x")
    g = df.groupBy("gene").agg(F.sum(e).alias("_s"), F.sum(e * e).alias("_q"))
    m = F.col("_s") / cells
    v = (F.col("_q") - cells * m * m) / (cells - 1)
    g = g.select("gene", F.log1p(m).alias("mean"), F.when(m > 0, F.log(F.when(v > 0, v / m))).alias("dispersion"))
    lim = g.agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    g = g.crossJoin(lim).withColumn("_b", F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)))  # one row
    w = Window.partitionBy("_b")
    z = (F.col("dispersion") - F.avg("dispersion").over(w)) / F.nullif(F.stddev_samp("dispersion").over(w), F.lit(0.0))
    g = g.withColumn("normalised", F.coalesce(z, F.lit(0.0)))
    return g.orderBy(F.col("normalised").desc(), "gene").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.col("normalised").desc(), "gene"))).select("gene", "mean", "dispersion", "normalised", "rank")


def retained_donors(cells: DataFrame, *, donor: str = "donor", condition: str = "condition", least: int = 10, levels: list) -> DataFrame:
    """Donors with enough cells in every level of the condition."""
    p = cells.groupBy(donor).pivot(condition, levels).count().fillna(0)
    ok = F.lit(True)
    for v in levels:
        ok = ok & (F.col(f"`{v}`") >= least)
    return p.where(ok).select(donor)


def pseudobulk(df: DataFrame, cells: DataFrame, *, keys: list[str], min_cells: int = 0) -> DataFrame:
    """Counts summed per gene and unit (donor x condition, sample x cell type, ...) of the cells in the sheet; units below ``min_cells`` go."""
    sheet = cells.select("cell", *keys)
    if min_cells:
        sheet = sheet.join(sheet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_cells).select(*keys), keys, "left_semi")
    return df.join(sheet, "cell").groupBy("gene", *keys).agg(F.sum("n").alias("n"))


def marker_genes(df: DataFrame, cells: DataFrame, *, cluster: str = "cluster", top: int = 50) -> DataFrame:
    """One against the rest per cluster and gene on log values: z of the rank sum (zeros are one block of ties), log2 of the means' ratio, shares expressing in and out, rank."""
    n_all = cells.count()
    size = cells.groupBy(cluster).agg(F.count(F.lit(1)).alias("n1"))
    d = df.where("x > 0").join(cells.select("cell", cluster), "cell")
    c = d.groupBy("gene", cluster, "x").agg(F.count(F.lit(1)).alias("k"))
    tie = c.groupBy("gene", "x").agg(F.sum("k").alias("t"))
    per_gene = tie.groupBy("gene").agg(F.sum("t").alias("nz"), F.sum(F.col("t") * F.expm1("x")).alias("_s"))
    before = Window.partitionBy("gene").orderBy("x")
    tie = tie.withColumn("_r", F.sum("t").over(before) - F.col("t") + (F.col("t") + 1) / 2)
    r = c.join(tie, ["gene", "x"]).join(per_gene, "gene")
    zero = F.lit(n_all) - F.col("nz")
    g = r.groupBy("gene", cluster, "nz", "_s").agg(F.sum(F.col("k") * (F.col("_r") + zero)).alias("_w"), F.sum("k").alias("k1"), F.sum(F.col("k") * F.expm1("x")).alias("_s1"))
    ties = tie.groupBy("gene").agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("_t"))
    g = g.join(size, cluster).join(ties, "gene")
    z0 = (n_all - F.col("nz")).cast("double")
    n1, n2 = F.col("n1"), F.lit(n_all) - F.col("n1")
    w = F.col("_w") + (n1 - F.col("k1")) * (z0 + 1) / 2
    u = w - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12.0 * (n_all + 1 - (F.col("_t") + z0 * z0 * z0 - z0) / (n_all * (n_all - 1.0)))
    mean1, mean2 = F.col("_s1") / n1, (F.col("_s") - F.col("_s1")) / F.nullif(n2, F.lit(0))
    out = g.select(cluster, "gene", F.when(var > 0, (u - n1 * n2 / 2) / F.sqrt(var)).alias("z"), F.log2((mean1 + 1e-9) / (mean2 + 1e-9)).alias("log2_fold"), (F.col("k1") / n1).alias("share_in"), ((F.col("nz") - F.col("k1")) / F.nullif(n2, F.lit(0))).alias("share_out"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("z").desc(), "gene"))).where(F.col("rank") <= top)
    return out.withColumn("p", tails.norm_two_sided("z"))


def label_marker_check(reference: DataFrame, query: DataFrame, markers: DataFrame, *, least_cells: int = 20, cut: float = 0.5) -> DataFrame:
    """Per label: mean over its markers of min(1, detection in query / in reference); markers that the reference lacks are left out, labels with few cells or no marker are skipped, and cells of label Unknown aren't looked at. Tables have label, cell, gene (detected); markers label, gene."""
    query = query.where("label <> 'Unknown'")

    def detection(t: DataFrame, name: str) -> DataFrame:
        n = t.groupBy("label").agg(F.count_distinct("cell").alias(f"{name}_cells"))
        k = t.join(markers, ["label", "gene"], "left_semi").groupBy("label", "gene").agg(F.count_distinct("cell").alias("_k"))
        return markers.join(n, "label").join(k, ["label", "gene"], "left").select("label", "gene", f"{name}_cells", (F.coalesce("_k", F.lit(0)) / F.col(f"{name}_cells")).alias(f"{name}_share"))

    j = detection(reference, "ref").join(detection(query, "query"), ["label", "gene"])
    g = j.groupBy("label").agg(F.avg(F.when(F.col("ref_share") > 0, F.least(F.lit(1.0), F.col("query_share") / F.nullif("ref_share", F.lit(0.0))))).alias("retained"), F.min("query_cells").alias("cells"))
    labels = query.groupBy("label").agg(F.count_distinct("cell").alias("n"))
    return labels.join(g, "label", "left").select("label", "n", "retained", F.when(F.col("retained").isNull(), "skipped: no markers").when(F.col("n") < least_cells, "skipped: few cells").when(F.col("retained") < cut, "flagged").otherwise("ok").alias("status"))


def cell_clr(df: DataFrame, *, over: str = "cell", features: int | None = None) -> DataFrame:
    """log1p(n) minus its mean over a cell's features (or a feature's cells), zeros included by ``features`` (their number)."""
    d = df.withColumn("_l", F.log1p(F.col("n").cast("double")))
    m = d.groupBy(over).agg((F.sum("_l") / (F.lit(features) if features else F.count(F.lit(1)))).alias("_m"))
    return d.join(m, over).withColumn("clr", F.col("_l") - F.col("_m")).drop("_l", "_m")


def composition_table(cells: DataFrame, *, sample: str, kind: str, kinds: list) -> DataFrame:
    """Cells per sample and type, a column per type."""
    return cells.groupBy(sample).pivot(kind, kinds).count().fillna(0)


def cluster_stability(base: DataFrame, again: DataFrame) -> DataFrame:
    """Per cluster of the base labels (cell, cluster): mean over replicates (replicate, cell, cluster) of the best Jaccard index."""
    a, b = base.select("cell", F.col("cluster").alias("a")), again.select("replicate", "cell", F.col("cluster").alias("b"))
    both = a.join(b, "cell")
    na = both.groupBy("replicate", "a").agg(F.count(F.lit(1)).alias("na"))
    nb = both.groupBy("replicate", "b").agg(F.count(F.lit(1)).alias("nb"))
    x = both.groupBy("replicate", "a", "b").agg(F.count(F.lit(1)).alias("k")).join(na, ["replicate", "a"]).join(nb, ["replicate", "b"])
    best = x.groupBy("replicate", "a").agg(F.max(F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("_j"))
    return best.groupBy(F.col("a").alias("cluster")).agg(F.avg("_j").alias("stability"), F.count(F.lit(1)).alias("replicates"))


def psi_by_group(df: DataFrame, *, least_cells: int = 50) -> DataFrame:
    """Mean PSI per event and cell type with cells enough, and the event's rank by the variance of those means."""
    g = df.where("psi is not null").groupBy("event", "cell_type").agg(F.avg("psi").alias("mean_psi"), F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= least_cells)
    v = g.groupBy("event").agg(F.coalesce(F.var_samp("mean_psi"), F.lit(0.0)).alias("variance"))
    v = v.withColumn("rank", F.row_number().over(Window.orderBy(F.col("variance").desc(), "event")))
    return g.join(v, "event")


def psi_test(df: DataFrame, *, least: int = 20, group: str = "is_case") -> DataFrame:
    """Rank test of PSI (with continuity correction) between two groups per event with values enough on both sides: delta, u, z, p, BH."""
    d = df.where("psi is not null")
    n = d.groupBy("event").agg(F.count_if(F.col(group)).alias("_a"), F.count_if(~F.col(group)).alias("_b"), (F.avg(F.when(F.col(group), F.col("psi"))) - F.avg(F.when(~F.col(group), F.col("psi")))).alias("delta")).where((F.col("_a") >= least) & (F.col("_b") >= least)).select("event", "delta")
    t = rank_sum_test(d.join(n.select("event"), "event", "left_semi"), feature="event", value="psi", group=group, continuity=True)
    return adjust_p(t.join(n, "event"))


def cluster_qc(cells: DataFrame, *, cluster: str = "cluster", sample: str = "sample", metrics: list[str], doublet: str = "doublet") -> DataFrame:
    """Per cluster: cells, medians, doublet rate and purity (the largest sample's share)."""
    g = cells.groupBy(cluster).agg(F.count(F.lit(1)).alias("cells"), *[F.percentile(m, 0.5).alias(f"median_{m}") for m in metrics], F.avg(F.col(doublet).cast("double")).alias("doublet_rate"))
    p = cells.groupBy(cluster, sample).agg(F.count(F.lit(1)).alias("_k")).groupBy(cluster).agg((F.max("_k") / F.sum("_k")).alias("purity"))
    return g.join(p, cluster)
