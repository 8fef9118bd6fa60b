"""Registered queries: screens, proteomics, cells, junctions, alignments, LD, spectra, components of samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators import cells as ce
from strandloom.operators import gwas as gw
from strandloom.operators import matrix as mx
from strandloom.operators import proteins as pr
from strandloom.operators import reads as rd
from strandloom.operators import sequences as sq
from strandloom.operators import stats as st
from strandloom.plans.core import Registry, bh, norm_two_sided, t_two_sided
from strandloom.scratch import shared_root
from strandloom.sources import text

R = Registry()


def norm_less(z: str) -> str:
    """SQL of the normal distribution function of a column."""
    return f"(CASE WHEN {z} <= 0 THEN ({norm_two_sided(z)}) / 2 ELSE 1 - ({norm_two_sided(z)}) / 2 END)"


@R.add("""
    WITH d AS (SELECT feature, sample, log2(n) AS x FROM {counts}), f AS (SELECT feature, avg(x) AS m FROM d GROUP BY feature HAVING count(*) = 12 ORDER BY var_samp(x) DESC, feature LIMIT 300),
         c AS (SELECT feature, sample, x - m AS x FROM d JOIN f USING (feature)), p AS (SELECT a.sample, b.sample AS o, corr(a.x, b.x) AS r FROM c a JOIN c b USING (feature) WHERE a.sample <> b.sample GROUP BY ALL),
         m AS (SELECT sample, o % 4 AS g, avg(r) AS c FROM p GROUP BY ALL), b AS (SELECT sample, arg_max(g, c) AS best_group, max(c) AS r_best FROM m GROUP BY sample)
    SELECT b.sample, b.sample % 4 AS grp, best_group, round(r_best, 6) AS r_best, round(c, 6) AS r_own, 'measured' AS status, b.sample % 4 <> best_group AS possible_swap FROM b LEFT JOIN m ON m.sample = b.sample AND g = b.sample % 4""")
def sample_swap_check(v):
    c = v.counts.select("feature", "sample", F.log2(F.col("n").cast("double")).alias("x"))
    s = c.select("sample", (F.col("sample") % 4).alias("grp")).distinct()
    return mx.sample_swap_check(c, s)


LOWER = """
    WITH g AS ({genes}), d AS (SELECT gene, lfc AS v, true AS is_case FROM g UNION ALL SELECT k.gene, n.lfc, false FROM (SELECT DISTINCT gene FROM g) k CROSS JOIN ({null}) n),
    r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, v) AS t FROM d),
    s AS (SELECT gene, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n2, sum(r) FILTER (is_case) AS w, sum(t * t - 1.0) AS ties, median(v) FILTER (is_case) AS med FROM r GROUP BY gene),
    u AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s), z AS (SELECT *, (u - n1 * n2 / 2 + 0.5) / sd AS z FROM u)"""


@R.add(LOWER.replace("{genes}", "SELECT gene, price % 997 / 400 - 1.6 AS lfc FROM {lines}").replace("{null}", "SELECT n_nationkey / 8.0 - 1.5 AS lfc FROM nation") + f"""
    , p AS (SELECT gene, med, u, {norm_less("z")} AS p FROM z) SELECT gene, round(med, 6) AS median_lfc, round(u, 6) AS u, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AND med <= -0.4 AS call FROM {bh("p")}""")
def gene_rank_test(v):
    g = v.lines.select("gene", (F.col("price") % 997 / 400 - 1.6).alias("lfc"))
    return mx.gene_rank_test(g, v.table("nation").select((F.col("n_nationkey") / 8.0 - 1.5).alias("lfc")), floor=-0.4)


GENES = "(SELECT id, 'c' || (id * 50 // 1000 % 5) AS contig, id * 50 + 7 AS at, (price - 950) / 100 AS lfc FROM {parts})"
PLACED = f"(SELECT g.*, s.start, s.copy_number FROM {GENES} g LEFT JOIN {{segments}} s ON s.contig = g.contig AND g.at >= s.start AND g.at <= s.stop)"


def _genes(v):
    return v.parts.select("id", F.concat(F.lit("c"), F.floor(F.col("id") * 50 / 1000) % 5).alias("contig"), (F.col("id") * 50 + 7).alias("at"), ((F.col("price") - 950) / 100).alias("lfc"))


@R.add(f"""
    WITH j AS (SELECT * FROM {PLACED}), m AS (SELECT contig, start, count(DISTINCT id) AS k, median(lfc) AS m FROM j WHERE start IS NOT NULL GROUP BY ALL)
    SELECT id, round(copy_number, 6) AS copy_number, round(lfc - CASE WHEN k >= 5 AND abs(log2(copy_number / 2)) > 0.3 THEN m ELSE 0 END, 6) AS residual FROM j LEFT JOIN m USING (contig, start)""")
def copy_number_correct(v):
    return mx.copy_number_correct(_genes(v), v.segments, gene="id").select("id", "copy_number", "residual")


COPIES = f"(SELECT id, (id * 7919 % 1009) / 500.0 - 1 - copy_number / 10 AS lfc, copy_number FROM {PLACED} WHERE copy_number IS NOT NULL)"


def _copies(v):
    d = mx.copy_number_correct(_genes(v), v.segments, gene="id").where("copy_number is not null")
    return d.select("id", (F.col("id") * 7919 % 1009 / 500.0 - 1 - F.col("copy_number") / 10).alias("lfc"), "copy_number")


@R.add(f"""
    WITH d AS (SELECT * FROM {COPIES}), r AS (SELECT *, rank() OVER (ORDER BY lfc) + (count(*) OVER (PARTITION BY lfc) - 1) / 2 AS a, rank() OVER (ORDER BY copy_number) + (count(*) OVER (PARTITION BY copy_number) - 1) / 2 AS b FROM d),
         g AS (SELECT corr(a, b) AS rho, count(*) AS n, count(*) FILTER (copy_number > 4) AS amplified, count(*) FILTER (copy_number BETWEEN 1.5 AND 2.5) AS diploid, avg(lfc) FILTER (copy_number > 4) AS amplified_mean, avg(lfc) FILTER (copy_number BETWEEN 1.5 AND 2.5) AS diploid_mean FROM r),
         x AS (SELECT *, rank() OVER (ORDER BY lfc) + (count(*) OVER (PARTITION BY lfc) - 1) / 2 AS r, count(*) OVER (PARTITION BY lfc) AS t FROM d WHERE copy_number > 4 OR copy_number BETWEEN 1.5 AND 2.5),
         s AS (SELECT count(*) FILTER (copy_number > 4) AS n1, count(*) FILTER (copy_number <= 4) AS n2, sum(r) FILTER (copy_number > 4) AS w, sum(t * t - 1.0) AS ties FROM x),
         z AS (SELECT (w - n1 * (n1 + 1) / 2 - n1 * n2 / 2 + 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s),
         t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, (n - 2)::DOUBLE AS df, amplified_mean - diploid_mean AS gap FROM g CROSS JOIN z), p AS (SELECT *, {t_two_sided("t", "df")} AS p, {norm_less("z")} AS p_gap FROM t)
    SELECT round(rho, 6) AS rho, round(p, 6) AS p, n, amplified, diploid, round(amplified_mean, 6) AS amplified_mean, round(diploid_mean, 6) AS diploid_mean, round(gap, 6) AS gap, round(p_gap, 6) AS p_gap, (rho < -0.1 AND p < 0.01) OR (gap < -0.5 AND p_gap < 0.01) AS cn_bias FROM p""")
def cn_bias(v):
    return mx.cn_bias(_copies(v))[0]


@R.add(f"""
    WITH d AS (SELECT * FROM {COPIES}), e AS (SELECT list_distinct(quantile_cont(copy_number, [0.2, 0.4, 0.6, 0.8])) AS e FROM d)
    SELECT len(list_filter(e, lambda x: x < copy_number))::INT AS bin, count(*) AS n, round(avg(lfc), 6) AS mean, round(median(lfc), 6) AS median, round(stddev_samp(lfc), 6) AS sd FROM d CROSS JOIN e GROUP BY 1""")
def cn_bias_bins(v):
    return mx.cn_bias(_copies(v))[1]


@R.add(f"""
    WITH d AS (SELECT feature, sample, (feature * 7 + sample * 13) % 41 / 10.0 - 1.8 + 1.5 * (feature % 10 = 0)::INT AS z FROM {{counts}}), u AS (SELECT count(DISTINCT sample) AS units FROM d),
         g AS (SELECT feature, sum(z) / sqrt(count(*)) AS meta_z, count(*) AS n, count(*) FILTER (z > 1.6448536) AS n_nominal FROM d GROUP BY feature), p AS (SELECT *, 1 - {norm_less("meta_z")} AS p FROM g)
    SELECT feature, round(meta_z, 6) AS meta_z, n, n_nominal, round(p, 6) AS meta_p, round(q, 6) AS q, CASE WHEN NOT q < 0.05 THEN 'none' WHEN n_nominal >= 0.5 * units THEN 'hit' ELSE 'review' END AS call FROM {bh("p")} CROSS JOIN u""")
def stouffer_meta(v):
    z = (F.col("feature") * 7 + F.col("sample") * 13) % 41 / 10.0 - 1.8 + 1.5 * (F.col("feature") % 10 == 0).cast("int")
    return st.stouffer_meta(v.counts.select("feature", "sample", tails.norm_upper(z).alias("p")), feature="feature", unit="sample")


@R.add("""
    WITH d AS (SELECT partkey AS gene, line AS dose, avg(price) - 30000 AS effect, partkey * 31 % 97 / 970.0 AS fdr FROM {lines} GROUP BY ALL HAVING dose <= 3 OR gene % 2 = 0), s AS (SELECT *, abs(effect) >= coalesce(abs(lag(effect) OVER (PARTITION BY gene ORDER BY dose)), 0) AS step FROM d)
    SELECT gene, round(arg_max(effect, dose), 6) AS top_effect, round(arg_max(fdr, dose), 6) AS top_fdr, bool_and(step) AS monotonic FROM s GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT dose) FROM d) AND min(sign(effect)) = max(sign(effect)) AND min(sign(effect)) <> 0 AND arg_max(fdr, dose) < 0.05""")
def dose_consistent(v):
    """Genes of odd parts have no effect above dose 3: null there, which the operator leaves out."""
    d = v.lines.groupBy(F.col("partkey").alias("gene"), F.col("line").alias("dose")).agg((F.avg("price") - 30000).alias("effect"))
    d = d.withColumn("effect", F.when((F.col("dose") <= 3) | (F.col("gene") % 2 == 0), F.col("effect")))
    return mx.dose_consistent(d.withColumn("fdr", F.col("gene") * 31 % 97 / 970.0))


@R.add("""
    WITH d AS (SELECT feature AS prey, sample AS run, sample >= 9 AS c, n AS value FROM {counts} WHERE NOT (sample = 10 AND feature % 3 = 0)), r AS (SELECT run, log2(min(value)) AS f FROM d WHERE c GROUP BY run),
         k AS (SELECT p.prey, count(d.value) AS n_ctrl, avg(coalesce(log2(d.value), f)) AS m, max(coalesce(log2(d.value), f)) AS x, count(*) AS alive FROM (SELECT DISTINCT feature AS prey FROM {counts}) p CROSS JOIN r LEFT JOIN d ON d.prey = p.prey AND d.run = r.run GROUP BY p.prey),
         b AS (SELECT prey, count(*) AS n_bait, avg(log2(value)) AS b, min(log2(value)) AS low FROM d WHERE NOT c GROUP BY prey)
    SELECT prey, coalesce(n_bait, 0) AS n_bait, n_ctrl, alive AS n_ctrl_runs_used, round(b - m, 6) AS log2_enrichment, round(low - x, 6) AS worst_case_log2, coalesce(n_bait, 0) >= 6 AND (n_ctrl = 0 OR coalesce(b - m >= 0.5, false)) AS interactor FROM k LEFT JOIN b USING (prey)""")
def apms_score(v):
    """A third of the preys of run 10 have the value 0: not detected."""
    value = F.when((F.col("sample") == 10) & (F.col("feature") % 3 == 0), 0).otherwise(F.col("n"))
    d = v.counts.select(F.col("feature").alias("prey"), F.col("sample").alias("run"), (F.col("sample") >= 9).alias("is_control"), value.alias("value"))
    return mx.apms_score(d, cut=0.5, least_baits=6)


@R.add("""
    WITH w AS (SELECT id, unnest(['a', 'a', 'b']) AS run, unnest([1, 2, 1]) AS multiplicity, unnest([price, size, price * size - size]) AS x FROM {parts} WHERE size / 50.0 >= 0.75)
    SELECT id, run, multiplicity::INT AS multiplicity, round(log2(x), 6) AS log2 FROM w WHERE x > 0""")
def expand_site_multiplicity(v):
    z = F.col("size").cast("double")
    w = v.parts.select("id", (F.col("size") / 50.0).alias("probability"), F.col("price").alias("a___1"), z.alias("a___2"), (F.col("price") * z - z).alias("b___1"))
    return mx.expand_site_multiplicity(w, ids=["id"])


@R.add("""
    WITH d AS (SELECT cell, gene, cell % 2 AS side, CASE WHEN cell % 7 = 6 THEN 'Unknown' ELSE 'L' || (cell % 7) END AS label FROM {cells}), m AS (SELECT DISTINCT 'L' || (gene % 5) AS label, gene FROM {lines} WHERE gene % 4 = 0),
         n AS (SELECT label, side, count(DISTINCT cell) AS n FROM d GROUP BY ALL), k AS (SELECT m.label, m.gene, n.side, n.n, count(DISTINCT d.cell) AS k FROM m JOIN n ON n.label = m.label LEFT JOIN d ON d.label = m.label AND d.gene = m.gene AND d.side = n.side GROUP BY ALL),
         g AS (SELECT r.label, avg(least(1.0, (q.k / q.n) / (r.k / r.n))) FILTER (r.k > 0) AS retained FROM k r JOIN k q ON r.label = q.label AND r.gene = q.gene AND r.side = 0 AND q.side = 1 GROUP BY r.label)
    SELECT label, n, round(retained, 6) AS retained, CASE WHEN retained IS NULL THEN 'skipped: no markers' WHEN n < 20 THEN 'skipped: few cells' WHEN retained < 0.5 THEN 'flagged' ELSE 'ok' END AS status FROM n LEFT JOIN g USING (label) WHERE side = 1 AND label <> 'Unknown'""")
def label_marker_check(v):
    d = v.cells.select("cell", "gene", F.when(F.col("cell") % 7 == 6, "Unknown").otherwise(F.concat(F.lit("L"), F.col("cell") % 7)).alias("label"))
    m = v.lines.where("gene % 4 = 0").select(F.concat(F.lit("L"), F.col("gene") % 5).alias("label"), "gene").distinct()
    return ce.label_marker_check(d.where("cell % 2 = 0"), d.where("cell % 2 = 1"), m)


@R.add("""
    WITH x AS (SELECT gene, n / sum(n) OVER (PARTITION BY cell) * 10000 AS e FROM {cells}), c AS (SELECT count(DISTINCT cell) AS c FROM {cells}), s AS (SELECT gene, sum(e) / c AS m, (sum(e * e) - c * (sum(e) / c) * (sum(e) / c)) / (c - 1) AS v FROM x CROSS JOIN c GROUP BY gene, c),
         d AS (SELECT gene, ln(1 + m) AS mean, CASE WHEN m > 0 AND v > 0 THEN ln(v / m) END AS dispersion FROM s), b AS (SELECT *, least(19, floor((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20)) AS b FROM d),
         z AS (SELECT *, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY b)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY b), 0), 0) AS z FROM b)
    SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(z, 6) AS normalised FROM z""")
def highly_variable(v):
    c = v.cells
    return ce.highly_variable(ce.log_normalize(c), cells=c.select("cell").distinct().count()).drop("rank")


@R.add(f"""
    WITH d AS (SELECT gene AS event, discount * 10 AS v, status = 'F' AS is_case FROM {{lines}} WHERE discount > 0), r AS (SELECT *, rank() OVER (PARTITION BY event ORDER BY v) + (count(*) OVER (PARTITION BY event, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY event, v) AS t FROM d),
         g AS (SELECT event, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n2, sum(r) FILTER (is_case) AS w, sum(t * t - 1.0) AS ties, avg(v) FILTER (is_case) - avg(v) FILTER (NOT is_case) AS delta FROM r GROUP BY event),
         h AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)) AS var FROM g WHERE n1 >= 20 AND n2 >= 20), z AS (SELECT *, CASE WHEN var > 0 THEN sign(u - n1 * n2 / 2) * greatest(0.0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(var) END AS z FROM h), p AS (SELECT *, {norm_two_sided("z")} AS p FROM z)
    SELECT event, n1, n2, round(delta, 6) AS delta, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q FROM {bh("p")}""")
def psi_test(v):
    d = v.lines.select(F.col("gene").alias("event"), F.when(F.col("discount") > 0, F.col("discount") * 10).alias("psi"), (F.col("status") == "F").alias("is_case"))
    return ce.psi_test(d).select("event", "n1", "n2", "delta", "u", "z", "p", "q")


DOSES = "(SELECT site % 10 AS locus, site AS snp, site * 100 AS pos, sample, CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END AS dosage FROM {calls})"
LD = f"SELECT a.locus, a.snp AS snp_a, b.snp AS snp_b, corr(a.dosage, b.dosage) ** 2 AS r2 FROM {DOSES} a JOIN {DOSES} b ON a.locus = b.locus AND a.sample = b.sample AND a.snp < b.snp AND b.pos - a.pos <= 8000 GROUP BY ALL"


def _doses(v):
    dose = F.when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2).otherwise(0)
    return v.calls.select((F.col("site") % 10).alias("locus"), F.col("site").alias("snp"), (F.col("site") * 100).alias("pos"), "sample", dose.alias("dosage"))


@R.add(f"SELECT locus, snp_a, snp_b, round(r2, 6) AS r2 FROM ({LD})")
def ld_pairs(v):
    return gw.ld_pairs(_doses(v), window=8000)


@R.add(f"""
    WITH RECURSIVE x AS (SELECT DISTINCT locus, snp, snp * 37 % 101 / 101.0 AS p FROM {DOSES}), o AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY p, snp) AS i FROM x), l AS ({LD}), e AS (SELECT snp_a AS s, snp_b AS t FROM l WHERE r2 >= 0.02 UNION ALL SELECT snp_b, snp_a FROM l WHERE r2 >= 0.02),
         n AS (SELECT o.locus, o.i, o.snp, list(e.t) FILTER (e.t IS NOT NULL) AS near FROM o LEFT JOIN e ON e.s = o.snp GROUP BY ALL),
         k AS (SELECT locus, 1::BIGINT AS i, [snp] AS kept FROM n WHERE i = 1 UNION ALL SELECT n.locus, n.i, CASE WHEN list_has_any(coalesce(near, []), kept) THEN kept ELSE list_append(kept, n.snp) END FROM k JOIN n ON n.locus = k.locus AND n.i = k.i + 1)
    SELECT locus, snp, round(snp * 37 % 101 / 101.0, 6) AS p FROM (SELECT locus, unnest(kept) AS snp FROM (SELECT locus, arg_max(kept, i) AS kept FROM k GROUP BY locus))""")
def ld_clump(v):
    d = _doses(v)
    x = d.select("locus", "snp").distinct().withColumn("p", F.col("snp") * 37 % 101 / 101.0)
    return gw.ld_clump(x, gw.ld_pairs(d, window=8000), r2=0.02)


@R.add("""
    WITH d AS (SELECT snp // 2 AS gene, snp % 2 AS k, beta, se, size FROM {gwas1}), j AS (SELECT a.gene, a.beta AS x, b.beta AS y, a.se AS s, b.se AS t, 0.3 AS r, a.beta * 0.4 + a.size / 500.0 AS ax, b.beta * 0.4 + b.size / 500.0 AS by_ FROM d a JOIN d b ON a.gene = b.gene AND a.k = 0 AND b.k = 1),
         m AS (SELECT *, (x * x / (s * s) - 2 * r * x * y / (s * t) + y * y / (t * t)) / (1 - r * r) AS w, (x * ax / (s * s) - r * (x * by_ + y * ax) / (s * t) + y * by_ / (t * t)) / (1 - r * r) AS z FROM j)
    SELECT gene, 2::BIGINT AS snps, round(z / w, 5) AS estimate, round(1 / sqrt(w), 5) AS se FROM m""")
def cis_mr_correlated(v):
    d = v.gwas1.select(F.floor(F.col("snp") / 2).alias("gene"), "snp", "beta", (F.col("beta") * 0.4 + F.col("size") / 500.0).alias("beta_2"), F.col("se").alias("se_2"))
    both = d.groupBy("gene").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    d = d.join(both.select("gene"), "gene", "left_semi")
    ld = both.select((F.col("gene") * 2).alias("snp_a"), (F.col("gene") * 2 + 1).alias("snp_b"), F.lit(0.3).alias("r"))
    out = gw.cis_mr_correlated(d, ld)
    return out.select("gene", "snps", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


#: 25 aligned rows whose columns grow with the table, and rows of 25 columns whose number grows.
LETTERS = "substr('ACDEFGHIKL-', 1 + (CASE WHEN id % 3 = 0 THEN id // 25 ELSE id * 13 + size END) % 11, 1)"
WIDE = f"(SELECT id % 25 AS id, string_agg({LETTERS}, '' ORDER BY id) AS seq FROM {{parts}} GROUP BY id % 25)"
LONG = f"(SELECT id // 25 AS id, string_agg({LETTERS}, '' ORDER BY id) AS seq FROM {{parts}} GROUP BY id // 25 HAVING count(*) = 25)"


def _rows(v, key):
    at = F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 25)).otherwise(F.col("id") * 13 + F.col("size")) % 11 + 1
    d = v.parts.select("id", key.alias("k"), F.substr(F.lit("ACDEFGHIKL-"), at.cast("int"), F.lit(1)).alias("c")).groupBy("k")
    return d.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "c"))).alias("x")).select(F.col("k").alias("id"), "n", F.array_join(F.transform("x", lambda x: x["c"]), "").alias("seq"))


def _wide(v):
    return _rows(v, F.col("id") % 25).drop("n")


def _long(v):
    return _rows(v, F.floor(F.col("id") / 25)).where("n = 25").drop("n")


PAIRS = f"""
    WITH r AS (SELECT id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM {WIDE}), n AS (SELECT id, count(*) FILTER (c <> '-') AS n FROM r GROUP BY id),
         g AS (SELECT a.id AS id_a, b.id AS id_b, count(*) FILTER (a.c = b.c AND a.c <> '-') AS same, count(*) FILTER (a.c <> '-' AND b.c <> '-') AS both_, count(*) FILTER (a.c <> '-' OR b.c <> '-') AS one FROM r a JOIN r b ON a.i = b.i AND a.id < b.id GROUP BY ALL),
         p AS (SELECT g.*, x.n AS na, y.n AS nb FROM g JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b)"""


@R.add(PAIRS + "SELECT id_a, id_b, same::INT AS same, round(same / one, 6) AS pid1, round(same / both_, 6) AS pid2, round(same / least(na, nb), 6) AS pid3, round(same / ((na + nb) / 2), 6) AS pid4 FROM p")
def pairwise_identity(v):
    return sq.pairwise_identity(_wide(v))


@R.add(PAIRS + "SELECT id_a, id_b, round(1 - same / both_, 6) AS p, round(CASE WHEN 1 - same / both_ >= 0.85 THEN 'inf'::DOUBLE ELSE -ln(1 - (1 - same / both_) - 0.2 * (1 - same / both_) ** 2) END, 6) AS distance FROM p")
def kimura_distance(v):
    return sq.kimura_distance(_wide(v))


@R.add(PAIRS + ", k AS (SELECT id_a AS id FROM p WHERE same / both_ >= 0.37 UNION ALL SELECT id_b FROM p WHERE same / both_ >= 0.37), c AS (SELECT r.id, count(k.id) AS k FROM n r LEFT JOIN k USING (id) GROUP BY r.id) SELECT round(sum(1 / (1 + k)), 6) AS neff, count(*) AS rows FROM c")
def neff(v):
    return sq.neff(_wide(v), identity=0.37)


@R.add(PAIRS + ", k AS (SELECT id_a AS id FROM p WHERE same / both_ >= 0.62 UNION ALL SELECT id_b FROM p WHERE same / both_ >= 0.62), c AS (SELECT r.id, count(k.id) AS k FROM n r LEFT JOIN k USING (id) GROUP BY r.id), w AS (SELECT max(i)::INT AS width FROM r), e AS (SELECT sum(1 / (1 + k)) AS n FROM c) SELECT width, round(n / width, 6) AS neff_per_column, width > 100 AND n / width > 1 AS ok FROM e CROSS JOIN w")
def apc_applicable(v):
    return sq.apc_applicable(_wide(v))


CELLS = f"r AS (SELECT id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM {LONG})"


@R.add(f"""
    WITH {CELLS}, k AS (SELECT i, c, count(*) AS k, min(id) AS f FROM r WHERE c <> '-' GROUP BY ALL), n AS (SELECT i, count(*) AS n FROM r GROUP BY i), b AS (SELECT i, max(k) AS m FROM k GROUP BY i)
    SELECT i::INT AS col, min_by(c, f) AS residue, round(any_value(m / n), 6) AS share FROM b JOIN n USING (i) JOIN k USING (i) WHERE k = m AND m / n >= 0.12 GROUP BY i""")
def conserved_positions(v):
    return sq.conserved_positions(_long(v), least=0.12)


BACKGROUND = dict.fromkeys("ACDEFGHIKL", 0.1)


@R.add(f"""
    WITH {CELLS}, k AS (SELECT i, c, count(*) AS k FROM r WHERE c <> '-' GROUP BY ALL), n AS (SELECT i, sum(k) AS n FROM k GROUP BY i)
    SELECT id, round(sum(log2((k + 0.1) / (n + 1) / 0.1)), 6) AS score FROM r JOIN k USING (i, c) JOIN n USING (i) GROUP BY id""")
def score_site(v):
    rows = _long(v)
    return sq.score_site(rows, sq.pssm(rows, BACKGROUND))


@R.add("SELECT snp, round((beta * 0.4 + size / 500.0) / beta, 6) AS wald, round(se / abs(beta), 6) AS wald_se FROM {gwas1} WHERE beta <> 0")
def wald_ratio(v):
    d = v.gwas1.select("snp", "beta", (F.col("beta") * 0.4 + F.col("size") / 500.0).alias("beta_2"), F.col("se").alias("se_2"))
    return gw.wald_ratio(d).select("snp", "wald", "wald_se")


@R.add(f"""
    WITH {CELLS.replace(LONG, WIDE)}, f AS (SELECT i, count(DISTINCT c) AS k FROM r GROUP BY i HAVING count(*) FILTER (c = '-') = 0), n AS (SELECT i, c, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT id, sum(1 / (k * n)) AS w FROM r JOIN f USING (i) JOIN n USING (i, c) GROUP BY id)
    SELECT id, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def sequence_weights(v):
    return sq.sequence_weights(_wide(v))


@R.add(f"""
    WITH {CELLS}, p AS (SELECT a.i, b.i AS j, a.c AS x, b.c AS y, count(*) AS k FROM r a JOIN r b ON a.id = b.id AND a.i < b.i WHERE a.c <> '-' AND b.c <> '-' GROUP BY ALL),
         q AS (SELECT *, sum(k) OVER (PARTITION BY i, j) AS n, sum(k) OVER (PARTITION BY i, j, x) AS kx, sum(k) OVER (PARTITION BY i, j, y) AS ky FROM p), m AS (SELECT i, j, n, sum(k / n * log2(k * n / (kx * ky))) AS mi FROM q WHERE n >= 20 GROUP BY ALL),
         o AS (SELECT c, avg(mi) AS m FROM (SELECT i AS c, mi FROM m UNION ALL SELECT j, mi FROM m) GROUP BY c)
    SELECT i::INT AS i, j::INT AS j, n::BIGINT AS n, round(mi, 6) AS mi, round(mi - a.m * b.m / (SELECT avg(mi) FROM m), 6) AS mi_apc FROM m JOIN o a ON a.c = i JOIN o b ON b.c = j""")
def mutual_information_apc(v):
    return sq.mutual_information_apc(_long(v))


WINDOWS = "(SELECT id, size < 12 AS fg, translate(substr(md5(id::VARCHAR), 1, 7), '0123456789abcdef', 'ACDEFGHIKLMNPQR_') AS w FROM {parts})"


def _md5(v, n):
    return F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, n), "0123456789abcdef", "ACDEFGHIKLMNPQR_")


@R.add(f"""
    WITH r AS (SELECT fg, i - 4 AS o, substr(w, i, 1) AS c FROM (SELECT *, unnest([1, 2, 3, 5, 6, 7]) AS i FROM {WINDOWS})), k AS (SELECT o, c, count(*) FILTER (fg) AS a, count(*) FILTER (NOT fg) AS b FROM r WHERE c <> '_' GROUP BY ALL),
         t AS (SELECT *, sum(a) OVER (PARTITION BY o)::BIGINT AS fa, sum(b) OVER (PARTITION BY o)::BIGINT AS ba FROM k), x AS (SELECT *, unnest(range(a, least(fa, a + b) + 1)) AS i FROM t WHERE a > 0),
         p AS (SELECT o, c, a, fa, b, ba, least(1.0, sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(fa + ba - a - b + 1) - lgamma(fa - i + 1) - lgamma(ba - a - b + i + 1) - lgamma(fa + ba + 1) + lgamma(fa + 1) + lgamma(ba + 1)))) AS p FROM x GROUP BY ALL)
    SELECT o::INT AS "offset", c AS residue, a AS fg, fa AS fg_total, b AS bg, ba AS bg_total, round(p, 6) AS p, round(q, 6) AS q FROM {bh("p")}""")
def motif_enrichment(v):
    w = v.parts.select("size", _md5(v, 7).alias("window"))
    return pr.motif_enrichment(w.where("size < 12"), w.where("size >= 12"))


PEAKS = "(SELECT id // 20 AS spectrum, 100 + id // 80 + id % 20 * 0.04 + (id // 20 % 4) * 0.002 AS mz, (1 + size + id // 20 % 3 * id % 17)::DOUBLE AS i FROM {parts})"


@R.add(f"""
    WITH s AS (SELECT * FROM {PEAKS}), n AS (SELECT spectrum, sqrt(sum(i * i)) AS n FROM s GROUP BY spectrum),
         j AS (SELECT a.spectrum AS q, b.spectrum AS l, count(*) AS peaks, sum(a.i * b.i) AS w FROM s a JOIN s b ON abs(a.mz - b.mz) <= 0.01 AND a.spectrum % 4 = 0 AND b.spectrum % 4 <> 0 GROUP BY ALL), c AS (SELECT q, l, peaks, w / (x.n * y.n) AS score FROM j JOIN n x ON x.spectrum = q JOIN n y ON y.spectrum = l)
    SELECT q, l, peaks, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY q) AS m FROM c WHERE peaks >= 6 AND score >= 0.7) WHERE score >= m - 0.02""")
def match_spectra(v):
    s = F.floor(F.col("id") / 20)
    x = v.parts.select(s.alias("spectrum"), (100 + F.floor(F.col("id") / 80) + F.col("id") % 20 * 0.04 + s % 4 * 0.002).alias("mz"), (1 + F.col("size") + s % 3 * F.col("id") % 17).cast("double").alias("intensity"))
    return pr.match_spectra(x.where("spectrum % 4 = 0"), x.where("spectrum % 4 <> 0"))


ASSIGNED = "(SELECT id AS read, k, size + (id % 11 = k)::INT AS site, brand AS pair FROM (SELECT *, unnest([0, 1, 2]) AS k FROM {parts}) WHERE id % 7 <> k)"
JUDGED = f"(SELECT read, count(*) AS support, min(site) AS site, min(pair) AS pair, CASE WHEN count(*) < 3 THEN 'missing in a replicate' WHEN count(DISTINCT site) > 1 THEN 'unstable' WHEN NOT bool_and(pair <> 'Brand#5') THEN 'not expressed' END AS reason FROM {ASSIGNED} GROUP BY read)"


def _assigned(v):
    d = v.parts.select(F.col("id").alias("read"), "size", F.col("brand").alias("pair"))
    reps = [d.where(F.col("read") % 7 != k).select("read", (F.col("size") + (F.col("read") % 11 == k).cast("int")).alias("site"), "pair") for k in range(3)]
    return pr.consensus_assignments(reps, site=["site"], pair=["pair"], expressed=d.where("pair <> 'Brand#5'").select("pair").distinct())


@R.add(f"SELECT read, support, coalesce(reason, 'accepted') AS reason, CASE WHEN reason IS NULL THEN site END AS site, CASE WHEN reason IS NULL THEN pair END AS pair FROM {JUDGED}")
def consensus_assignments(v):
    ok, gone, _ = _assigned(v)
    gone = gone.select("read", "support", "reason", F.lit(None).cast(ok.schema["site"].dataType).alias("site"), F.lit(None).cast("string").alias("pair"))
    return ok.select("read", "support", F.lit("accepted").alias("reason"), "site", "pair").unionByName(gone)


@R.add(f"SELECT pair, count(*) AS reads, count(DISTINCT site) AS sites FROM {JUDGED} WHERE reason IS NULL GROUP BY pair")
def consensus_pair_totals(v):
    return _assigned(v)[2]


MASSES = ", ".join(f"'{k}': {m}" for k, m in pr.RESIDUE_MASS.items())


@R.add(f"""
    WITH p AS (SELECT id, 2 + id % 2 AS z, translate(substr(md5(id::VARCHAR), 1, 4 + size % 9), '0123456789abcdef', 'ACDEFGHIKLMNPQR_') AS s FROM {{parts}}), f AS (SELECT id, s, z, i, right(s, i) AS f FROM (SELECT *, unnest(range(1, least(6, len(s)) + 1)) AS i FROM p)),
         m AS (SELECT *, CASE WHEN NOT contains(f, '_') THEN {pr.WATER} + list_sum(list_transform(string_split(f, ''), lambda r: (MAP {{{{{MASSES}}}}})[r]))::DOUBLE END AS m, CASE WHEN NOT contains(s, '_') THEN {pr.WATER} + list_sum(list_transform(string_split(s, ''), lambda r: (MAP {{{{{MASSES}}}}})[r]))::DOUBLE END AS w FROM f)
    SELECT id, i::INT AS number, f AS fragment, round(m + {pr.PROTON}, 5) AS mz, round((w + z * {pr.PROTON}) / z, 5) AS precursor_mz, round(1000.0 / i, 6) AS intensity, s || '_' || z AS group_id, 'y' || i || '^1' AS annotation FROM m""")
def fragment_transitions(v):
    p = v.parts.select("id", (2 + F.col("id") % 2).alias("charge"), F.expr("translate(substr(md5(cast(id as string)), 1, cast(4 + size % 9 as int)), '0123456789abcdef', 'ACDEFGHIKLMNPQR_')").alias("sequence"))
    return pr.fragment_transitions(p).select("id", "number", "fragment", F.round("mz", 5).alias("mz"), F.round("precursor_mz", 5).alias("precursor_mz"), "intensity", "group_id", "annotation")


EXONS = "(SELECT id // 5 AS transcript, 'c' || (id // 5 % 3) AS contig, CASE WHEN id // 5 % 2 = 0 THEN '+' ELSE '-' END AS strand, id * 50 AS start, id * 50 + 20 + size % 20 AS stop FROM {parts})"


@R.add(f"""
    WITH e AS (SELECT *, sum(stop - start) OVER (PARTITION BY transcript ORDER BY CASE WHEN strand = '+' THEN start ELSE -stop END) AS z FROM {EXONS}), s AS (SELECT transcript * 10 + k AS site, transcript, 12 + k * 30 AS a, 42 + k * 30 AS b FROM (SELECT DISTINCT transcript, unnest([0, 1, 3]) AS k FROM {EXONS})),
         j AS (SELECT s.site, s.transcript, contig, strand, s.a, s.b, start, stop, greatest(s.a - (z - (stop - start)), 0) AS lo, least(s.b, z) - (z - (stop - start)) AS hi FROM s JOIN e USING (transcript) WHERE s.a < z AND s.b > z - (stop - start))
    SELECT site, transcript, contig, strand, string_agg(x || '-' || y, ',' ORDER BY x) AS blocks, sum(hi - lo) = any_value(b - a) AS covered FROM (SELECT *, CASE WHEN strand = '+' THEN start + lo ELSE stop - hi END AS x, CASE WHEN strand = '+' THEN start + hi ELSE stop - lo END AS y FROM j) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY site, transcript, contig, strand"))
def transcript_to_genome(v):
    t = F.floor(F.col("id") / 5)
    e = v.parts.select(t.alias("transcript"), F.concat(F.lit("c"), t % 3).alias("contig"), F.when(t % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 20 + F.col("size") % 20).alias("stop"))
    s = e.select("transcript").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))))
    s = s.select((F.col("transcript") * 10 + F.col("k")).alias("site"), "transcript", (12 + F.col("k") * 30).alias("t_start"), (42 + F.col("k") * 30).alias("t_stop"))
    x = sq.transcript_to_genome(s, e)
    return x.withColumn("blocks", F.array_join(F.transform("blocks", lambda b: F.concat_ws("-", b["start"], b["stop"])), ","))


@R.add(f"""
    WITH s AS (SELECT contig, id, start AS pos, size + 20 AS r, id % 37 + 5 AS a, id % 2 AS h, id // 40 % 2 AS ps FROM {{intervals}} WHERE size + 25 + id % 37 >= 30), k AS (SELECT DISTINCT contig, start // 4000 * 4000 AS start, start // 4000 * 4000 + 3000 AS stop FROM {{intervals}}),
         g AS (SELECT k.contig, k.start, k.stop, ps AS phase_set, count(*) AS snps, sum(CASE WHEN h = 0 THEN r ELSE a END)::BIGINT AS hap1, sum(CASE WHEN h = 0 THEN a ELSE r END)::BIGINT AS hap2 FROM s JOIN k ON k.contig = s.contig AND pos >= k.start AND pos < k.stop GROUP BY ALL),
         p AS (SELECT *, CASE WHEN snps >= 2 THEN least(1.0, CASE WHEN hap1 = hap2 THEN 1.0 ELSE 2 * list_sum(list_transform(range(0, least(hap1, hap2) + 1), lambda i: exp(lgamma(hap1 + hap2 + 1) - lgamma(i + 1) - lgamma(hap1 + hap2 - i + 1) - (hap1 + hap2) * ln(2)))) END) END AS p FROM g)
    SELECT contig, start, stop, phase_set, snps, hap1, hap2, round(hap1 / (hap1 + hap2), 6) AS hap1_share, CASE WHEN snps < 2 THEN 'underpowered_snp_count' WHEN q >= 0.05 THEN 'non_significant' WHEN abs(hap1 / (hap1 + hap2) - 0.5) < 0.2 THEN 'below_effect_threshold' ELSE 'significant_imbalance' END AS status, round(p, 6) AS p, round(q, 6) AS q FROM {bh("p")}""")
def ase_per_peak(v):
    i = v.intervals
    s = i.select("contig", F.col("start").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (F.col("size") + 20).cast("long").alias("ref_count"), (F.col("id") % 37 + 5).alias("alt_count"))
    h = i.select("contig", F.col("start").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (F.floor(F.col("id") / 40) % 2).alias("phase_set"), F.when(F.col("id") % 2 == 0, "A").otherwise("C").alias("hap1"))
    k = F.floor(F.col("start") / 4000) * 4000
    return rd.ase_per_peak(s, h, i.select("contig", k.alias("start"), (k + 3000).alias("stop")))


JUNCTIONS = "(SELECT contig, start // 300 * 300 AS i_start, stop // 300 * 300 + 500 AS i_stop, count(*) AS reads FROM {reads} GROUP BY ALL)"


@R.add(f"""
    WITH j AS (SELECT * FROM {JUNCTIONS}), k AS (SELECT * FROM j WHERE reads >= 4), c AS (SELECT j.reads, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.contig = j.contig AND k.i_start = j.i_start) AND EXISTS (SELECT 1 FROM k WHERE k.contig = j.contig AND k.i_stop = j.i_stop) THEN 'known'
      WHEN EXISTS (SELECT 1 FROM k WHERE k.contig = j.contig AND k.i_start = j.i_start) OR EXISTS (SELECT 1 FROM k WHERE k.contig = j.contig AND k.i_stop = j.i_stop) THEN 'partial' ELSE 'novel' END AS class FROM j)
    SELECT l.class, count(reads) AS junctions, round(count(reads) / (SELECT count(*) FROM j), 6) AS junction_share, round(coalesce(sum(reads), 0) / (SELECT sum(reads) FROM j), 6) AS read_share, coalesce(median(reads), 0.0) AS median_reads, CASE WHEN (SELECT sum(reads) FILTER (class = 'known') / sum(reads) FROM c) >= 0.8 THEN 'Healthy' WHEN (SELECT sum(reads) FILTER (class = 'known') / sum(reads) FROM c) >= 0.6 THEN 'Acceptable' ELSE 'Suspect or interesting' END AS status FROM (SELECT unnest(['known', 'partial', 'novel']) AS class) l LEFT JOIN c USING (class) GROUP BY l.class""")
def junction_class_summary(v):
    a, z = F.floor(F.col("start") / 300) * 300, F.floor(F.col("stop") / 300) * 300 + 500
    j = v.reads.groupBy("contig", a.alias("i_start"), z.alias("i_stop")).agg(F.count(F.lit(1)).alias("reads"))
    return rd.junction_class_summary(j, j.where("reads >= 4"))


@R.add(f"""
    WITH s AS (SELECT sample, avg(n) AS f, (sample < 6)::INT::DOUBLE AS g, row_number() OVER (ORDER BY sample) AS i FROM {{counts}} GROUP BY sample), p AS (SELECT i, f, p, row_number() OVER (PARTITION BY p ORDER BY ('0x' || substr(sha256('1:' || p || ':' || i), 1, 12))::BIGINT) AS k FROM s CROSS JOIN (SELECT unnest(range(1, 1000)) AS p)),
         r AS (SELECT p.p, corr(p.f, s.g) AS r FROM p JOIN s ON s.i = p.k GROUP BY p.p), o AS (SELECT corr(f, g) AS r FROM s)
    SELECT round(any_value(o.r), 6) AS r, round((count(*) FILTER (abs(r.r) >= abs(o.r) - 1e-12) + 1) / 1000, 6) AS p FROM r CROSS JOIN o""")
def factor_group_permutation(v):
    s = v.counts.groupBy("sample").agg(F.avg("n").alias("factor")).withColumn("is_case", F.col("sample") < 6)
    return mx.factor_group_permutation(s)


UNIT = "((('0x' || substr(sha256({}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


@R.add(f"""
    WITH d AS (SELECT feature, sample, CASE WHEN n > 40 THEN n::DOUBLE END AS x FROM {{counts}}), s AS (SELECT feature, quantile_cont(x, 0.01) AS q, coalesce(stddev_samp(x), 0) AS s, min(x) AS m FROM d GROUP BY feature)
    SELECT feature, sample, x, round(coalesce(x, greatest(q + 0.1 * s * sqrt(-2 * ln({UNIT.format("'1:' || feature || ':' || sample")})) * cos(2 * pi() * {UNIT.format("'2:' || sample || ':' || feature")}), 0.5 * m)), 6) AS imputed FROM d JOIN s USING (feature)""")
def impute_left_censored(v):
    d = v.counts.select("feature", "sample", F.when(F.col("n") > 40, F.col("n").cast("double")).alias("x"))
    return mx.impute_left_censored(d)


def _path(df: DataFrame, name: str) -> str:
    return f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@R.add("SELECT id AS feature, run, round(log2(min(x)), 6) AS log2 FROM (SELECT id, unnest(['a', 'a', 'b']) AS run, unnest([price, size, price + size]) AS x, unnest([0.001, size / 1000.0, 0.005]) AS q FROM {parts}) WHERE q <= 0.01 GROUP BY ALL")
def read_report_matrix(v):
    row = lambda run, x, q: F.struct(F.lit(run).alias("Run"), x.cast("double").alias("PG.MaxLFQ"), q.cast("double").alias("Q.Value"))
    rows = F.array(row("a", F.col("price"), F.lit(0.001)), row("a", F.col("size"), F.col("size") / 1000.0), row("b", F.col("price") + F.col("size"), F.lit(0.005)))
    d = v.parts.select(F.col("id").alias("Protein.Group"), F.inline(rows))
    p = _path(d, "report")
    d.write.parquet(p)
    return text.read_report_matrix(v.spark, p, limits={"Q.Value": 0.01})


@R.add("SELECT brand, count(*) AS n FROM {parts} GROUP BY brand")
def write_by_key(v):
    p = _path(v.parts, "keys")
    text.write_by_key(v.parts.select("id", "brand"), p, key="brand")
    return text.manifest(v.spark.read.schema("id long, brand string").parquet(p), key="brand")


@R.add("SELECT id, brand, size FROM {parts}")
def write_in_chunks(v):
    d = v.parts.select("id", "brand", "size")
    p = _path(d, "chunks")
    text.write_in_chunks(d, p, records=500)
    return v.spark.read.schema(d.schema).parquet(p)


T2 = """
    WITH s AS (SELECT sample, unnest([1, 2]) AS pc, unnest([balance / 1000, sample * 7919 % 101 / 10.0 - 5]) AS x FROM {suppliers})"""


def _scores(v):
    c = F.array(F.struct(F.lit(1).alias("pc"), (F.col("balance") / 1000).alias("score")), F.struct(F.lit(2).alias("pc"), (F.col("sample") * 7919 % 101 / 10.0 - 5).alias("score")))
    return v.suppliers.select("sample", F.inline(c))


@R.add(T2 + """, v AS (SELECT pc, sum(x * x) / (count(*) - 1) AS v FROM s GROUP BY pc), t AS (SELECT sample, sum(x * x / v) AS t2 FROM s JOIN v USING (pc) GROUP BY sample), n AS (SELECT count(*) AS n FROM t),
         c AS (SELECT 2.0 * (n - 1) / (n - 2) * (n - 2) / 2 * (0.05 ** (-2.0 / (n - 2)) - 1) AS crit FROM n)
    SELECT sample, round(t2, 6) AS t2, round(crit, 6) AS crit, t2 > crit AS outlier FROM t CROSS JOIN c""")
def hotelling_t2(v):
    return mx.hotelling_t2(_scores(v))


@R.add(T2 + """, f AS (SELECT sample, pc, x, unnest(['batch', 'condition']) AS factor, unnest([sample % 3, sample // 3 % 3]) AS level FROM s), g AS (SELECT pc, factor, level, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY ALL),
         a AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS mean FROM g WINDOW w AS (PARTITION BY pc, factor)), h AS (SELECT pc, factor, count(*) AS levels, sum(n) AS n, sum(n * (m - mean) ** 2) / 2 / (sum(n * v) / (sum(n) - 3)) AS f FROM a GROUP BY ALL)
    SELECT pc::INT AS pc, factor, levels, round(f, 6) AS f, round((1 + 2 * f / (n - 3)) ** (-(n - 3) / 2.0), 6) AS p FROM h""")
def pca_batch_diagnostic(v):
    s = v.suppliers.select("sample", (F.col("sample") % 3).alias("batch"), (F.floor(F.col("sample") / 3) % 3).alias("condition"))
    return mx.pca_batch_diagnostic(_scores(v), s)


@R.add()
def sample_scores(v):
    """Components have no SQL."""
    return mx.sample_scores(v.counts)
