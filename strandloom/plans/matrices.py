"""Registered queries: statistics, count matrices, screens, proteomics, cells, metabolites, taxa."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import cells as ce
from strandloom.operators import matrix as mx
from strandloom.operators import proteins as pr
from strandloom.operators import stats as st
from strandloom.operators import validation as va
from strandloom.plans.core import Registry, bh, norm_two_sided, t_two_sided

R = Registry()

P_SQL = "SELECT psm, kind, (psm * 7919 % 10007 + 1) / 10008.0 AS p FROM {psms} WHERE psm % 17 <> 0 UNION ALL SELECT psm, kind, NULL FROM {psms} WHERE psm % 17 = 0"


def _p(v):
    return v.psms.select("psm", "kind", F.when(F.col("psm") % 17 != 0, (F.col("psm") * 7919 % 10007 + 1) / 10008.0).alias("p"))


@R.add(f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, count(p) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p WHERE p IS NOT NULL), q AS (SELECT psm, p, min(least(1.0, p * m / r)) OVER (ORDER BY p DESC) AS q FROM r)
    SELECT psm, round(p, 6) AS p, round(q, 6) AS q FROM q UNION ALL SELECT psm, p, NULL FROM p WHERE p IS NULL""")
def adjust_p_bh(v):
    return st.adjust_p(_p(v).select("psm", "p"))


@R.add(f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, count(p) OVER (PARTITION BY kind) AS m, count(*) OVER (PARTITION BY kind ORDER BY p) AS r FROM p WHERE p IS NOT NULL), q AS (SELECT psm, kind, min(least(1.0, p * m / r)) OVER (PARTITION BY kind ORDER BY p DESC) AS q FROM r)
    SELECT psm, kind, round(q, 6) AS q FROM q UNION ALL SELECT psm, kind, NULL FROM p WHERE p IS NULL""")
def adjust_p_by_group(v):
    return st.adjust_p(_p(v), by=["kind"]).select("psm", "kind", "q")


@R.add(f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, count(p) OVER () AS m, rank() OVER (ORDER BY p) AS r FROM p WHERE p IS NOT NULL), q AS (SELECT psm, max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY p) AS q FROM r)
    SELECT psm, round(q, 6) AS q FROM q""")
def adjust_p_holm(v):
    return st.adjust_p(_p(v).where("p is not null").select("psm", "p"), method="holm").select("psm", "q")


@R.add(f"""
    WITH p AS ({P_SQL}), r AS (SELECT *, count(p) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p WHERE p IS NOT NULL), h AS (SELECT m, CASE WHEN m <= 1000 THEN list_sum(list_transform(range(1, m + 1), lambda k: 1.0::DOUBLE / k)) ELSE ln(m) + 0.5772156649015329 + 1 / (2.0::DOUBLE * m) - 1 / (12.0::DOUBLE * m * m) END AS c FROM (SELECT count(p) AS m FROM p)),
         q AS (SELECT psm, min(least(1.0, p * m * (SELECT c FROM h) / r)) OVER (ORDER BY p DESC) AS q FROM r)
    SELECT psm, round(q, 6) AS q FROM q""")
def adjust_p_by(v):
    return st.adjust_p(_p(v).where("p is not null").select("psm", "p"), method="by").select("psm", "q")


@R.add(f"SELECT psm, CASE WHEN p IS NOT NULL THEN round(least(1.0, p * count(p) OVER ()), 6) END AS q FROM ({P_SQL})")
def adjust_p_bonferroni(v):
    return st.adjust_p(_p(v).select("psm", "p"), method="bonferroni").select("psm", "q")


RANKS = """
    WITH d AS (SELECT feature, n AS v, is_case FROM {counts}), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, v) AS t FROM d),
    g AS (SELECT feature, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n2, coalesce(sum(r) FILTER (is_case), 0) AS w, sum(t * t - 1.0) AS ties FROM r GROUP BY feature),
    h AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)) AS var FROM g)"""


@R.add(RANKS + "SELECT feature, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(" + norm_two_sided("z") + ", 6) AS p FROM (SELECT *, CASE WHEN var > 0 THEN (u - n1 * n2 / 2) / sqrt(var) END AS z FROM h)")
def rank_sum_test(v):
    return st.rank_sum_test(v.counts, value="n")


@R.add("""
    WITH g AS (SELECT feature, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n2, avg(n) FILTER (is_case) AS m1, avg(n) FILTER (NOT is_case) AS m2, var_samp(n) FILTER (is_case) AS v1, var_samp(n) FILTER (NOT is_case) AS v2 FROM {counts} GROUP BY feature),
         h AS (SELECT *, v1 / n1 AS e1, v2 / n2 AS e2 FROM g),
         w AS (SELECT feature, n1, n2, m1 - m2 AS diff, CASE WHEN n1 >= 2 AND n2 >= 2 AND e1 + e2 > 0 THEN (m1 - m2) / sqrt(e1 + e2) END AS t,
           CASE WHEN n1 >= 2 AND n2 >= 2 AND e1 + e2 > 0 THEN (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) END AS df, CASE WHEN n1 < 2 OR n2 < 2 THEN 'too few' WHEN coalesce(e1 + e2, 0) <= 0 THEN 'no variance' ELSE 'tested' END AS status FROM h)
    SELECT feature, n1, n2, round(diff, 6) AS diff, round(t, 6) AS t, round(df, 6) AS df, status, round(""" + t_two_sided("t", "df") + """, 6) AS p FROM w""")
def welch_test(v):
    return st.welch_test(v.counts, value="n")


@R.add("""
    WITH b AS (SELECT feature, sample % 6 AS donor, avg(n) FILTER (is_case) AS a, avg(n) FILTER (NOT is_case) AS b FROM {counts} GROUP BY ALL), g AS (SELECT feature, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY feature)
    SELECT feature, n, round(m, 6) AS mean_diff, round(t, 6) AS t, df, round(""" + t_two_sided("t", "df") + """, 6) AS p FROM (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN m / (sd / sqrt(n)) END AS t, n - 1 AS df FROM g)""")
def paired_t(v):
    return st.paired_t(v.counts.withColumn("donor", F.col("sample") % 6), value="n")


AUC = """
    g AS (SELECT {by} score, sum(label) AS tp, count(*) - sum(label) AS fp FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER {part} AS pos, sum(fp) OVER {part} AS neg FROM g WINDOW w AS ({pw} ORDER BY score DESC)),
    x AS (SELECT *, fp * (ctp - tp / 2) AS roc, tp / nullif(pos, 0) * (ctp / (ctp + cfp) + CASE WHEN ctp + cfp - tp - fp > 0 THEN (ctp - tp) / (ctp + cfp - tp - fp) ELSE 1.0 END) / 2 AS pr FROM c)
    SELECT {by} (any_value(pos) + any_value(neg))::BIGINT AS n, any_value(pos)::BIGINT AS positives, round(CASE WHEN any_value(pos) * any_value(neg) > 0 THEN sum(roc) / (any_value(pos) * any_value(neg)) END, 6) AS roc_auc, round(CASE WHEN any_value(pos) * any_value(neg) > 0 THEN sum(pr) END, 6) AS pr_auc FROM x {end}"""


@R.add("WITH s AS (SELECT * FROM {{scored}}), ".replace("{{", "{").replace("}}", "}") + AUC.replace("{by}", "").replace("{part}", "()").replace("{pw}", "").replace("{end}", ""))
def binned_auc(v):
    return st.binned_auc(v.scored)


@R.add("WITH s AS (SELECT * FROM {scored}), " + AUC.replace("{by}", "lang,").replace("{part}", "(PARTITION BY lang)").replace("{pw}", "PARTITION BY lang").replace("{end}", "GROUP BY lang"))
def auc_by_language(v):
    return st.binned_auc(v.scored, by=["lang"])


@R.add("""
    WITH d AS (SELECT lang, quality AS y, ln(n_chars + 1) AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE / greatest(length(text), 1) AS b FROM {texts} JOIN {labels} USING (id) WHERE lang IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL AND text IS NOT NULL),
         f AS (SELECT l.lang AS held, count(*) AS n, avg(y) AS y, avg(a) AS a, avg(b) AS b, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM d JOIN (SELECT DISTINCT lang FROM d) l ON d.lang <> l.lang GROUP BY l.lang),
         w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM f WHERE y > 0 AND y < 1),
         s AS (SELECT d.lang AS g, d.y AS label, w.y + wa * (d.a - w.a) + wb * (d.b - w.b) AS score FROM d JOIN w ON d.lang = w.held),
         k AS (SELECT g, avg(label) AS p, sum(CASE WHEN label = 1 THEN r END) AS r, sum(label) AS n1, count(*) - sum(label) AS n0 FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2 AS r FROM s) GROUP BY g),
         z AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS pooled FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s))
    SELECT d.lang AS held_out_batch, count(*) AS n, round(any_value(CASE WHEN n1 > 0 AND n0 > 0 THEN (r - n1 * (n1 + 1) / 2) / (n1 * n0) END), 6) AS auc,
           any_value(CASE WHEN k.g IS NULL THEN 'skipped: training batches hold one class' WHEN n1 = 0 OR n0 = 0 THEN 'AUC undefined: one class in this batch' ELSE '' END) AS note, round(any_value(pooled), 6) AS pooled_auc
    FROM d LEFT JOIN k ON k.g = d.lang CROSS JOIN z GROUP BY d.lang""")
def leave_one_batch_out_auc(v):
    spaces = (F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))) / F.greatest(F.char_length("text"), F.lit(1))
    d = v.texts.join(v.labels, "id").select("lang", "quality", F.log(F.col("n_chars") + 1).alias("length"), spaces.alias("spaces"))
    return va.leave_one_batch_out(d, features=["length", "spaces"], label="quality", batch="lang")


@R.add("""
    WITH s AS (SELECT label, score / (score + 1000.0) AS p FROM {scored}), e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s)
    SELECT len(list_filter(e, lambda x: x <= p))::INT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(label), 6) AS observed FROM s CROSS JOIN e GROUP BY 1""")
def calibration_table(v):
    return st.calibration_table(v.scored.withColumn("p", F.col("score") / (F.col("score") + 1000.0)))


SURVIVAL = "(SELECT CAST(datediff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS DOUBLE) AS time, o_orderstatus = 'F' AS event, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS cause FROM orders)"


def _survival(v):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return v.table("orders").select(days.alias("time"), (F.col("o_orderstatus") == "F").alias("event"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("cause"))


@R.add(f"""
    WITH t AS (SELECT time, count(*) AS n, count(*) FILTER (event) AS d FROM {SURVIVAL} GROUP BY time), r AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM t)
    SELECT time, at_risk::BIGINT AS at_risk, d AS events, round(CASE WHEN max((d = at_risk)::INT) OVER (ORDER BY time) = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER (ORDER BY time)) END, 6) AS survival FROM r""")
def survival_curve(v):
    return st.survival_curve(_survival(v))


@R.add(f"""
    WITH t AS (SELECT time, count(*) AS n, count(*) FILTER (cause <> 0) AS a, count(*) FILTER (cause = 1) AS o FROM {SURVIVAL} GROUP BY time), r AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM t),
         l AS (SELECT *, sum(CASE WHEN a < at_risk THEN ln(1 - a / at_risk) ELSE -1e9 END) OVER (ORDER BY time) AS l FROM r), s AS (SELECT *, exp(coalesce(lag(l) OVER (ORDER BY time), 0.0)) * o / at_risk AS step FROM l)
    SELECT time, at_risk::BIGINT AS at_risk, round(sum(step) OVER (ORDER BY time), 6) AS incidence FROM s""")
def cumulative_incidence(v):
    return st.cumulative_incidence(_survival(v))


@R.add("""
    WITH c AS (SELECT a.x AS class, b.y AS status, coalesce(n, 0) AS n FROM (SELECT DISTINCT class AS x FROM {mutations}) a CROSS JOIN (SELECT DISTINCT status AS y FROM {lines}) b LEFT JOIN (SELECT CASE flag WHEN 'R' THEN 'Missense' WHEN 'A' THEN 'Nonsense' ELSE 'Silent' END AS x, status AS y, count(*) AS n FROM {lines} GROUP BY ALL) USING (x, y))
    SELECT class, status, n, CASE WHEN min(n) OVER (PARTITION BY status) = 0 THEN 'confounded' WHEN max(n) OVER (PARTITION BY status) - min(n) OVER (PARTITION BY status) > 1 THEN 'imbalanced' ELSE 'balanced' END AS verdict FROM c""")
def balance_check(v):
    x = v.lines.select(F.when(F.col("flag") == "R", "Missense").when(F.col("flag") == "A", "Nonsense").otherwise("Silent").alias("class"), "status")
    return st.balance_check(x, a="class", b="status")


@R.add("""
    WITH r AS (SELECT unit, block, row_number() OVER (PARTITION BY block ORDER BY sha256('1:' || unit), unit) AS o FROM {orders})
    SELECT unit, block, o::INT AS run_order, ['a', 'b', 'c'][(o - 1) % 3 + 1] AS arm FROM r""")
def block_randomize(v):
    return st.block_randomize(v.orders, unit="unit", block="block", arms=["a", "b", "c"])


@R.add("SELECT donor, status, round(avg(price), 6) AS mean, count(price) AS n FROM {orders} GROUP BY ALL")
def unit_aggregate(v):
    return st.unit_aggregate(v.orders, unit=["donor", "status"], value="price")


@R.add("""
    WITH z AS (SELECT is_case, count(DISTINCT sample) AS s FROM {counts} GROUP BY is_case), k AS (SELECT DISTINCT feature FROM (SELECT feature, is_case, count(DISTINCT sample) AS m FROM {counts} WHERE n > 60 GROUP BY feature, is_case) JOIN z USING (is_case) WHERE m >= 0.5 * s)
    SELECT feature, sample, n FROM {counts} SEMI JOIN k USING (feature)""")
def completeness_filter(v):
    x = v.counts.withColumn("value", F.when(F.col("n") > 60, F.col("n")))
    s = v.counts.select("sample", F.col("is_case").alias("grp")).distinct()
    return mx.completeness_filter(x, s, share=0.5).select("feature", "sample", "n")


@R.add("SELECT feature, sample, n FROM {counts} SEMI JOIN (SELECT feature FROM {counts} WHERE n > 0 GROUP BY feature HAVING count(DISTINCT sample) >= 9) USING (feature)")
def prevalence_filter(v):
    return mx.prevalence_filter(v.counts, least=9).select("feature", "sample", "n")


@R.add("""
    SELECT sample, count(*) FILTER (n > 0) AS detected, round(100 * avg((n = 0)::INT), 6) AS pct_zero, round(100 * avg((n < 30)::INT), 6) AS pct_below_30, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.9), 6) AS p90,
           round(quantile_cont(n, 0.9) / nullif(quantile_cont(n, 0.1), 0), 6) AS skew FROM {counts} GROUP BY sample""")
def library_representation(v):
    return mx.library_representation(v.counts)


@R.add("""
    WITH r AS (SELECT sample, n, row_number() OVER (PARTITION BY sample ORDER BY n, feature) AS i FROM {counts} WHERE n > 0)
    SELECT sample, count(*) AS n, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY sample""")
def gini(v):
    return mx.gini(v.counts)


LOG = "SELECT feature, sample, is_case, batch, log2(n + 1) AS x FROM {counts}"


@R.add(f"""
    WITH d AS ({LOG}), r AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2 AS r FROM d)
    SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS features, round(corr(a.x, b.x), 6) AS pearson, round(corr(a.r, b.r), 6) AS spearman FROM r a JOIN r b USING (feature) WHERE a.sample < b.sample AND a.is_case = b.is_case GROUP BY ALL""")
def replicate_correlation(v):
    return mx.sample_correlations(v.counts.withColumn("x", F.log2(F.col("n") + 1)), group="is_case")


@R.add("""
    WITH t AS (SELECT sample, sum(n) AS t FROM {counts} GROUP BY sample)
    SELECT feature, sample, round(log2(n / t * 1e6 + 1), 6) AS x FROM {counts} JOIN t USING (sample)""")
def normalize_cpm_log(v):
    return mx.normalize_cpm_log(v.counts).select("feature", "sample", "x")


@R.add("""
    WITH t AS (SELECT sample, sum(n) AS t FROM {counts} GROUP BY sample), c AS (SELECT feature, sample, n / t * 1e6 AS x FROM {counts} JOIN t USING (sample)),
         g AS (SELECT feature, coalesce(avg(x) FILTER (sample = 0), 0) AS p, coalesce(avg(x) FILTER (sample = 1), 0) AS a, coalesce(avg(x) FILTER (sample = 2), 0) AS b FROM c GROUP BY feature),
         l AS (SELECT feature, (log2((a + 0.5) / (p + 0.5)) + log2((b + 0.5) / (p + 0.5))) / 2 AS lfc FROM g)
    SELECT feature, round(lfc - (SELECT quantile_cont(lfc, 0.5) FROM l WHERE feature % 10 = 0), 6) AS lfc FROM l""")
def guide_lfc(v):
    x = mx.normalize_cpm_log(v.counts, log="none")
    return mx.guide_lfc(x, late=[1, 2], plasmid=0, controls=F.col("feature") % 10 == 0)


LFC = "SELECT partkey AS guide, partkey % 200 AS gene, avg(discount) * 10 - 0.5 AS lfc FROM {lines} GROUP BY partkey"


def _lfc(v):
    return v.lines.groupBy(F.col("partkey").alias("guide")).agg((F.avg("discount") * 10 - 0.5).alias("lfc")).withColumn("gene", F.col("guide") % 200)


GENE_Z = f"(SELECT gene, avg(lfc) AS mean, stddev_samp(lfc) AS sd, count(*) AS n FROM ({LFC}) GROUP BY gene)"


@R.add(f"""
    WITH g AS {GENE_Z}, c AS (SELECT quantile_cont(mean, 0.5) AS m, stddev_samp(mean) AS s FROM g WHERE gene < 20), z AS (SELECT gene, mean, sd, n, (mean - m) / s AS z FROM g CROSS JOIN c), p AS (SELECT *, {norm_two_sided("z")} AS p FROM z)
    SELECT gene, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q FROM {bh("p")}""")
def gene_zscore(v):
    return mx.gene_zscore(_lfc(v), controls=F.col("gene") < 20)


@R.add(f"""
    WITH d AS ({LFC}), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(abs(lfc), 9) DESC, guide) AS r FROM d)
    SELECT gene, count(*) AS guides, round(max(lfc) FILTER (r = 2), 6) AS second_best, count(*) < 2 AS single_guide FROM r GROUP BY gene""")
def second_best(v):
    d = _lfc(v).withColumn("lfc", F.round("lfc", 9))
    return mx.second_best(d)


@R.add("""
    WITH s AS (SELECT sample, quantile_cont(log2(n + 1), 0.5) AS m FROM {counts} GROUP BY sample)
    SELECT feature, sample, round(log2(n + 1) - m + (SELECT quantile_cont(m, 0.5) FROM s), 6) AS centred FROM {counts} JOIN s USING (sample)""")
def median_center(v):
    return mx.median_center(v.counts.withColumn("x", F.log2(F.col("n") + 1))).select("feature", "sample", "centred")


@R.add("""
    WITH s AS (SELECT sample, sum(n) AS t FROM {counts} GROUP BY sample) SELECT feature, sample, round(n * (SELECT avg(t) FROM s) / t, 6) AS scaled FROM {counts} JOIN s USING (sample)""")
def loading_normalize(v):
    return mx.loading_normalize(v.counts, value="n").select("feature", "sample", "scaled")


@R.add("""
    WITH r AS (SELECT feature, batch AS plex, exp(avg(ln(n))) AS r FROM {counts} WHERE sample < 4 AND n > 0 GROUP BY ALL), t AS (SELECT feature, exp(avg(ln(r))) AS g FROM r GROUP BY feature HAVING count(*) = 2)
    SELECT c.feature, c.sample, round(n * g / r, 6) AS bridged FROM {counts} c LEFT JOIN r ON r.feature = c.feature AND r.plex = c.batch LEFT JOIN t ON t.feature = c.feature""")
def irs_bridge(v):
    return mx.irs_bridge(v.counts.withColumn("plex", F.col("batch")).withColumn("is_ref", F.col("sample") < 4), value="n").select("feature", "sample", "bridged")


@R.add("""
    WITH d AS (SELECT feature, is_case, count(*) AS n, stddev_samp(n) / avg(n) AS cv, sqrt(exp(var_samp(ln(n))) - 1) AS gcv FROM {counts} WHERE n > 0 GROUP BY ALL)
    SELECT is_case AS grp, round(quantile_cont(cv, 0.5), 6) AS median_cv, round(quantile_cont(gcv, 0.5), 6) AS median_gcv, count(*) FILTER (n = 1) AS singletons FROM d GROUP BY is_case""")
def cv_and_missingness(v):
    s = v.counts.select("sample", F.col("is_case").alias("grp")).distinct()
    return mx.cv_and_missingness(v.counts.drop("is_case"), s, value="n")


@R.add("""
    WITH m AS (SELECT feature, count(*) FILTER (n > 0) / 12 AS detection, stddev_samp(n) FILTER (batch = 0) / avg(n) FILTER (batch = 0) AS rsd, quantile_cont(n, 0.5) FILTER (batch = 0) AS q, quantile_cont(n, 0.5) FILTER (batch = 1) AS b FROM {counts} GROUP BY feature),
         d AS (SELECT feature, 1.4826 * quantile_cont(abs(n - q), 0.5) FILTER (batch = 0) AS mq, 1.4826 * quantile_cont(abs(n - b), 0.5) FILTER (batch = 1) AS mb FROM {counts} JOIN m USING (feature) GROUP BY feature)
    SELECT feature, round(detection, 6) AS detection, round(rsd, 6) AS qc_rsd, round(mq / nullif(mb, 0), 6) AS d_ratio, coalesce(detection >= 0.5 AND rsd <= 0.3 AND mq / nullif(mb, 0) <= 0.5, false) AS kept FROM m JOIN d USING (feature)""")
def qc_feature_filter(v):
    return mx.qc_feature_filter(v.counts.withColumn("is_qc", F.col("batch") == 0), value="n", samples=12)


@R.add("""
    WITH r AS (SELECT feature, quantile_cont(n, 0.5) AS r FROM {counts} WHERE batch = 0 AND n > 0 GROUP BY feature), q AS (SELECT sample, quantile_cont(n / r, 0.5) AS f FROM {counts} JOIN r USING (feature) WHERE r > 0 AND n > 0 GROUP BY sample)
    SELECT feature, sample, round(f, 6) AS factor, round(n / f, 6) AS normalised FROM {counts} JOIN q USING (sample)""")
def pqn_normalize(v):
    return mx.pqn_normalize(v.counts, value="n", reference=F.col("batch") == 0).select("feature", "sample", "factor", "normalised")


@R.add("""
    WITH s AS (SELECT partkey % 20 AS analyte, concat_ws(':', orderkey, line) AS sample, quantity AS x, price / 1000 AS y FROM {lines} WHERE quantity > 0), g AS (SELECT analyte, sum(1 / (x * x)) AS w, sum(1 / x) AS wx, sum(y / (x * x)) AS wy, count(*)::DOUBLE AS wxx, sum(y / x) AS wxy, min(x) AS lo FROM s GROUP BY analyte),
         f AS (SELECT analyte, lo, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b, (wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w AS a FROM g),
         l AS (SELECT analyte, min(x) AS lloq FROM s JOIN f USING (analyte) WHERE abs((y - a) / b / x - 1) <= CASE WHEN x = lo THEN 0.2 ELSE 0.15 END GROUP BY analyte)
    SELECT s.analyte, s.sample, round(b, 4) AS slope, round(a, 4) AS intercept, lloq, round(CASE WHEN (y - a) / b >= lloq THEN (y - a) / b END, 4) AS concentration FROM s JOIN f USING (analyte) LEFT JOIN l USING (analyte)""")
def weighted_calibration(v):
    s = v.lines.where("quantity > 0").select((F.col("partkey") % 20).alias("analyte"), F.concat_ws(":", "orderkey", "line").alias("sample"), F.col("quantity").alias("x"), (F.col("price") / 1000).alias("y"))
    out = mx.weighted_calibration(s, s.select("analyte", "sample", "y"))
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "concentration")})


@R.add("""
    WITH t AS (SELECT sample, sum(n) AS t, count(*) AS observed, sum(n * ln(n)) AS l, sum(n * n) AS q FROM {counts} WHERE n > 0 GROUP BY sample)
    SELECT sample, observed, round(ln(t) - l / t, 6) AS shannon, round(exp(ln(t) - l / t), 4) AS effective, round(t * t / q, 4) AS inverse_simpson FROM t""")
def alpha_diversity(v):
    d = mx.alpha_diversity(v.counts)
    return d.select("sample", "observed", "shannon", F.round("effective", 4).alias("effective"), F.round("inverse_simpson", 4).alias("inverse_simpson"))


@R.add("""
    WITH d AS (SELECT sample, n, sum(n) OVER (PARTITION BY sample) AS t, unnest([100, 300, 1000, 3000, 100000]) AS depth FROM {counts} WHERE n > 0),
         c AS (SELECT sample, depth, sum(1 - CASE WHEN t - n >= depth THEN exp(lgamma(t - n + 1) - lgamma(t - n - depth + 1) - lgamma(t + 1) + lgamma(t - depth + 1)) ELSE 0 END) AS e FROM d WHERE depth <= t GROUP BY ALL),
         s AS (SELECT depth, lead(depth) OVER (ORDER BY depth) AS next FROM (SELECT DISTINCT depth FROM c)),
         g AS (SELECT c.depth, count(*) / (SELECT count(DISTINCT sample) FROM {counts}) AS kept, avg(c.e) AS m, avg(o.e - c.e) / avg(CASE WHEN o.e IS NOT NULL THEN c.e END) / (any_value(s.next - s.depth) / 1000) AS gain FROM c JOIN s USING (depth) LEFT JOIN c o ON o.sample = c.sample AND o.depth = s.next GROUP BY c.depth)
    SELECT depth::INT AS depth, round(kept, 6) AS kept, round(m, 3) AS mean_expected, coalesce(gain < 0.3, false) AS plateau FROM g WHERE kept >= 0.85 ORDER BY coalesce(gain < 0.3, false) DESC, CASE WHEN gain < 0.3 THEN depth ELSE -depth END LIMIT 1""")
def pick_depth(v):
    d = mx.pick_depth(v.counts.select("sample").distinct(), mx.rarefaction_curve(v.counts, [100, 300, 1000, 3000, 100_000]), gain=0.3)
    return d.select("depth", "kept", F.round("mean_expected", 3).alias("mean_expected"), "plateau")


@R.add("""
    WITH t AS (SELECT sample, sum(n) AS t FROM {counts} GROUP BY sample), m AS (SELECT a.sample AS sample_a, b.sample AS sample_b, sum(least(a.n, b.n)) AS m FROM {counts} a JOIN {counts} b USING (feature) WHERE a.sample < b.sample GROUP BY ALL)
    SELECT sample_a, sample_b, round(1 - 2 * m / (x.t + y.t), 6) AS bray_curtis FROM m JOIN t x ON x.sample = sample_a JOIN t y ON y.sample = sample_b""")
def beta_diversity(v):
    return mx.beta_diversity(v.counts)


@R.add("""
    WITH d AS (SELECT sample, n, sum(n) OVER (PARTITION BY sample) AS t, unnest([100, 1000]) AS depth FROM {counts} WHERE n > 0)
    SELECT sample, depth, round(sum(1 - CASE WHEN t - n >= depth THEN exp(lgamma(t - n + 1) - lgamma(t - n - depth + 1) - lgamma(t + 1) + lgamma(t - depth + 1)) ELSE 0 END), 3) AS expected FROM d WHERE depth <= t GROUP BY ALL""")
def rarefaction_curve(v):
    d = mx.rarefaction_curve(v.counts, [100, 1000])
    return d.select("sample", "depth", F.round("expected", 3).alias("expected"))


@R.add("""
    WITH g AS (SELECT f.feature, s.sample, ln(coalesce(n, 0) + 0.5) AS l FROM (SELECT DISTINCT feature FROM {counts}) f CROSS JOIN (SELECT DISTINCT sample FROM {counts}) s LEFT JOIN {counts} c ON c.feature = f.feature AND c.sample = s.sample)
    SELECT feature, sample, round(l - avg(l) OVER (PARTITION BY sample), 6) AS clr FROM g""")
def clr_transform(v):
    return mx.clr_transform(v.counts)


@R.add("""
    WITH x AS (SELECT feature, (feature % 97) / 30.0 AS nsti FROM {counts} GROUP BY feature)
    SELECT count(DISTINCT feature) FILTER (nsti > 2.0) AS dropped_taxa, round(sum(CASE WHEN nsti > 2.0 THEN n ELSE 0 END) / sum(n), 6) AS dropped_share FROM {counts} LEFT JOIN x USING (feature)""")
def reads_dropped_share(v):
    n = v.counts.select("feature", ((F.col("feature") % 97) / 30.0).alias("nsti")).distinct()
    return mx.reads_dropped_share(n, v.counts)


@R.add("""
    WITH s AS (SELECT sample, is_case AS grp, sum(n)::BIGINT AS total, count(*) AS ids FROM {counts} WHERE n > 0 GROUP BY ALL), g AS (SELECT grp, quantile_cont(total, 0.5) AS g, quantile_cont(ids, 0.5) AS i FROM s GROUP BY grp)
    SELECT sample, grp, total, ids, round(100 * (1 - ids / (SELECT count(DISTINCT feature) FROM {counts})), 6) AS missing_pct, round(total / g, 6) AS fold, round(ids / i, 6) AS ids_fold, total / g <= 0.97 OR ids / i < 0.99 AS flag FROM s JOIN g USING (grp)""")
def sample_raw_qc(v):
    s = v.counts.select("sample", F.col("is_case").alias("grp")).distinct()
    return mx.sample_raw_qc(v.counts.drop("is_case"), s, value="n", least_fold=0.97, least_ids=0.99).select("sample", "grp", "total", "ids", "missing_pct", "fold", "ids_fold", "flag")


@R.add("""
    WITH g AS (SELECT cell, count(*) FILTER (n >= 60) AS k, min(struct_pack(k := -n, g := gene)) AS t FROM {cells} GROUP BY cell)
    SELECT cell, k AS guides, CASE WHEN k = 0 THEN 'none' WHEN k > 1 THEN 'multiplet' ELSE t.g::VARCHAR END AS assignment FROM g""")
def assign_guide_per_cell(v):
    return mx.assign_guide_per_cell(v.cells, guide="gene", least=60)


@R.add("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, gene) AS r FROM {cells} WHERE n > 0)
    SELECT cell, sum(n)::BIGINT AS total, count(*) AS genes, round(100 * sum(CASE WHEN gene < 10 THEN n ELSE 0 END) / sum(n), 6) AS pct_mito, round(100 * sum(CASE WHEN gene BETWEEN 10 AND 30 THEN n ELSE 0 END) / sum(n), 6) AS pct_ribo, round(100 * sum(CASE WHEN r <= 20 THEN n ELSE 0 END) / sum(n), 6) AS pct_top FROM r GROUP BY cell""")
def cell_qc(v):
    return ce.cell_qc(v.cells, mito=F.col("gene") < 10, ribo=F.col("gene").between(10, 30))


MAD = """WITH m AS (SELECT donor, quantile_cont(score, 0.5) AS m FROM {customers} GROUP BY donor), d AS (SELECT c.*, m FROM {customers} c JOIN m USING (donor)),
              a AS (SELECT donor, quantile_cont(abs(score - m), 0.5) AS mad FROM d GROUP BY donor)"""


@R.add(MAD + """ SELECT cell, round(mad, 6) AS mad, score < m - 1.8 * mad OR score > m + 1.8 * mad AS outlier FROM d JOIN a USING (donor)""")
def mad_outliers(v):
    return ce.mad_outliers(v.customers, metric="score", nmads=1.8, by=["donor"]).select("cell", "mad", "outlier")


@R.add("""
    WITH c AS (SELECT cell, sum(n)::DOUBLE AS total, count(*)::DOUBLE AS genes FROM {cells} GROUP BY cell), m AS (SELECT quantile_cont(total, 0.5) AS mt, quantile_cont(genes, 0.5) AS mg FROM c),
         a AS (SELECT quantile_cont(abs(total - mt), 0.5) AS dt, quantile_cont(abs(genes - mg), 0.5) AS dg FROM c, m)
    SELECT cell, total, genes FROM c, m, a WHERE abs(total - mt) <= 3 * dt AND abs(genes - mg) <= 3 * dg AND total <= 100000""")
def mad_filter(v):
    c = v.cells.groupBy("cell").agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("genes"))
    return ce.mad_filter(c, metrics={"total": 3.0, "genes": 3.0}, hard=F.col("total") > 100_000)


@R.add("""
    WITH c AS (SELECT cell, count(*) AS k, 100 * sum(CASE WHEN gene < 10 THEN n ELSE 0 END) / sum(n) AS m FROM {cells} WHERE n > 0 GROUP BY cell HAVING count(*) >= 20), d AS (SELECT * FROM {cells} JOIN c USING (cell)), g AS (SELECT gene FROM d WHERE n > 0 GROUP BY gene HAVING count(*) >= 100)
    SELECT cell, gene, n FROM d SEMI JOIN g USING (gene) WHERE k < 100 AND m < 8""")
def filter_cells_genes(v):
    return ce.filter_cells_genes(v.cells, mito=F.col("gene") < 10, min_genes=20, max_genes=100, max_mito=8, min_cells=100).select("cell", "gene", "n")


@R.add("""
    WITH s AS (SELECT cell, donor, segment FROM {customers}), k AS (SELECT donor, segment FROM s GROUP BY ALL HAVING count(*) >= 5)
    SELECT gene, donor, segment, sum(n)::BIGINT AS n FROM {cells} JOIN s USING (cell) SEMI JOIN k USING (donor, segment) GROUP BY ALL""")
def pseudobulk(v):
    return ce.pseudobulk(v.cells, v.customers, keys=["donor", "segment"], min_cells=5)


@R.add("""
    WITH t AS (SELECT cell, sum(n) AS t FROM {cells} GROUP BY cell), x AS (SELECT c.cell, gene, ln(1 + n / t * 10000) AS x, cluster FROM {cells} c JOIN t USING (cell) JOIN {customers} u USING (cell)), na AS (SELECT count(*) AS a FROM {customers}), sz AS (SELECT cluster, count(*) AS n1 FROM {customers} GROUP BY cluster),
         g AS (SELECT cluster, gene, count(*) AS k1 FROM x GROUP BY ALL), a AS (SELECT gene, count(*) AS nz FROM x GROUP BY gene)
    SELECT cluster, gene, round(k1 / n1, 6) AS share_in, round((nz - k1) / nullif(a - n1, 0), 6) AS share_out FROM g JOIN a USING (gene) JOIN sz USING (cluster) CROSS JOIN na""")
def marker_genes(v):
    return ce.marker_genes(ce.log_normalize(v.cells), v.customers, top=1000).select("cluster", "gene", "share_in", "share_out")


@R.add("""
    WITH d AS (SELECT cell, gene, ln(1 + n) AS l FROM {cells}), m AS (SELECT cell, sum(l) / 200 AS m FROM d GROUP BY cell) SELECT cell, gene, round(l - m, 6) AS clr FROM d JOIN m USING (cell)""")
def cell_clr(v):
    return ce.cell_clr(v.cells, features=200).select("cell", "gene", "clr")


@R.add("""SELECT donor, count(*) FILTER (cluster = 0) AS "0", count(*) FILTER (cluster = 1) AS "1", count(*) FILTER (cluster = 2) AS "2", count(*) FILTER (cluster = 3) AS "3" FROM {customers} GROUP BY donor""")
def composition_table(v):
    return ce.composition_table(v.customers, sample="donor", kind="cluster", kinds=[0, 1, 2, 3])


@R.add("""
    WITH b AS (SELECT cell, cluster AS a, (cell % 7 + cluster) % 8 AS b FROM {customers}), y AS (SELECT a, b, count(*) AS k FROM b GROUP BY a, b), x AS (SELECT *, sum(k) OVER (PARTITION BY a) AS na, sum(k) OVER (PARTITION BY b) AS nb FROM y)
    SELECT a AS cluster, round(max(k / (na + nb - k)), 6) AS stability, 1::BIGINT AS replicates FROM x GROUP BY a""")
def cluster_stability(v):
    again = v.customers.select(F.lit(1).alias("replicate"), "cell", ((F.col("cell") % 7 + F.col("cluster")) % 8).alias("cluster"))
    return ce.cluster_stability(v.customers.select("cell", "cluster"), again)


@R.add("""
    WITH p AS (SELECT cluster, max(k) / sum(k) AS purity FROM (SELECT cluster, segment, count(*) AS k FROM {customers} GROUP BY ALL) GROUP BY cluster)
    SELECT cluster, count(*) AS cells, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg((score < 0)::INT), 6) AS doublet_rate, round(any_value(purity), 6) AS purity FROM {customers} JOIN p USING (cluster) GROUP BY cluster""")
def cluster_qc(v):
    return ce.cluster_qc(v.customers.withColumn("doublet", F.col("score") < 0), sample="segment", metrics=["score"])


@R.add("""
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY score DESC, psm) AS r FROM {psms}) WHERE r = 1), d AS (SELECT *, starts_with(lower(protein), 'decoy_') AS decoy FROM b),
         c AS (SELECT *, count(*) FILTER (decoy) OVER w AS nd, count(*) FILTER (NOT decoy) OVER w AS nt FROM d WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), f AS (SELECT *, (nd + 1) / greatest(nt, 1) AS fdr FROM c)
    SELECT scan, psm, decoy, round(fdr, 6) AS fdr, round(min(fdr) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS q FROM f""")
def target_decoy_q(v):
    return pr.target_decoy_q(v.psms).select("scan", "psm", "decoy", "fdr", "q")


@R.add("""
    WITH t AS (SELECT psm, score FROM {psms} WHERE kind <> 'error'), d AS (SELECT score FROM {psms} WHERE kind = 'error'), p AS (SELECT least(1.0, 2 * avg((score < (SELECT quantile_cont(score, 0.5) FROM d))::INT)) AS pi0 FROM t),
         b AS (SELECT score, 1 AS t, 0 AS d FROM t UNION ALL SELECT score, 0, 1 FROM d), c AS (SELECT score, sum(sum(t)) OVER w AS nt, sum(sum(d)) OVER w AS nd FROM b GROUP BY score WINDOW w AS (ORDER BY score DESC)),
         f AS (SELECT score, least(1.0, (SELECT pi0 FROM p) * nd / nullif(nt, 0)) AS fdr FROM c WHERE nt > 0), q AS (SELECT score, fdr, min(fdr) OVER (ORDER BY score) AS q FROM f)
    SELECT psm, round((SELECT pi0 FROM p), 6) AS pi0, round(fdr, 6) AS fdr, round(q, 6) AS q FROM t JOIN q USING (score)""")
def separate_search_q(v):
    x = v.psms.withColumn("scan", F.col("psm"))
    return pr.separate_search_q(x.where("kind <> 'error'").select("scan", "psm", "score"), x.where("kind = 'error'").select("scan", "score")).select("psm", "pi0", "fdr", "q")


@R.add("""
    WITH s AS (SELECT protein, list_sort(list_distinct(list(peptide % 40))) AS p FROM {peptides} GROUP BY protein)
    SELECT min(protein) AS name, count(*)::INT AS n_members, any_value(len(p))::INT AS n_peptides FROM s GROUP BY p""")
def collapse_proteins(v):
    x = v.peptides.withColumn("peptide", F.col("peptide") % 40)
    return pr.collapse_proteins(x).select("name", F.size("members").alias("n_members"), "n_peptides")


@R.add()
def parsimony_groups(v):
    return pr.parsimony_groups(pr.collapse_proteins(v.peptides.withColumn("peptide", F.col("peptide") % 300)))


@R.add("""
    WITH g AS (SELECT protein, max(intensity) AS score, regexp_replace(protein, 'DECOY_', '') AS b, starts_with(protein, 'DECOY_') AS decoy FROM (SELECT CASE WHEN peptide % 3 = 0 THEN 'DECOY_' ELSE '' END || replace(protein, 'DECOY_', '') AS protein, intensity FROM {peptides}) GROUP BY protein),
         k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, decoy) AS r FROM g), c AS (SELECT *, count(*) FILTER (decoy) OVER w AS nd, count(*) FILTER (NOT decoy) OVER w AS nt FROM k WHERE r = 1 WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
         q AS (SELECT *, min(least(1.0, CASE WHEN nt > 0 THEN nd / nt ELSE 1.0 END)) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM c)
    SELECT protein AS name, score, round(q, 6) AS q FROM q WHERE NOT decoy""")
def picked_group_fdr(v):
    x = v.peptides.select(F.concat(F.when(F.col("peptide") % 3 == 0, "DECOY_").otherwise(""), F.regexp_replace("protein", "DECOY_", "")).alias("name"), "intensity")
    g = x.groupBy("name").agg(F.max("intensity").alias("score")).withColumn("accessions", F.array("name"))
    return pr.picked_group_fdr(g).select("name", "score", "q")


@R.add("""
    WITH t AS (SELECT protein AS library, partkey % 300 AS precursor, sum(intensity) AS t FROM {peptides} GROUP BY ALL), j AS (SELECT p.protein AS library, p.partkey % 300 AS precursor, p.line, p.intensity, t.t FROM {peptides} p JOIN t ON t.library = p.protein AND t.precursor = p.partkey % 300),
         r AS (SELECT *, row_number() OVER (PARTITION BY precursor, line ORDER BY round(t, 2) DESC, library, intensity DESC) AS r FROM j)
    SELECT precursor, line, library, intensity FROM r WHERE r = 1""")
def merge_libraries(v):
    x = v.peptides.select(F.col("protein").alias("library"), (F.col("partkey") % 300).alias("precursor"), "line", "intensity")
    return pr.merge_libraries(x, transition=["precursor", "line"], precursor=["precursor"]).select("precursor", "line", "library", "intensity")


@R.add("""
    WITH f AS (SELECT DISTINCT partkey % 500 AS gene, partkey % 3 AS residue, size_ AS v FROM (SELECT partkey, discount AS size_ FROM {lines})), s AS (SELECT gene, residue, avg(v) AS value FROM f GROUP BY ALL), p AS (SELECT gene % 12 AS kinase, gene, residue FROM s WHERE (gene + residue) % 2 = 0),
         g AS (SELECT kinase, count(*) AS m, avg(value) AS mean FROM s JOIN p USING (gene, residue) GROUP BY kinase HAVING count(*) >= 2)
    SELECT kinase, m, round(mean, 6) AS mean, round(z, 6) AS z, round(""" + norm_two_sided("z") + """, 6) AS p FROM (SELECT *, (mean - (SELECT avg(value) FROM s)) * sqrt(m) / (SELECT stddev_samp(value) FROM s) AS z FROM g)""")
def kinase_activity(v):
    f = v.lines.select((F.col("partkey") % 500).alias("gene"), (F.col("partkey") % 3).alias("residue"), F.col("discount").alias("v")).distinct()
    s = f.groupBy("gene", "residue").agg(F.avg("v").alias("value"))
    p = s.where("(gene + residue) % 2 = 0").select((F.col("gene") % 12).alias("kinase"), "gene", "residue")
    return pr.kinase_activity(s, p).select("kinase", "m", "mean", "z", "p")


@R.add("""
    WITH f AS (SELECT suppkey AS query, partkey % 100 AS subject, sum(price) AS s FROM {lines} GROUP BY ALL), h AS (SELECT query, subject, row_number() OVER (PARTITION BY query ORDER BY round(s, 2) DESC, subject) AS a, row_number() OVER (PARTITION BY subject ORDER BY round(s, 2) DESC, query) AS b FROM f)
    SELECT query, subject FROM h WHERE a = 1 AND b = 1""")
def reciprocal_best_hits(v):
    f = v.lines.groupBy(F.col("suppkey").alias("query"), (F.col("partkey") % 100).alias("subject")).agg(F.round(F.sum("price"), 2).alias("bitscore"))
    b = f.select(F.col("subject").alias("query"), F.col("query").alias("subject"), "bitscore")
    return pr.reciprocal_best_hits(f, b).select("query", "subject")


@R.add("""
    SELECT query, subject, rank::INT AS rank FROM (SELECT partkey AS query, suppkey AS subject, row_number() OVER (PARTITION BY partkey ORDER BY price DESC, suppkey) AS rank FROM (SELECT partkey, suppkey, max(price) AS price, max(quantity) AS quantity FROM {lines} GROUP BY ALL) WHERE quantity * 2 >= 80) WHERE rank <= 3""")
def top_hits(v):
    x = v.lines.groupBy(F.col("partkey").alias("query"), F.col("suppkey").alias("subject")).agg(F.max("price").alias("bitscore"), (F.max("quantity") * 2).alias("coverage"))
    return pr.top_hits(x, n=3).select("query", "subject", "rank")


@R.add("""SELECT id, coalesce(clan, 'No_clan') AS clan FROM (SELECT id, 'PF' || size AS accession FROM {parts}) LEFT JOIN (SELECT 'PF' || i AS accession, 'CL' || (i % 5) AS clan FROM range(1, 30) t(i)) USING (accession)""")
def domain_clan_join(v):
    h = v.parts.select("id", F.concat(F.lit("PF"), F.col("size").cast("string"), F.lit(".3")).alias("accession"))
    c = v.spark.range(1, 30).select(F.concat(F.lit("PF"), F.col("id").cast("string")).alias("accession"), F.concat(F.lit("CL"), (F.col("id") % 5).cast("string")).alias("clan"))
    return pr.domain_clan_join(h, c).select("id", "clan")


@R.add("""
    WITH a AS (SELECT partkey AS gene, max(discount) < 0.09 AS a FROM {lines} WHERE line <= 3 GROUP BY partkey), b AS (SELECT partkey AS gene, min(tax) > 0.01 AS b FROM {lines} WHERE line >= 3 GROUP BY partkey)
    SELECT gene, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(a, false)::INT + coalesce(b, false)::INT AS n_methods FROM a FULL JOIN b USING (gene)""")
def consensus_methods(v):
    a = v.lines.where("line <= 3").groupBy(F.col("partkey").alias("gene")).agg(F.max("discount").alias("s"))
    b = v.lines.where("line >= 3").groupBy(F.col("partkey").alias("gene")).agg(F.min("tax").alias("s"))
    return pr.consensus_methods({"a": (a, F.col("s") < 0.09), "b": (b, F.col("s") > 0.01)})


@R.add("""
    WITH h AS (SELECT partkey AS gene, max(discount) < 0.09 AS a, min(tax) > 0.01 AS b, avg(quantity) > 25 AS c FROM {lines} GROUP BY partkey),
         g AS (SELECT 'a' AS a, 'b' AS b, count(*) AS genes, count(*) FILTER (a) AS ka, count(*) FILTER (b) AS kb, count(*) FILTER (a AND b) AS k FROM h UNION ALL SELECT 'a', 'c', count(*), count(*) FILTER (a), count(*) FILTER (c), count(*) FILTER (a AND c) FROM h
               UNION ALL SELECT 'b', 'c', count(*), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (b AND c) FROM h),
         p AS (SELECT g.*, least(1.0, list_sum(list_transform(range(greatest(k, ka + kb - genes), least(ka, kb) + 1), lambda i: exp(lgamma(ka + 1) - lgamma(i + 1) - lgamma(ka - i + 1) + lgamma(genes - ka + 1) - lgamma(kb - i + 1) - lgamma(genes - ka - kb + i + 1) - lgamma(genes + 1) + lgamma(kb + 1) + lgamma(genes - kb + 1))))) AS p FROM g WHERE ka > 0 AND kb > 0)
    SELECT a, b, genes, ka AS hits_a, kb AS hits_b, k AS shared, round(ka * kb / genes, 6) AS expected, round(p, 6) AS p, p <= 0.05 AS enriched FROM p""")
def method_overlap(v):
    h = v.lines.groupBy(F.col("partkey").alias("gene")).agg((F.max("discount") < 0.09).alias("a"), (F.min("tax") > 0.01).alias("b"), (F.avg("quantity") > 25).alias("c"))
    return pr.method_overlap(h, ["a", "b", "c"])


@R.add("""
    WITH t AS (SELECT protein AS library, partkey % 300 AS precursor, sum(intensity) AS t FROM {peptides} GROUP BY ALL), j AS (SELECT p.protein AS library, p.partkey % 300 AS precursor, p.line, p.intensity, t.t FROM {peptides} p JOIN t ON t.library = p.protein AND t.precursor = p.partkey % 300),
         r AS (SELECT *, row_number() OVER (PARTITION BY precursor, line ORDER BY round(t, 2) DESC, library, intensity DESC) AS r FROM j)
    SELECT count(DISTINCT precursor) AS precursors, count(DISTINCT library) AS proteins, count(*) AS transitions, round(count(*) / count(DISTINCT precursor), 1) AS transitions_per_precursor FROM r WHERE r = 1""")
def library_stats(v):
    x = v.peptides.select(F.col("protein").alias("library"), (F.col("partkey") % 300).alias("precursor"), "line", "intensity")
    return pr.library_stats(pr.merge_libraries(x, transition=["precursor", "line"], precursor=["precursor"]), precursor=["precursor"], protein="library")


@R.add("""
    WITH s AS (SELECT partkey % 20 AS analyte, concat_ws(':', orderkey, line) AS sample, price AS quantifier, quantity * 1000 AS qualifier FROM {lines}), r AS (SELECT analyte, avg(qualifier / quantifier) AS ratio FROM s WHERE sample LIKE '%:1' AND analyte <> 7 GROUP BY analyte)
    SELECT analyte, sample, round(qualifier / quantifier, 6) AS ion_ratio, coalesce(abs(qualifier / quantifier - ratio) / ratio <= 0.3, false) AS id_confirmed FROM s LEFT JOIN r USING (analyte)""")
def confirm_by_ion_ratio(v):
    s = v.lines.select((F.col("partkey") % 20).alias("analyte"), F.concat_ws(":", "orderkey", "line").alias("sample"), F.col("price").alias("quantifier"), (F.col("quantity") * 1000).alias("qualifier"))
    r = s.where("sample like '%:1' and analyte <> 7").groupBy("analyte").agg(F.avg(F.col("qualifier") / F.col("quantifier")).alias("ratio"))
    return mx.confirm_by_ion_ratio(s, r).select("analyte", "sample", "ion_ratio", "id_confirmed")


@R.add()
def feature_ols(v):
    x = v.counts.withColumn("x", F.log2(F.col("n") + 1)).withColumn("case", F.col("is_case").cast("double")).withColumn("b", F.col("batch").cast("double"))
    return mx.moderated_t(mx.feature_ols(x, design=["case", "b"], term="case"))


@R.add()
def isotope_correct(v):
    """Least squares with clipping has no SQL."""
    x = v.lines.groupBy("partkey").agg(*[F.sum(F.when(F.col("line") % 4 == k, F.col("quantity")).otherwise(0.0)).alias(f"m{k}") for k in range(4)])
    return mx.isotope_correct(x.select("partkey", F.array(*[f"m{k}" for k in range(4)]).alias("areas"), F.lit(3).alias("carbons"), F.lit(0.99).alias("purity"))).select("partkey", "enrichment", F.transform("mid", lambda x: F.round(x, 6)).alias("mid"))


@R.add()
def rarefy(v):
    return mx.rarefy(v.counts, depth=500)


@R.add()
def drift_correct(v):
    x = v.counts.withColumn("is_qc", F.col("sample") % 2 == 0).withColumn("value", F.col("n").cast("double"))
    return mx.drift_correct(x, order="sample")


@R.add("""
    WITH b AS (SELECT psm, score, lower(protein) LIKE 'decoy\\_%' ESCAPE '\\' AS decoy FROM {psms} QUALIFY row_number() OVER (PARTITION BY scan ORDER BY score DESC, psm) = 1),
         c AS (SELECT score, count(*) FILTER (decoy) AS d, count(*) FILTER (NOT decoy) AS t FROM b GROUP BY score),
         e AS (SELECT x.score, sum(y.d * exp(-(x.score - y.score) * (x.score - y.score) / 0.18)) AS d, sum(y.t * exp(-(x.score - y.score) * (x.score - y.score) / 0.18)) AS t FROM c x JOIN c y ON y.score BETWEEN x.score - 12 AND x.score + 12 GROUP BY x.score)
    SELECT psm, round(least(1.0, d / greatest(t, 1e-9)), 6) AS pep FROM b JOIN e USING (score)""")
def posterior_error(v):
    return pr.posterior_error(pr.target_decoy_q(v.psms)).select("psm", "pep")
