"""Registered queries: splicing events, and tables that other families leave over."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import cells as ce
from strandloom.operators import events as ev
from strandloom.operators import matrix as mx
from strandloom.operators import validation as vl
from strandloom.plans.core import Registry
from strandloom.plans.matrices import AUC

R = Registry()


@R.add("""
    WITH d AS (SELECT suppkey AS event, partkey % 20 AS sample, avg(discount) * 10 AS psi FROM {lines} GROUP BY ALL), k AS (SELECT event FROM d GROUP BY event HAVING count(psi) >= 10 AND avg(psi) > 0.05 AND avg(psi) < 0.52)
    SELECT event, sample, round(psi, 6) AS psi FROM d SEMI JOIN k USING (event)""")
def filter_events(v):
    d = v.lines.groupBy(F.col("suppkey").alias("event"), (F.col("partkey") % 20).alias("sample")).agg((F.avg("discount") * 10).alias("psi"))
    return ev.filter_events(d, samples=20, high=0.52)


@R.add("""SELECT id AS event, round(-log10(greatest((size + 1) / 60.0::DOUBLE, 1e-300)) * abs(price - 950) / 100, 6) AS priority, size % 3 = 0 AS in_frame FROM {parts} ORDER BY -log10(greatest((size + 1) / 60.0::DOUBLE, 1e-300)) * abs(price - 950) / 100 DESC, id LIMIT 50""")
def event_priority(v):
    d = v.parts.select(F.col("id").alias("event"), ((F.col("size") + 1) / F.lit(60.0)).alias("fdr"), ((F.col("price") - 950) / 100).alias("difference"), F.col("size").alias("length"))
    return ev.event_priority(d).select("event", "priority", "in_frame")


@R.add("""
    SELECT id, round((size / 50.0::DOUBLE + 0.5) / 2, 6) AS mean_psi, least(size + 3, 2 * size + 1)::DOUBLE AS min_reads FROM {parts}""")
def replicate_cell_stats(v):
    s = F.col("size")
    d = v.parts.select("id", F.concat_ws(",", (s / 50.0).cast("string"), F.lit("NA"), F.lit("0.5")).alias("psi"), F.concat_ws(",", s.cast("string"), (2 * s).cast("string")).alias("ijc"), F.lit("3,1").alias("sjc"))
    return ev.replicate_cell_stats(d).select("id", "mean_psi", "min_reads")


@R.add("""
    WITH d AS (SELECT suppkey AS event, cell % 6 AS cell_type, discount * 10 AS psi FROM {lines} JOIN {cell_rows} USING (orderkey)), g AS (SELECT event, cell_type, avg(psi) AS m, count(*) AS n FROM d GROUP BY ALL HAVING count(*) >= 5)
    SELECT event, cell_type, round(m, 6) AS mean_psi, n AS cells FROM g""")
def psi_by_group(v):
    d = v.lines.join(v.cell_rows, "orderkey").select(F.col("suppkey").alias("event"), (F.col("cell") % 6).alias("cell_type"), (F.col("discount") * 10).alias("psi"))
    return ce.psi_by_group(d, least_cells=5).select("event", "cell_type", "mean_psi", "cells")


@R.add("""
    WITH r AS (SELECT CASE line % 4 WHEN 0 THEN 'LLOQ' ELSE 'L' || (line % 4) END AS level, partkey % 5 AS day, orderkey % 20 AS replicate, avg(quantity) AS value FROM {lines} GROUP BY ALL), d AS (SELECT level, day, count(*) AS k, avg(value) AS m, var_samp(value) AS v FROM r GROUP BY ALL),
         g AS (SELECT level, min(k) AS k, avg(m) AS mean, avg(v) AS msw, var_samp(m) AS vm, max(sqrt(v) / m) AS intra FROM d GROUP BY level),
         c AS (SELECT *, sqrt(msw + greatest(0.0, vm - msw / k)) / mean AS inter, CASE WHEN level = 'LLOQ' THEN 0.19 ELSE 0.155 END AS cut FROM g)
    SELECT level, round(mean, 6) AS mean, round(intra, 6) AS intra_cv, round(inter, 6) AS inter_cv, intra <= cut AND inter <= cut AS pass FROM c""")
def precision_components(v):
    """20 replicates per level and day, each the mean of all rows of one residue of the order key."""
    level = F.when(F.col("line") % 4 == 0, "LLOQ").otherwise(F.concat(F.lit("L"), F.col("line") % 4))
    d = v.lines.groupBy(level.alias("level"), (F.col("partkey") % 5).alias("day"), (F.col("orderkey") % 20).alias("replicate")).agg(F.avg("quantity").alias("value"))
    return mx.precision_components(d, lowest_cut=0.19, cut=0.155)


@R.add("""SELECT id AS sample, m AS metric, CASE WHEN m = 'price' THEN CASE WHEN price >= 980 THEN 'PASS' WHEN price >= 920 THEN 'WARN' ELSE 'FAIL' END ELSE CASE WHEN size <= 20 THEN 'PASS' WHEN size <= 40 THEN 'WARN' ELSE 'FAIL' END END AS grade FROM {parts} CROSS JOIN (SELECT unnest(['price', 'size']) AS m)""")
def grade_metrics(v):
    d = v.parts.select(F.col("id").alias("sample"), "price", F.col("size").cast("double").alias("size"))
    return mx.grade_metrics(d, {"price": (980, 920, True), "size": (20, 40, False)}).select("sample", "metric", "grade")


@R.add("""
    WITH d AS (SELECT x.cell AS sample, gene AS feature, ln(1 + n) AS v, (segment = 'BUILDING')::INT AS y, ('0x' || md5('1:' || donor)[1:8])::BIGINT % 5 AS fold FROM {cells} x JOIN {customers} USING (cell)),
         t AS (SELECT f.fold, feature, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS diff, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, var_samp(v) FILTER (y = 1) AS v1, var_samp(v) FILTER (y = 0) AS v0 FROM d JOIN range(5) f(fold) ON d.fold <> f.fold GROUP BY ALL),
         b AS (SELECT fold, feature, sign(diff) AS s FROM t WHERE n1 >= 2 AND n0 >= 2 AND v1 / n1 + v0 / n0 > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(diff) / sqrt(v1 / n1 + v0 / n0) DESC, feature) <= 20),
         s AS (SELECT fold, sample, y AS label, avg(v * s) AS score FROM d JOIN b USING (fold, feature) GROUP BY ALL),
         """ + AUC.replace("{by}", "fold,").replace("{part}", "(PARTITION BY fold)").replace("{pw}", "PARTITION BY fold").replace("{end}", "GROUP BY fold").replace("SELECT fold,", "SELECT fold::INT AS fold,", 2).replace("SELECT fold::INT AS fold, score", "SELECT fold, score", 1))
def grouped_cv_auc(v):
    d = v.cells.join(v.customers, "cell").select("cell", "gene", F.log1p("n").alias("x"), F.col("donor").alias("patient"), (F.col("segment") == "BUILDING").cast("int").alias("label"))
    return vl.grouped_cv_auc(d, feature="gene", sample="cell")
