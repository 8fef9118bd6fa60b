"""Registered queries: summary statistics, sequences, alignments, gene sets, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import gwas as gw
from strandloom.operators import matrix as mx
from strandloom.operators import sequences as sq
from strandloom.operators import splits as sl
from strandloom.operators.components import components
from strandloom.plans.core import Registry, bh, norm_two_sided
from strandloom.scratch import Scratch

R = Registry()

HARM = """
    c AS (SELECT a.snp AS snp, a.locus AS locus, a.a1 AS a1, a.a2 AS a2, a.beta AS beta, a.se AS se, a.maf AS maf, b.a1 AS b1, b.a2 AS b2, b.beta AS beta2, b.se AS se2, b.maf AS maf2 FROM {gwas1} a JOIN {gwas2} b ON a.snp = b.snp),
    w AS (SELECT *, CASE WHEN a1 = b1 AND a2 = b2 THEN 'same' WHEN a1 = b2 AND a2 = b1 THEN 'flip' WHEN a1 = translate(b1, 'ACGT', 'TGCA') AND a2 = translate(b2, 'ACGT', 'TGCA') THEN 'complement' WHEN a1 = translate(b2, 'ACGT', 'TGCA') AND a2 = translate(b1, 'ACGT', 'TGCA') THEN 'complement_flip' END AS how FROM c),
    h AS (SELECT snp, locus, beta, se, maf, how, CASE WHEN how IN ('flip', 'complement_flip') THEN -beta2 ELSE beta2 END AS beta_2, se2 AS se_2, CASE WHEN how IN ('flip', 'complement_flip') THEN 1 - maf2 ELSE maf2 END AS maf_2 FROM w WHERE how IS NOT NULL AND NOT (a1 = translate(a2, 'ACGT', 'TGCA') AND maf > 0.42))"""


def _harmonised(v):
    return gw.harmonise_alleles(v.gwas1, v.gwas2)


@R.add(f"WITH {HARM} SELECT snp, how, round(beta, 6) AS beta, round(beta_2, 6) AS beta_2, round(maf_2, 6) AS maf_2 FROM h")
def harmonise_alleles(v):
    return _harmonised(v).select("snp", "how", "beta", "beta_2", "maf_2")


@R.add("SELECT snp FROM {gwas1} WHERE pow(beta / se, 2) >= 10")
def select_instruments(v):
    return gw.select_instruments(v.gwas1, p=None).select("snp")


@R.add(f"""
    WITH {HARM}, g AS (SELECT locus, count(*) AS snps, sum(beta * beta_2 / (se_2 * se_2)) AS xy, sum(beta * beta / (se_2 * se_2)) AS xx, sum(beta_2 * beta_2 / (se_2 * se_2)) AS yy FROM h WHERE beta <> 0 GROUP BY locus)
    SELECT locus, snps, round(xy / xx, 6) AS estimate, round(1 / sqrt(xx), 6) AS se, round(yy - xy / xx * xy, 4) AS q, snps - 1 AS q_df, round({norm_two_sided("(xy / xx * sqrt(xx))")}, 6) AS p FROM g""")
def mr_ivw(v):
    d = gw.mr_ivw(_harmonised(v), by=["locus"])
    return d.select("locus", "snps", "estimate", "se", F.round("q", 4).alias("q"), "q_df", "p")


@R.add(f"""
    WITH {HARM}, s AS (SELECT locus, abs(beta) AS x, sign(beta) * beta_2 AS y, 1 / (se_2 * se_2) AS w FROM h), g AS (SELECT locus, count(*) AS snps, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM s GROUP BY locus)
    SELECT locus, snps, round((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 6) AS intercept, round((w * wxy - wx * wy) / (w * wxx - wx * wx), 6) AS slope FROM g WHERE snps > 2""")
def mr_egger(v):
    return gw.mr_egger(_harmonised(v), by=["locus"]).where("snps > 2").select("locus", "snps", "intercept", "slope")


@R.add(f"""
    WITH {HARM}, r AS (SELECT locus, snp, beta_2 / beta AS r, pow(beta / se_2, 2) AS w FROM h WHERE beta <> 0), cw AS (SELECT *, (sum(w) OVER (PARTITION BY locus ORDER BY r, snp ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY locus) AS p FROM r),
         n AS (SELECT *, lead(r) OVER (PARTITION BY locus ORDER BY r, snp) AS r2, lead(p) OVER (PARTITION BY locus ORDER BY r, snp) AS p2 FROM cw)
    SELECT locus, count(*) AS snps, round(coalesce(max(CASE WHEN p <= 0.5 AND p2 > 0.5 THEN r + (r2 - r) * (0.5 - p) / (p2 - p) END), min(r)), 6) AS weighted_median FROM n GROUP BY locus""")
def weighted_median(v):
    return gw.weighted_median(_harmonised(v), by=["locus"])


@R.add(f"""
    WITH {HARM}, d AS (SELECT locus, snp, beta * beta_2 / (se_2 * se_2) AS xy, beta * beta / (se_2 * se_2) AS xx FROM h), t AS (SELECT locus, sum(xy) AS sxy, sum(xx) AS sxx, count(*) AS n FROM d GROUP BY locus)
    SELECT locus, snp, round((sxy - xy) / nullif(sxx - xx, 0), 6) AS estimate FROM d JOIN t USING (locus) WHERE n > 1""")
def leave_one_out(v):
    from pyspark.sql import Window

    d = gw.leave_one_out(_harmonised(v), by=["locus"])
    return d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("locus"))).where("_n > 1").drop("_n")


ABF = "0.5 * (ln({s} * {s} / ({s} * {s} + 0.0225)) + pow({b} / {s}, 2) * 0.0225 / ({s} * {s} + 0.0225))"


@R.add(f"""
    WITH {HARM}, x AS (SELECT locus, {ABF.format(s='se', b='beta')} AS a, {ABF.format(s='se_2', b='beta_2')} AS b FROM h), m AS (SELECT locus, max(a) AS ma, max(b) AS mb, max(a + b) AS mc FROM x GROUP BY locus),
         s AS (SELECT locus, count(*) AS snps, any_value(ma) + ln(sum(exp(a - ma))) AS a, any_value(mb) + ln(sum(exp(b - mb))) AS b, any_value(mc) + ln(sum(exp(a + b - mc))) AS c FROM x JOIN m USING (locus) GROUP BY locus),
         l AS (SELECT locus, snps, ln(1e-4) + a AS l1, ln(1e-4) + b AS l2, ln(1e-5) + c AS l4, ln(1e-4 * 1e-4) + a + b + ln(greatest(1e-300, 1 - exp(least(0.0, c - (a + b))))) AS l3 FROM s),
         t AS (SELECT *, greatest(0.0, l1, l2, l3, l4) AS top FROM l), z AS (SELECT *, exp(-top) + exp(l1 - top) + exp(l2 - top) + exp(l3 - top) + exp(l4 - top) AS tot FROM t)
    SELECT locus, snps, round(exp(-top) / tot, 5) AS h0, round(exp(l1 - top) / tot, 5) AS h1, round(exp(l2 - top) / tot, 5) AS h2, round(exp(l3 - top) / tot, 5) AS h3, round(exp(l4 - top) / tot, 5) AS h4 FROM z""")
def coloc_abf(v):
    d = gw.coloc_abf(_harmonised(v), by=["locus"])
    return d.select("locus", "snps", *[F.round(f"h{k}", 5).alias(f"h{k}") for k in range(5)])


@R.add(f"""
    WITH a AS (SELECT snp, locus, {ABF.format(s='se', b='beta')} AS a FROM {{gwas1}}), m AS (SELECT locus, max(a) AS m FROM a GROUP BY locus), e AS (SELECT snp, locus, exp(a - m) AS e FROM a JOIN m USING (locus)), p AS (SELECT snp, locus, e / sum(e) OVER (PARTITION BY locus) AS pip FROM e),
         c AS (SELECT *, sum(pip) OVER (PARTITION BY locus ORDER BY pip DESC, snp ROWS UNBOUNDED PRECEDING) AS c FROM p)
    SELECT locus, snp, round(pip, 6) AS pip, round(c, 6) AS cumulative FROM c""")
def single_causal_credible_set(v):
    return gw.single_causal_credible_set(v.gwas1, by=["locus"]).select("locus", "snp", "pip", "cumulative")


STREAMS = {
    "pip_top_variant": ("size / 50.0", 4), "credible_set_purity": ("(id % 10) / 10.0", 7), "coloc_pph4": ("(id % 100) / 100.0", 3), "distance_to_tss": ("id * 1000.0", 5),
    "pops_decile_rank": ("id % 3", 11), "l2g_score": ("size / 60.0", 6), "abc_score": ("(id % 7) / 100.0", 2), "encode_re2g_score": ("(id % 9) / 10.0", 9),
}
STREAM_SQL = ", ".join(f"CASE WHEN size % {k} <> 0 THEN {x} END AS {c}" for c, (x, k) in STREAMS.items())


@R.add(f"""
    WITH x AS (SELECT id, {STREAM_SQL} FROM {{parts}}), y AS (SELECT id, coalesce(pip_top_variant > 0.5 AND credible_set_purity > 0.5, false)::INT + coalesce(coloc_pph4 >= 0.7, false)::INT + coalesce(distance_to_tss <= 100000, false)::INT + coalesce(pops_decile_rank = 1, false)::INT + coalesce(l2g_score >= 0.5, false)::INT + coalesce(abc_score >= 0.02 OR encode_re2g_score >= 0.5, false)::INT AS n,
         (pip_top_variant IS NOT NULL AND credible_set_purity IS NOT NULL)::INT + (coloc_pph4 IS NOT NULL)::INT + (distance_to_tss IS NOT NULL)::INT + (pops_decile_rank IS NOT NULL)::INT + (l2g_score IS NOT NULL)::INT + (abc_score IS NOT NULL OR encode_re2g_score IS NOT NULL)::INT AS k FROM x)
    SELECT id, n AS concordance, k AS n_streams_available, CASE WHEN n >= 5 THEN 'near_certain' WHEN n >= 4 THEN 'strong' WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'suggestive' ELSE 'associational_only' END AS tier FROM y""")
def concordance_tier(v):
    x = v.parts.select("id", *[F.expr(f"CASE WHEN size % {k} <> 0 THEN {x} END").alias(c) for c, (x, k) in STREAMS.items()])
    return gw.concordance_tier(x).select("id", "concordance", "n_streams_available", "tier")


@R.add("""SELECT suppkey % 30 AS gene, round(sum(discount), 6) AS score, count(DISTINCT partkey) AS snps FROM {lines} WHERE partkey % 2 = 0 GROUP BY 1""")
def snp_to_gene(v):
    s = v.lines.select(F.col("partkey").alias("snp"), (F.col("suppkey") % 30).alias("gene"), F.col("discount").alias("score"))
    return gw.snp_to_gene(v.parts.where("id % 2 = 0").select(F.col("id").alias("snp")), s)[0]


@R.add("""
    WITH c AS (SELECT suppkey AS locus, partkey % 100 AS gene, flag AS consequence FROM {lines})
    SELECT locus, count(*) AS variants, count(*) FILTER (consequence IN ('R', 'A')) AS altering, count(DISTINCT CASE WHEN consequence IN ('R', 'A') AND gene % 3 = 0 THEN gene END) AS genes FROM c GROUP BY locus""")
def loci_evidence_count(v):
    c = v.lines.select(F.col("suppkey").alias("locus"), (F.col("partkey") % 100).alias("gene"), F.col("flag").alias("consequence"))
    g = v.spark.range(0, 100).where("id % 3 = 0").select(F.col("id").alias("gene"))
    return gw.loci_evidence_count(c, ["R", "A"], g)


SETS = "(SELECT CASE WHEN id // 2000 > 0 THEN brand || '/' || (id // 2000) ELSE brand END AS \"set\", id AS gene FROM {parts})"
HITS = "(SELECT partkey AS gene FROM {lines} GROUP BY partkey HAVING round(avg(discount), 9) > 0.052)"


def _sets(v):
    """Brands, cut by every 2,000 part keys: the number of sets grows with the table and their sizes don't."""
    bucket = F.floor(F.col("id") / 2000)
    return v.parts.select(F.when(bucket > 0, F.concat_ws("/", "brand", bucket)).otherwise(F.col("brand")).alias("set"), F.col("id").alias("gene"))


@R.add(f"""
    WITH u AS (SELECT DISTINCT partkey AS gene FROM {{lines}}), n AS (SELECT count(*) AS total, (SELECT count(*) FROM {HITS}) AS drawn FROM u), s AS (SELECT * FROM {SETS} SEMI JOIN u USING (gene)),
         g AS (SELECT "set", count(*) AS size, count(h.gene) AS k FROM s LEFT JOIN {HITS} h USING (gene) GROUP BY "set" HAVING count(*) BETWEEN 10 AND 500), x AS (SELECT *, unnest(range(k, least(size, drawn) + 1)) AS i FROM g CROSS JOIN n)
    SELECT "set", size, k, total, drawn, round(least(1.0, sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(total - size + 1) - lgamma(drawn - i + 1) - lgamma(total - size - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)))), 6) AS p FROM x GROUP BY ALL""")
def hypergeom_enrichment(v):
    h = v.lines.groupBy(F.col("partkey").alias("gene")).agg(F.round(F.avg("discount"), 9).alias("d")).where("d > 0.052")
    return sq.hypergeom_enrichment(h, v.lines.select(F.col("partkey").alias("gene")), _sets(v)).drop("q")


@R.add(f"""
    WITH d AS (SELECT partkey AS gene, round(avg(discount) - 0.05, 9) AS score FROM {{lines}} GROUP BY partkey), r AS (SELECT *, row_number() OVER (ORDER BY -score, gene) AS r, count(*) OVER () AS total FROM d), s AS (SELECT * FROM {SETS}),
         m AS (SELECT s."set", r.r, r.total, abs(score) AS w FROM s JOIN r USING (gene)), k AS (SELECT *, row_number() OVER x AS k, sum(w) OVER x AS c, sum(w) OVER (PARTITION BY "set") AS t, count(*) OVER (PARTITION BY "set") AS size FROM m WINDOW x AS (PARTITION BY "set" ORDER BY r ROWS UNBOUNDED PRECEDING)),
         e AS (SELECT "set", size, c / t - (r - k) / nullif(total - size, 0) AS hi, (c - w) / t - (r - k) / nullif(total - size, 0) AS lo FROM k WHERE size BETWEEN 10 AND 500)
    SELECT "set", size, round(CASE WHEN abs(max(hi)) >= abs(min(lo)) THEN max(hi) ELSE min(lo) END, 6) AS es FROM e GROUP BY ALL""")
def gsea_running_sum(v):
    r = v.lines.groupBy(F.col("partkey").alias("gene")).agg(F.round(F.avg("discount") - 0.05, 9).alias("score"))
    return sq.gsea_running_sum(r, _sets(v)).select("set", "size", "es")


@R.add(f"""
    WITH d AS (SELECT partkey AS gene, round(avg(discount) - 0.05, 9) AS score FROM {{lines}} GROUP BY partkey), r AS MATERIALIZED (SELECT gene, abs(score) AS w, row_number() OVER (ORDER BY -score, gene) AS r, count(*) OVER () AS total FROM d), s AS (SELECT * FROM {SETS}),
         z AS MATERIALIZED (SELECT "set", count(*) AS size FROM s SEMI JOIN r USING (gene) GROUP BY "set" HAVING count(*) BETWEEN 10 AND 500),
         g AS MATERIALIZED (SELECT draw, r, w, total, row_number() OVER (PARTITION BY draw ORDER BY md5('0:' || draw || ':' || gene)) AS o FROM r, range(200) t(draw)),
         m AS (SELECT 'set ' || z."set" AS k, size, r, w, total FROM z JOIN s USING ("set") JOIN r USING (gene) UNION ALL SELECT 'draw ' || draw || ' ' || size, size, r, w, total FROM g JOIN (SELECT DISTINCT size FROM z) ON o <= size),
         x AS (SELECT *, row_number() OVER a AS j, sum(w) OVER a AS c, sum(w) OVER (PARTITION BY k) AS t FROM m WINDOW a AS (PARTITION BY k ORDER BY r ROWS UNBOUNDED PRECEDING)),
         e AS MATERIALIZED (SELECT k, size, CASE WHEN abs(max(c / t - (r - j) / (total - size))) >= abs(min((c - w) / t - (r - j) / (total - size))) THEN max(c / t - (r - j) / (total - size)) ELSE min((c - w) / t - (r - j) / (total - size)) END AS es FROM x GROUP BY k, size),
         n AS (SELECT size, es AS v FROM e WHERE k LIKE 'draw %'),
         y AS (SELECT k[5:] AS "set", e.size, es, avg(v) FILTER (v >= 0) AS up, avg(v) FILTER (v <= 0) AS down, count(*) FILTER (v >= 0) AS n_up, count(*) FILTER (v <= 0) AS n_down, count(*) FILTER (v >= es) AS above, count(*) FILTER (v <= es) AS below
               FROM e JOIN n USING (size) WHERE k LIKE 'set %' GROUP BY ALL),
         o AS (SELECT "set", size, es, es / CASE WHEN es > 0 THEN up ELSE -down END AS nes, least((above + 1) / (n_up + 1), (below + 1) / (n_down + 1)) AS p FROM y)
    SELECT "set", size, round(es, 6) AS es, round(nes, 6) AS nes, round(p, 6) AS p, round(q, 6) AS q FROM {bh('o', 'p', '"set", size, es, nes, p')}""")
def gsea(v):
    from strandloom.operators.enrichment import gsea as run

    r = v.lines.groupBy(F.col("partkey").alias("gene")).agg(F.round(F.avg("discount") - 0.05, 9).alias("score"))
    return run(r, _sets(v), draws=200).select("set", "size", "es", "nes", "p", "q")


DNA = "(SELECT id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM {texts})"
SHOWN = "(SELECT id, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS s FROM {texts})"
ALN = f"(SELECT row || ':' || id AS id, rpad(substr(s, row * 60 + 1, 60), 60, '-') AS seq FROM (SELECT *, unnest(range(greatest((len(s) + 59) // 60, 1))) AS row FROM {SHOWN}))"
COLS = f"(SELECT id, i AS col, substr(seq, i + 1, 1) AS residue FROM (SELECT *, unnest(range(60))::INT AS i FROM {ALN}))"


def _dna(v):
    return v.texts.select("id", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def _aln(v):
    """Whole texts as aligned rows of 60 characters, the last one filled up with gaps; the id is "row:id" of the text's consecutive rows, from 0."""
    s = F.upper(F.regexp_replace("text", "[^A-Za-z]", "-"))
    rows = F.greatest(F.ceil(F.length(s) / 60), F.lit(1)).cast("int")
    d = v.texts.select("id", F.posexplode(F.regexp_extract_all(F.rpad(s, rows * 60, "-"), F.lit(".{60}"), F.lit(0))).alias("row", "seq"))
    return d.select(F.concat_ws(":", "row", "id").alias("id"), "seq")


@R.add(f"SELECT lang AS file, count(*) AS records, sum(len(seq))::BIGINT AS bases, min(len(seq))::INT AS shortest, max(len(seq))::INT AS longest, round(avg(len(seq)), 6) AS mean FROM {DNA} GROUP BY lang")
def sequence_summary(v):
    return sq.sequence_summary(_dna(v).withColumnRenamed("lang", "file"))


@R.add(f"SELECT col, count(*) FILTER (residue = '-') AS gaps, round(avg((residue = '-')::INT), 6) AS gap_share FROM {COLS} GROUP BY col")
def gap_statistics(v):
    return sq.gap_statistics(_aln(v))[1]


@R.add(f"""SELECT id FROM (SELECT id, seq, row_number() OVER (PARTITION BY seq ORDER BY id) AS r FROM {ALN} WHERE id::VARCHAR SIMILAR TO '.*[02468]' AND (len(seq) - len(replace(seq, '-', ''))) / len(seq) <= 0.3) WHERE r = 1""")
def filter_sequences(v):
    return sq.filter_sequences(_aln(v), pattern="[02468]$", max_gap=0.3).select("id")


@R.add(f"""
    WITH n AS (SELECT col, count(*) AS n FROM {COLS} GROUP BY col), k AS (SELECT col, residue, count(*) AS k, min(id) AS first_id FROM {COLS} WHERE residue <> '-' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY k DESC, first_id) AS r FROM k)
    SELECT col, residue, round(coalesce(k, 0) / n, 6) AS share, CASE WHEN residue IS NULL THEN '-' WHEN k / n >= 0.1 THEN residue ELSE 'X' END AS consensus FROM n LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (col)""")
def consensus_sequence(v):
    return sq.consensus_sequence(_aln(v), least=0.1)


@R.add(f"""
    WITH k AS (SELECT col, residue, count(*) AS k FROM {COLS} GROUP BY ALL), g AS (SELECT col, sum(k) AS n, sum(CASE WHEN residue <> '-' THEN k ELSE 0 END) AS r, max(CASE WHEN residue <> '-' THEN k END) AS m FROM k GROUP BY col), c AS (SELECT col, CASE WHEN r / n >= 0.5 THEN m / nullif(r, 0) END AS c FROM g)
    SELECT col, round(c, 6) AS conservation, round(avg(c) OVER (ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smoothed FROM c""")
def conservation_profile(v):
    return sq.conservation_profile(_aln(v))


@R.add(f"""
    WITH k AS (SELECT col, residue, count(*) AS k FROM {COLS} WHERE residue <> '-' GROUP BY ALL), p AS (SELECT col, k / sum(k) OVER (PARTITION BY col) AS p FROM k) SELECT col, round(-sum(p * log2(p)), 6) AS entropy, round(log2(26.0) + sum(p * log2(p)), 6) AS information FROM p GROUP BY col""")
def information_content(v):
    return sq.information_content(_aln(v), letters=26)


BACK = {c: 1 / 26 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@R.add(f"""
    WITH l AS (SELECT chr(65 + i::INT) AS residue FROM range(26) t(i)), k AS (SELECT col, residue, count(*) AS k FROM {COLS} GROUP BY ALL), n AS (SELECT col, count(*) FILTER (residue <> '-') AS n FROM {COLS} GROUP BY col)
    SELECT n.col, l.residue, round(log2((coalesce(k, 0) + 1 / 26.0::DOUBLE) / (n + 1.0) / (1 / 26.0::DOUBLE)), 6) AS log_odds FROM n CROSS JOIN l LEFT JOIN k ON k.col = n.col AND k.residue = l.residue""")
def pssm(v):
    return sq.pssm(_aln(v), BACK)


@R.add(f"""
    WITH l AS (SELECT chr(65 + i::INT) AS residue FROM range(26) t(i)), k AS (SELECT col, residue, count(*) AS k FROM {COLS} GROUP BY ALL), n AS (SELECT col, count(*) AS rows, count(*) FILTER (residue = '-') AS gaps, count(*) FILTER (residue <> '-') AS n FROM {COLS} GROUP BY col),
         p AS (SELECT n.col, rows, gaps, coalesce(k, 0) / nullif(n, 0) AS p, 1 / 26.0::DOUBLE AS q FROM n CROSS JOIN l LEFT JOIN k ON k.col = n.col AND k.residue = l.residue),
         j AS (SELECT col, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + q * log2(q / ((p + q) / 2))) / 2 * (1 - any_value(gaps) / any_value(rows)) * coalesce(sign(sum(p)), 0) AS jsd FROM p GROUP BY col),
         s AS (SELECT *, coalesce(sum(jsd) OVER a, 0) + coalesce(sum(jsd) OVER b, 0) AS t, count(jsd) OVER a + count(jsd) OVER b AS c FROM j WINDOW a AS (ORDER BY col ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (ORDER BY col ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT col, round(jsd, 6) AS jsd, round(0.5 * jsd + 0.5 * coalesce(t / nullif(c, 0), jsd), 6) AS smoothed FROM s""")
def jsd_conservation(v):
    return sq.jsd_conservation(_aln(v), BACK)


@R.add(f"""
    WITH k AS (SELECT col, residue, count(*) AS k FROM {COLS} WHERE residue <> '-' GROUP BY ALL)
    SELECT a.residue AS first, b.residue AS second, sum(a.k * b.k)::BIGINT AS n, CASE WHEN a.residue || b.residue IN ('AG', 'CT') THEN 'ti' WHEN a.residue || b.residue SIMILAR TO '[ACGT][ACGT]' THEN 'tv' ELSE 'other' END AS kind FROM k a JOIN k b ON a.col = b.col AND a.residue < b.residue GROUP BY a.residue, b.residue""")
def substitution_counts(v):
    return sq.substitution_counts(_aln(v))


@R.add(f"""
    SELECT c.id, sum((residue <> '-')::INT)::BIGINT AS residues FROM {COLS} c GROUP BY c.id""")
def position_map(v):
    return sq.position_map(_aln(v)).groupBy("id").agg((F.max("residue_index") + 1).cast("long").alias("residues"))


@R.add(f"""
    WITH b AS (SELECT col FROM {COLS} GROUP BY col HAVING avg((residue = '-')::INT) >= 0.2) SELECT c.id, coalesce(string_agg(residue, '' ORDER BY c.col) FILTER (b.col IS NULL), '') AS seq FROM {COLS} c LEFT JOIN b ON b.col = c.col GROUP BY c.id""")
def mask_columns(v):
    return sq.mask_columns(_aln(v), max_gap=0.2)


@R.add(f"""
    WITH c AS (SELECT id, substr(seq, 3 * i + 1, 3) AS codon FROM (SELECT *, unnest(range(len(seq) // 3)) AS i FROM {DNA}))
    SELECT codon, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS frequency FROM c GROUP BY codon""")
def codon_usage(v):
    return sq.codon_usage(_dna(v), **LOOSE)


#: Whole texts aren't coding sequences: what isn't a codon is discarded, and neither start nor stop is asked for.
LOOSE = {"policy": "permissive", "require_start": False, "require_terminal_stop": False, "allow_internal_stops": True}
AMINO = ", ".join(f"('{k}', '{a}')" for k, a in sq.CODONS.items() if a != "*")


@R.add(f"""
    WITH c AS (SELECT substr(seq, 3 * i + 1, 3) AS codon FROM (SELECT *, unnest(range(len(seq) // 3)) AS i FROM {DNA})), k AS (SELECT codon, count(*) AS n FROM c GROUP BY codon), a(codon, amino_acid) AS (VALUES {AMINO}), d AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN k USING (codon))
    SELECT codon, amino_acid, n, round(n * count(*) OVER w / nullif(sum(n) OVER w, 0), 6) AS rscu, n * count(*) OVER w / nullif(sum(n) OVER w, 0) < 0.5 AS rare FROM d WINDOW w AS (PARTITION BY amino_acid)""")
def rscu(v):
    return sq.rscu(sq.codon_usage(_dna(v), **LOOSE).select("codon", "n"))


CDS = """
    c AS (SELECT *, list_transform(range(len(seq) // 3), lambda i: substr(seq, 3 * i + 1, 3)) AS every FROM s), k AS (SELECT *, list_filter(every, lambda x: regexp_full_match(x, '[ACGT]{{3}}')) AS good FROM c),
    f AS (SELECT *, coalesce(good[1] IN ('ATG', 'CTG', 'TTG'), false) AS start_ok, coalesce(good[-1] IN ('TAA', 'TAG', 'TGA'), false) AS stop_ok, len(list_filter(range(1, len(good)), lambda i: good[i] IN ('TAA', 'TAG', 'TGA'))) AS n_internal FROM k)"""


@R.add(f"""
    WITH s AS (SELECT id, seq FROM {DNA}), {CDS}
    SELECT id, start_ok, stop_ok, n_internal::INT AS n_internal, CASE WHEN seq = '' THEN 'empty' WHEN len(seq) % 3 > 0 THEN 'length is not divisible by three' WHEN NOT start_ok THEN 'no start codon' WHEN NOT stop_ok THEN 'no stop codon' WHEN n_internal > 0 THEN 'internal stop' END AS refused FROM f""")
def validate_cds(v):
    return sq.validate_cds(_dna(v)).select("id", "start_ok", "stop_ok", F.size("internal_stops").alias("n_internal"), "refused")


@R.add(f"""
    WITH s AS (SELECT id, upper(regexp_replace(text, '[^!-~]', '', 'g')) AS seq FROM {{texts}}), {CDS}
    SELECT id, len(good)::INT AS n_codons, (len(every) - len(good) + (len(seq) % 3 > 0)::INT)::INT AS n_discarded, CASE WHEN seq = '' THEN 'empty' WHEN len(good) = 0 THEN 'no complete codons' WHEN NOT start_ok THEN 'no start codon' END AS refused FROM f""")
def validate_cds_permissive(v):
    d = v.texts.select("id", F.regexp_replace("text", "[^!-~]", "").alias("seq"))
    return sq.validate_cds(d, policy="permissive", require_terminal_stop=False, allow_internal_stops=True).select("id", F.size("codons").alias("n_codons"), F.size("discarded").alias("n_discarded"), "refused")


PAM = f"""(
    WITH s AS (SELECT id, '+' AS strand, seq FROM {DNA} UNION ALL SELECT id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM {DNA}), w AS (SELECT id, strand, len(seq) AS n, i, substr(seq, i + 1, 20) AS guide, substr(seq, i + 21, 3) AS pam FROM (SELECT *, unnest(range(greatest(len(seq) - 22, 0))) AS i FROM s))
    SELECT id, strand, (CASE WHEN strand = '+' THEN i ELSE n - i - 23 END)::BIGINT AS start, n, guide, pam, (20 - len(translate(guide, 'GC', ''))) / 20 AS gc FROM w WHERE pam SIMILAR TO '[ACGT]GG' AND 20 - len(translate(guide, 'GC', '')) BETWEEN 6 AND 14 AND NOT contains(guide, 'TTTT'))"""


@R.add(f"SELECT id, strand, start, guide, pam FROM {PAM}")
def find_pam_sites(v):
    return sq.find_pam_sites(_dna(v)).select("id", "strand", "start", "guide", "pam")


@R.add(f"SELECT id, strand, start, guide FROM {PAM} WHERE start BETWEEN 0.05 * n AND 0.65 * n")
def within_cds(v):
    return sq.within_cds(sq.find_pam_sites(_dna(v))).select("id", "strand", "start", "guide")


@R.add(f"""
    WITH RECURSIVE o AS MATERIALIZED (SELECT id, start, gc, row_number() OVER (PARTITION BY id ORDER BY gc DESC, start) AS o FROM (SELECT id, start, max(gc) AS gc FROM {PAM} GROUP BY id, start)),
         g AS (SELECT DISTINCT id, 0::BIGINT AS o, []::BIGINT[] AS kept FROM o UNION ALL
               SELECT o.id, o.o, CASE WHEN len(kept) < 4 AND len(list_filter(kept, lambda x: abs(x - o.start) < 5)) = 0 THEN list_append(kept, o.start) ELSE kept END FROM g JOIN o ON o.id = g.id AND o.o = g.o + 1)
    SELECT id, unnest(kept) AS start FROM (SELECT id, arg_max(kept, o) AS kept FROM g GROUP BY id)""")
def spaced_top_k(v):
    g = sq.find_pam_sites(_dna(v)).select("id", "start", "strand", "gc")
    return sq.spaced_top_k(g, gene="id", score="gc").select("id", "start")


BITS = "(SELECT id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.08) AS bits FROM {vectors})"


def _bits(v):
    x = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.when(F.get("embedding", i) > 0.08, i))
    return v.vectors.select("id", F.filter(x, lambda e: e.isNotNull()).alias("bits"))


@R.add(f"""
    WITH b AS (SELECT * FROM {BITS}), p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.bits, b.bits)) AS s, len(a.bits) + len(b.bits) AS t FROM b a JOIN b ON a.id < b.id)
    SELECT id_a, id_b, s::INT AS shared, round(s / (t - s), 6) AS similarity FROM p WHERE t > s AND s / (t - s) >= 0.35""")
def similarity_pairs(v):
    return sq.similarity_pairs(_bits(v), threshold=0.35)


@R.add(f"""
    WITH b AS (SELECT * FROM {BITS}), p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.bits, b.bits)) AS s, len(a.bits) + len(b.bits) AS t FROM b a JOIN b ON a.id % 50 = 0), h AS (SELECT id_a, id_b, s, s / (t - s) AS x FROM p WHERE t > s AND s / (t - s) >= 0.5)
    SELECT id_a, id_b, s::INT AS shared, round(x, 6) AS similarity, (row_number() OVER (PARTITION BY id_a ORDER BY x DESC, id_b))::INT AS rank FROM h""")
def tanimoto_search(v):
    b = _bits(v)
    return sq.tanimoto_search(b.where("id % 50 = 0"), b, threshold=0.5)


@R.add()
def butina_clusters(v):
    b = _bits(v)
    p = Scratch(v.spark, "pairs").saved(sq.similarity_pairs(b, threshold=0.35), "pairs", stays=True)  # read several times
    return sq.butina_clusters(p, b, components(p, b))


@R.add("SELECT brand AS compound, count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd, round(max(price) - min(price), 6) AS \"range\", max(price) - min(price) > 95 AS disagree FROM {parts} GROUP BY brand")
def dedupe_replicates(v):
    return sq.dedupe_replicates(v.parts.withColumnRenamed("brand", "compound"), value="price", most_range=95.0)


@R.add("SELECT size AS scaffold, count(*) AS n FROM {parts} GROUP BY size HAVING count(*) >= 3")
def series_detect(v):
    return sq.series_detect(v.parts.withColumnRenamed("size", "scaffold"))


DEALT = """
    WITH RECURSIVE g AS (SELECT size AS scaffold, count(*) AS n FROM {parts} GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, floor(sum(n) * (1 - 0.2))::BIGINT AS a FROM g), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, scaffold) AS o FROM g),
         d AS (SELECT 0::BIGINT AS o, 0::BIGINT AS train, 0::BIGINT AS test, false AS up, 0::BIGINT AS n UNION ALL
               SELECT o.o, train + CASE WHEN up_ THEN o.n ELSE 0 END, test + CASE WHEN up_ THEN 0 ELSE o.n END, up_, o.n FROM (SELECT d.train, d.test, x.*, d.train * (t.total - t.a) <= d.test * t.a AS up_ FROM d JOIN o x ON x.o = d.o + 1 CROSS JOIN t) o),
         k AS (SELECT n, count(*) FILTER (up) AS k FROM d WHERE o > 0 GROUP BY n), h AS (SELECT (SELECT max(train) FROM d) AS have, (SELECT count(*) FROM g WHERE n = 1) AS ones),
         m AS (SELECT k.n, CASE WHEN k.n > 1 THEN k WHEN have < a THEN k + least(a - have, ones - k) WHEN have > a THEN k - least(have - a, k) ELSE k END AS k FROM k CROSS JOIN h CROSS JOIN t),
         s AS (SELECT g.scaffold, g.n, CASE WHEN row_number() OVER (PARTITION BY g.n ORDER BY md5('42:' || g.scaffold), g.scaffold) <= m.k THEN 'train' ELSE 'test' END AS split FROM g JOIN m ON m.n = g.n)"""


@R.add(DEALT + " SELECT p.id, p.size AS scaffold, split FROM {parts} p JOIN s ON s.scaffold = p.size")
def group_aware_split(v):
    return sl.group_aware_split(v.parts.select("id", F.col("size").alias("scaffold")))


@R.add(DEALT + """ SELECT sum(n)::BIGINT AS rows, round(sum(CASE WHEN split = 'train' THEN n END) / sum(n), 6) AS train_share, 0::BIGINT AS shared_groups, round(sum(CASE WHEN split = 'train' AND n = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN split = 'train' THEN n END), 6) AS train_single_share,
    round(sum(CASE WHEN split = 'test' AND n = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN split = 'test' THEN n END), 6) AS test_single_share FROM s""")
def split_diagnostics(v):
    return sl.split_diagnostics(sl.group_aware_split(v.parts.select("id", F.col("size").alias("scaffold"))))


@R.add()
def knn_label_transfer(v):
    return sq.knn_label_transfer(v.vectors.where("id % 5 <> 0"), v.vectors.where("id % 5 = 0"))


@R.add("""
    WITH l AS (SELECT partkey AS sequence, suppkey AS design, max(price) AS score FROM {lines} GROUP BY ALL)
    SELECT sequence, design, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY score DESC, design) AS rank FROM l WHERE score > 50000) WHERE rank <= 2""")
def top_designs(v):
    x = v.lines.groupBy(F.col("partkey").alias("sequence"), F.col("suppkey").alias("design")).agg(F.max("price").alias("score"))
    return mx.top_designs(x, cut=50000, n=2).select("sequence", "design", "rank")


