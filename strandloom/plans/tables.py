"""Registered queries: variants, genotypes, reads, intervals, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators import reads as rd
from strandloom.operators import variants as va
from strandloom.plans.core import Registry

R = Registry()
SPLIT = "(SELECT chrom, pos, ref, unnest(string_split(alt, ',')) AS alt, qual, filter, size, tenth FROM {variants})"


@R.add(f"""
    WITH v AS (SELECT * FROM {SPLIT} WHERE ref <> alt),
         k AS (SELECT chrom, pos, ref, alt, bool_or(tenth < 7) AS a, bool_or(tenth >= 3) AS b FROM v GROUP BY ALL)
    SELECT CASE WHEN a AND b THEN 'A+B' WHEN a THEN 'A' ELSE 'B' END AS members, a::INT + b::INT AS n_sets, count(*) AS n FROM k GROUP BY ALL""")
def compare_callsets(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt")
    return va.compare_callsets({"A": x.where("tenth < 7"), "B": x.where("tenth >= 3")})


@R.add(f"SELECT chrom, pos, ref, alt FROM {SPLIT}")
def split_multiallelic(v):
    return va.split_multiallelic(v.variants).select("chrom", "pos", "ref", "alt")


@R.add("""
    WITH x AS (SELECT *, list_distinct(list_transform(string_split(alt, ','), lambda a: CASE WHEN len(ref) = 1 AND len(a) = 1 THEN 'snp' WHEN len(ref) = len(a) THEN 'mnp' ELSE 'indel' END)) AS k FROM {variants})
    SELECT CASE WHEN len(k) = 1 THEN k[1] ELSE 'other' END AS class, contains(alt, ',') AS multi_alt, count(*) AS n FROM x GROUP BY ALL""")
def classify_variant(v):
    return va.classify_variant(v.variants).groupBy("class", "multi_alt").agg(F.count(F.lit(1)).alias("n"))


@R.add("""
    WITH v AS (SELECT * REPLACE (CASE WHEN pos % 13 = 0 THEN alt || ',TTG' ELSE alt END AS alt) FROM {variants}), x AS (SELECT *, string_split(alt, ',') AS a FROM v),
         k AS (SELECT *, len(ref) = 1 AND len(list_filter(a, lambda z: len(z) <> 1)) = 0 AS snp FROM x)
    SELECT count(*) AS records, count(*) FILTER (snp) AS snps, count(*) FILTER (NOT snp) AS indels, 0::BIGINT AS other, count(*) FILTER (filter IN ('PASS', '.')) AS passed, count(*) FILTER (filter NOT IN ('PASS', '.')) AS filtered,
           sum(CASE WHEN snp THEN len(list_filter(a, lambda z: ref || z IN ('AG', 'GA', 'CT', 'TC'))) ELSE 0 END)::BIGINT AS ti, sum(CASE WHEN snp THEN len(list_filter(a, lambda z: ref || z NOT IN ('AG', 'GA', 'CT', 'TC'))) ELSE 0 END)::BIGINT AS tv, round(avg(qual), 6) AS mean_qual FROM k""")
def vcf_stats(v):
    return va.vcf_stats(v.variants.withColumn("alt", F.when(F.col("pos") % 13 == 0, F.concat("alt", F.lit(",TTG"))).otherwise(F.col("alt"))))


@R.add(f"""
    SELECT chrom, pos, ref, alt, least(len(ref), len(alt)) > 1 AND (ref[-1] = alt[-1] OR ref[1] = alt[1]) AS needs_normalizing FROM (SELECT chrom, pos, ref || CASE WHEN pos % 2 = 0 THEN 'T' ELSE '' END AS ref, alt FROM {SPLIT})""")
def needs_normalizing(v):
    x = va.split_multiallelic(v.variants).withColumn("ref", F.concat("ref", F.when(F.col("pos") % 2 == 0, "T").otherwise("")))
    return va.needs_normalizing(x).select("chrom", "pos", "ref", "alt", "needs_normalizing")


@R.add(f"""
    SELECT chrom, pos, ref, alt, qual FROM {SPLIT} WHERE ref <> alt AND CASE WHEN len(ref) = 1 AND len(alt) = 1 THEN qual IS NULL OR qual >= 950 ELSE qual IS NULL OR qual >= 1000 END""")
def hard_filter_variants(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt")
    return va.hard_filter_variants(x, snp={"qual": (">=", 950)}, indel={"qual": (">=", 1000)}).select("chrom", "pos", "ref", "alt", "qual")


@R.add("""SELECT pos, CASE WHEN size = 6 AND pos * 20000 BETWEEN 25000000 AND 34000000 THEN 'MHC' WHEN size = 8 AND pos * 20000 BETWEEN 7000000 AND 13000000 THEN 'chr8_inversion' END AS excluded FROM {variants}""")
def flag_excluded_region(v):
    x = v.variants.select("pos", F.concat(F.lit("chr"), F.col("size").cast("string")).alias("chrom"), (F.col("pos") * 20000).alias("at"))
    return va.flag_excluded_region(x, pos="at").select("pos", "excluded")


@R.add(f"""
    WITH v AS (SELECT * FROM {SPLIT} WHERE ref <> alt), k AS (SELECT DISTINCT chrom, pos, ref, alt, size / 50.0 AS af FROM v WHERE tenth >= 3 AND size % 3 <> 0)
    SELECT v.chrom, v.pos, v.ref, v.alt, round(k.af, 6) AS ref_af FROM v LEFT JOIN k USING (chrom, pos, ref, alt)""")
def annotate_by_key(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt")
    k = x.where("tenth >= 3 and size % 3 <> 0").select(*va.KEY, (F.col("size") / 50.0).alias("af")).distinct()
    return va.annotate_by_key(x, k, columns=["af"]).select(*va.KEY, "ref_af")


@R.add(f"""
    WITH v AS (SELECT * FROM {SPLIT} WHERE ref <> alt), k AS (SELECT DISTINCT chrom, pos, ref, alt, CASE WHEN size % 4 = 0 THEN NULL ELSE size / 50.0 END AS af FROM v WHERE tenth >= 3)
    SELECT v.chrom, v.pos, v.ref, v.alt FROM v LEFT JOIN k USING (chrom, pos, ref, alt) WHERE k.af IS NULL OR k.af < 0.5""")
def rare_variant_filter(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt")
    k = x.where("tenth >= 3").select(*va.KEY, F.when(F.col("size") % 4 != 0, F.col("size") / 50.0).alias("af")).distinct()
    return va.rare_variant_filter(x, k, below=0.5).select(*va.KEY)


@R.add(f"""
    WITH v AS (SELECT * FROM {SPLIT} WHERE ref <> alt), j AS (SELECT v.*, NOT EXISTS (SELECT 1 FROM v k WHERE k.tenth >= 3 AND k.chrom = v.chrom AND k.pos = v.pos AND k.ref = v.ref AND k.alt = v.alt) AS novel FROM v)
    SELECT filter, count(*) AS n, round(avg(novel::INT), 6) AS novel, round(count(*) FILTER (novel AND len(ref) = 1 AND len(alt) = 1 AND ref || alt IN ('AG', 'GA', 'CT', 'TC')) / nullif(count(*) FILTER (novel AND len(ref) = 1 AND len(alt) = 1 AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')), 0), 6) AS titv_novel FROM j GROUP BY filter""")
def novel_fraction(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt")
    return va.novel_fraction(x, x.where("tenth >= 3"), stratum="filter")


@R.add(f"""SELECT DISTINCT chrom, pos, ref, alt FROM {SPLIT} WHERE tenth < 7 OR tenth >= 3""")
def concat_dedup(v):
    x = va.split_multiallelic(v.variants)
    return va.concat_dedup([x.where("tenth < 7"), x.where("tenth >= 3")]).select(*va.KEY)


@R.add(f"""
    WITH v AS (SELECT * FROM {SPLIT})
    SELECT chrom, pos, min(ref || '>' || alt) FILTER (tenth % 3 = 0) AS s0, min(ref || '>' || alt) FILTER (tenth % 3 = 1) AS s1, min(ref || '>' || alt) FILTER (tenth % 3 = 2) AS s2 FROM v GROUP BY chrom, pos""")
def merge_callsets(v):
    x = va.split_multiallelic(v.variants).select("chrom", "pos", F.concat(F.lit("s"), (F.col("tenth") % 3).cast("string")).alias("sample"), F.concat_ws(">", "ref", "alt").alias("gt"))
    return va.merge_callsets(x, key=["chrom", "pos"], samples=["s0", "s1", "s2"])


@R.add("""
    SELECT sample, count(*) FILTER (gt = '0/1') AS het, count(*) FILTER (gt = '1/1') AS hom_alt, round(count(*) FILTER (gt <> './.') / count(*), 6) AS call_rate,
           round(avg(CASE WHEN gt = '0/1' AND ref_depth + alt_depth > 0 THEN alt_depth / (ref_depth + alt_depth) END), 6) AS mean_het_ab, round(count(*) FILTER (gt = '0/1') / nullif(count(*) FILTER (gt = '1/1'), 0), 6) AS het_hom_ratio FROM {calls} GROUP BY sample""")
def sample_qc(v):
    return va.sample_qc(v.calls)


@R.add("""
    WITH g AS (SELECT site, count(*) FILTER (gt <> './.') / count(*) AS call_rate, count(*) FILTER (gt = '0/0') AS hom_ref, count(*) FILTER (gt = '0/1') AS het, count(*) FILTER (gt = '1/1') AS hom_alt FROM {calls} GROUP BY site),
         x AS (SELECT *, hom_ref + het + hom_alt AS n, 2 * least(hom_ref, hom_alt) + het AS rare FROM g),
         h AS (SELECT site, het, unnest(range(rare % 2, rare + 1, 2)) AS k, n, rare FROM x),
         l AS (SELECT site, het, k, lgamma(n + 1) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1) + k * ln(2) AS v FROM h),
         m AS (SELECT site, max(v) AS top FROM l GROUP BY site),
         p AS (SELECT l.site, sum(exp(v - top)) FILTER (k >= het) / sum(exp(v - top)) AS p FROM l JOIN m USING (site) GROUP BY l.site)
    SELECT g.site, round(call_rate, 6) AS call_rate, hom_ref, het, hom_alt, round(coalesce(p.p, 1.0), 6) AS excess_het_p FROM g LEFT JOIN p USING (site)""")
def site_qc(v):
    return va.site_qc(v.calls)


@R.add("""
    WITH c AS (SELECT site, sample, CASE WHEN gq >= 10 AND ref_depth + alt_depth >= 18 THEN gt ELSE './.' END AS gt FROM {calls}),
         s1 AS (SELECT sample FROM c GROUP BY sample HAVING avg((gt <> './.')::INT) >= 0.5), c1 AS (SELECT * FROM c SEMI JOIN s1 USING (sample)),
         t1 AS (SELECT site FROM c1 GROUP BY site HAVING avg((gt <> './.')::INT) >= 0.6), c2 AS (SELECT * FROM c1 SEMI JOIN t1 USING (site)),
         s2 AS (SELECT sample FROM c2 GROUP BY sample HAVING avg((gt <> './.')::INT) >= 0.5), c3 AS (SELECT * FROM c2 SEMI JOIN s2 USING (sample)),
         t2 AS (SELECT site FROM c3 GROUP BY site HAVING avg((gt <> './.')::INT) >= 0.6), c4 AS (SELECT * FROM c3 SEMI JOIN t2 USING (site)),
         s3 AS (SELECT sample FROM c4 GROUP BY sample HAVING avg((gt <> './.')::INT) >= 0.5), c5 AS (SELECT * FROM c4 SEMI JOIN s3 USING (sample)),
         t3 AS (SELECT site FROM c5 GROUP BY site HAVING avg((gt <> './.')::INT) >= 0.6)
    SELECT site, sample, gt FROM c5 SEMI JOIN t3 USING (site)""")
def iterative_missingness(v):
    return va.iterative_missingness(v.calls, min_gq=10, min_depth=18, depth=F.col("ref_depth") + F.col("alt_depth"), sample_rate=0.5, site_rate=0.6).select("site", "sample", "gt")


@R.add("""
    WITH a AS (SELECT site, sample, gt FROM {calls} WHERE sample < 30 AND gt <> './.'), b AS (SELECT site, sample, gt FROM {calls} WHERE sample >= 30 AND gt <> './.')
    SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS sites, round(avg((a.gt <> b.gt)::INT), 6) AS discordance FROM a JOIN b USING (site) GROUP BY ALL""")
def genotype_discordance(v):
    return va.genotype_discordance(v.calls.where("sample < 30"), v.calls.where("sample >= 30"))


@R.add("""
    WITH c AS (SELECT site, CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END AS a, CASE WHEN gt = './.' THEN 0 ELSE 2 END AS n FROM {calls})
    SELECT site, sum(a)::BIGINT AS ac, sum(n)::BIGINT AS an, round(sum(a) / nullif(sum(n), 0), 6) AS af FROM c GROUP BY site""")
def recompute_ac_an(v):
    return va.recompute_ac_an(v.calls)


@R.add("""
    WITH x AS (SELECT id, CASE WHEN size % 3 = 0 THEN NULL ELSE (size - 1) / 500.0 END AS e, CASE WHEN size % 5 = 0 THEN NULL ELSE (size - 1) / 600.0 END AS g FROM {parts}), y AS (SELECT id, coalesce(e, g) AS f FROM x)
    SELECT id, CASE WHEN f > 0.05 THEN 'BA1' WHEN f > 0.02 THEN 'BS1' WHEN f IS NULL OR f = 0 THEN 'PM2' END AS code FROM y""")
def frequency_code(v):
    x = v.parts.select("id", F.when(F.col("size") % 3 != 0, (F.col("size") - 1) / 500.0).alias("faf_exome"), F.when(F.col("size") % 5 != 0, (F.col("size") - 1) / 600.0).alias("faf_genome"))
    return va.frequency_code(x, prevalence=0.04).select("id", "code")


@R.add("""SELECT id, CASE WHEN size <= 10 THEN 'low' WHEN size > 10 AND size < 30 THEN 'mid' WHEN size >= 30 THEN 'high' END AS label FROM {parts}""")
def interval_label(v):
    return va.interval_label(v.parts, [(None, False, 10, True, "low"), (10, False, 30, False, "mid"), (30, True, None, False, "high")], value="size").select("id", "label")


@R.add("""
    WITH x AS (SELECT id, CASE WHEN size % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN size % 5 = 0 AND size % 3 <> 0 THEN 4 ELSE 0 END + CASE WHEN size % 7 = 0 THEN -2 ELSE 0 END + CASE WHEN size % 11 = 0 THEN -100 ELSE 0 END + CASE WHEN size % 4 = 0 THEN 8 ELSE 0 END AS p, size % 11 = 0 AS ba,
               CASE WHEN size % 13 = 0 THEN 'retired criterion' WHEN size % 17 = 0 THEN 'unknown criterion' WHEN size % 19 = 0 THEN 'repeated criterion' WHEN size % 23 = 0 THEN 'several of one family' WHEN size % 5 = 0 AND size % 7 = 0 THEN 'conflicting family' END AS problem FROM {parts})
    SELECT id, CASE WHEN problem IS NULL THEN p END AS points, problem, CASE WHEN problem IS NOT NULL THEN NULL WHEN ba THEN 'Benign' WHEN p >= 10 THEN 'Pathogenic' WHEN p >= 6 THEN 'Likely Pathogenic' WHEN p >= 0 THEN 'VUS' WHEN p >= -6 THEN 'Likely Benign' ELSE 'Benign' END AS class FROM x""")
def evidence_points(v):
    c = F.filter(F.array(*[F.when(F.col("size") % k == 0, name) for k, name in ((3, "PVS1_Strong"), (2, "PM2"), (5, "PP3_Strong"), (7, "BP4_Moderate"), (11, "BA1"), (4, "PM3_VeryStrong"), (13, "PP5"), (17, "XX1"), (19, "PS1"), (19, "PS1"), (23, "PP1"), (23, "PP1_Strong"))]), lambda x: x.isNotNull())
    return va.evidence_points(v.parts.withColumn("criteria", c)).select("id", "points", "problem", "class")


@R.add("""
    WITH per AS (SELECT gene, sample, array_to_string(list_sort(list_distinct(list(class))), ';') AS classes FROM {mutations} GROUP BY gene, sample),
         g AS (SELECT gene, row_number() OVER (ORDER BY count(*) DESC, gene) AS gene_rank FROM per GROUP BY gene ORDER BY 2 LIMIT 20),
         c AS (SELECT DISTINCT sample FROM {suppliers})
    SELECT g.gene, c.sample, g.gene_rank::INT AS gene_rank, coalesce(per.classes, '') AS classes FROM g CROSS JOIN c LEFT JOIN per USING (gene, sample)""")
def gene_by_sample_matrix(v):
    return va.gene_by_sample_matrix(v.mutations, v.suppliers)


@R.add("""
    WITH j AS (SELECT s.sample, count(m.gene) AS burden FROM (SELECT DISTINCT sample FROM {suppliers}) s LEFT JOIN {mutations} m USING (sample) GROUP BY s.sample)
    SELECT sample, burden, (row_number() OVER (ORDER BY burden DESC, sample))::INT AS rank FROM j""")
def mutation_burden(v):
    return va.mutation_burden(v.mutations, v.suppliers)


@R.add("""
    WITH y AS (SELECT sample, balance / 1000 AS y FROM {suppliers}), n AS (SELECT count(y) AS n, avg(y) AS m, var_pop(y) AS v FROM y),
         d AS (SELECT partkey % 50 AS gene, suppkey AS sample, sum(25 * pow(1 - discount / 10, 24) * 1) AS b FROM {lines} WHERE discount / 10 <= 0.005 GROUP BY ALL),
         g AS (SELECT gene, count(*) AS carriers, sum(b * (y - m)) AS score, sum(b) AS s1, sum(b * b) AS s2, any_value(n) AS n, any_value(v) AS v FROM d JOIN y USING (sample) CROSS JOIN n GROUP BY gene)
    SELECT gene, carriers, round(score, 4) AS score, round(v * (s2 - s1 * s1 / n), 2) AS var, round(CASE WHEN v * (s2 - s1 * s1 / n) > 0 THEN score / sqrt(v * (s2 - s1 * s1 / n)) END, 6) AS z FROM g""")
def gene_burden(v):
    c = v.lines.select((F.col("partkey") * 100 + F.col("line")).alias("variant"), F.col("suppkey").alias("sample"), F.lit(1).alias("dosage"), (F.col("discount") / 10).alias("af"), (F.col("partkey") % 50).alias("gene"))
    y = v.suppliers.select("sample", (F.col("balance") / 1000).alias("y"))
    genes = c.select("variant", "gene").distinct()
    out = va.gene_burden(c.drop("gene"), genes, y, max_af=0.005)
    return out.select("gene", "carriers", F.round("score", 4).alias("score"), F.round("var", 2).alias("var"), "z")


@R.add(f"""
    WITH v AS (SELECT DISTINCT chrom, pos, ref, alt FROM {SPLIT} WHERE ref <> alt), s AS (SELECT *, qual / 1000 AS sc FROM {SPLIT} WHERE ref <> alt),
         a AS (SELECT chrom, pos, ref, alt, max(sc) AS a FROM s WHERE tenth < 7 GROUP BY ALL), c AS (SELECT chrom, pos, ref, alt, max(sc * 0.9) AS c FROM s WHERE tenth >= 2 GROUP BY ALL), b AS (SELECT chrom, pos, ref, alt, arg_max(1 - sc, abs(1 - sc)) AS b FROM s WHERE tenth >= 3 GROUP BY ALL),
         j AS (SELECT v.*, a.a, b.b, (a.a IS NOT NULL)::INT + (b.b IS NOT NULL)::INT + (c.c IS NOT NULL)::INT AS n_scored, coalesce((a.a >= 0.95)::INT, 0) + coalesce((abs(b.b) >= 0.02)::INT, 0) + coalesce((c.c >= 0.85)::INT, 0) AS n_above FROM v LEFT JOIN a USING (chrom, pos, ref, alt) LEFT JOIN b USING (chrom, pos, ref, alt) LEFT JOIN c USING (chrom, pos, ref, alt))
    SELECT class, n_scored, n_above, count(*) AS n FROM (SELECT *, CASE WHEN n_scored < 2 THEN 'insufficient_tools' WHEN n_above = 0 THEN 'none_predict_disruption' WHEN n_above = n_scored THEN 'all_predict_disruption' WHEN n_above * 2 > n_scored THEN 'majority_predict_disruption' ELSE 'discordant' END AS class FROM j) GROUP BY ALL""")
def score_concordance(v):
    x = va.split_multiallelic(v.variants).where("ref <> alt").withColumn("score", F.col("qual") / 1000)
    y = x.withColumn("score", 1 - F.col("score"))
    out = va.score_concordance(x, {"a": (x.where("tenth < 7"), 0.95, False), "b": (y.where("tenth >= 3"), 0.02, True), "c": (x.where("tenth >= 2").withColumn("score", F.col("score") * 0.9), 0.85, False)})
    return out.groupBy("class", "n_scored", "n_above").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""SELECT chrom, pos, ref, alt FROM {SPLIT} v WHERE tenth < 3""")
def unscored_report(v):
    x = va.split_multiallelic(v.variants)
    return va.unscored_report(x, x.where("tenth >= 3")).select(*va.KEY)


@R.add(f"""SELECT chrom, pos, ref, alt FROM {SPLIT}""")
def coordinate_sort(v):
    return va.coordinate_sort(va.split_multiallelic(v.variants), contigs=["chr0", "chr1", "chr2", "chr3", "chr4"]).select(*va.KEY)


@R.add(f"""
    WITH v AS (SELECT pos, ref, alt FROM {SPLIT}), m AS (SELECT pos, 'ACGT' AS ref, substr('ACGT', (pos % 4)::INT + 1, 1) || 'CTT' AS alt FROM v)
    SELECT pos + i AS pos, substr(ref, i + 1, 1) AS ref, substr(alt, i + 1, 1) AS alt FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM m) WHERE substr(ref, i + 1, 1) <> substr(alt, i + 1, 1)""")
def atomize_mnp(v):
    x = va.split_multiallelic(v.variants).select("pos", F.lit("ACGT").alias("ref"), F.concat(F.substr(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)), F.lit("CTT")).alias("alt"))
    return va.atomize_mnp(x)


PRIMARY = "(flag & 256) = 0 AND (flag & 2048) = 0"


@R.add(f"SELECT qname, line, contig, start, stop FROM {{reads}} WHERE {PRIMARY} AND (flag & 4) = 0 AND mapq >= 20 AND (flag & 1024) = 0 AND (flag & 2) > 0 AND contig = 'c1' AND start < 50000 AND stop > 10000")
def filter_reads(v):
    return rd.filter_reads(v.reads, region="c1:10,001-50,000").select("qname", "line", "contig", "start", "stop")


@R.add("SELECT id, contig, start, stop FROM {intervals}")
def parse_region(v):
    x = v.intervals.select("id", F.concat(F.col("contig"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("stop").cast("string")).alias("region"))
    return rd.parse_region(x).select("id", "contig", "start", "stop")


@R.add("SELECT qname, line FROM {reads} WHERE ('0x' || substr(sha256('7:' || qname), 1, 8))::BIGINT / 4294967296.0 < 0.1")
def hash_subsample(v):
    return rd.hash_subsample(v.reads, key="qname", fraction=0.1, seed=7).select("qname", "line")


@R.add(f"""
    SELECT count(*) AS records, count(*) FILTER ((flag & 256) > 0) AS secondary, count(*) FILTER ((flag & 2048) > 0) AS supplementary, count(*) FILTER ({PRIMARY}) AS "primary", count(*) FILTER ({PRIMARY} AND (flag & 512) > 0) AS qc_fail,
           count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 4) = 0) AS mapped, count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 1) > 0) AS paired, count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 2) > 0) AS proper, count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 1024) > 0) AS duplicate,
           round(count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 1024) > 0) / count(*) FILTER ({PRIMARY} AND (flag & 512) = 0 AND (flag & 4) = 0), 6) AS duplicate_rate FROM (SELECT * REPLACE (flag + CASE WHEN line = 4 THEN 512 ELSE 0 END AS flag) FROM {{reads}})""")
def flagstat(v):
    return rd.flagstat(v.reads.withColumn("flag", F.col("flag") + F.when(F.col("line") == 4, 512).otherwise(0)))


@R.add("""SELECT count(*) AS n, round(avg(tlen), 6) AS mean, round(stddev_pop(tlen), 6) AS sd, quantile_cont(tlen, 0.5) AS median, CASE WHEN quantile_cont(tlen, 0.5) BETWEEN 150 AND 600 THEN 'good' WHEN quantile_cont(tlen, 0.5) BETWEEN 100 AND 1000 THEN 'borderline' ELSE 'bad' END AS grade FROM {reads} WHERE tlen > 0 AND (flag & 256) = 0 AND (flag & 2048) = 0 AND (flag & 4) = 0 AND (flag & 1) > 0 AND (flag & 2) > 0""")
def insert_stats(v):
    return rd.insert_stats(v.reads)


USED = f"((flag & 4) = 0 AND (flag & 2) > 0 AND {PRIMARY} AND (flag & 1024) = 0 AND (flag & 512) = 0 AND tlen BETWEEN 1 AND 600)"


@R.add(f"""
    WITH m AS (SELECT tlen AS mode FROM {{reads}} WHERE {USED} GROUP BY tlen ORDER BY count(*) DESC, tlen LIMIT 1)
    SELECT count(*) FILTER ({USED}) AS n, quantile_cont(tlen, 0.5) FILTER ({USED}) AS median, round(count(*) FILTER ({USED} AND tlen BETWEEN 90 AND 150) / count(*) FILTER ({USED}), 6) AS short_share, round(count(*) FILTER ({USED} AND tlen > 250) / count(*) FILTER ({USED}), 6) AS long_share,
           count(*) AS input_records, count(*) FILTER ((flag & 4) > 0) AS unmapped, count(*) FILTER ((flag & 2) = 0) AS not_proper_pair, count(*) FILTER ((flag & 256) > 0) AS secondary, count(*) FILTER ((flag & 2048) > 0) AS supplementary, count(*) FILTER ((flag & 1024) > 0) AS duplicate, count(*) FILTER ((flag & 512) > 0) AS qc_fail, count(*) FILTER (tlen <= 0) AS nonpositive_length, count(*) FILTER (tlen > 600) AS over_max_size, any_value(m.mode)::BIGINT AS mode FROM {{reads}} CROSS JOIN m""")
def fragment_size_qc(v):
    return rd.fragment_size_qc(v.reads)


PAIRS = "(SELECT *, start + tlen % 90 - 40 AS mate_start FROM {reads})"


def _pairs(v):
    return v.reads.withColumn("mate_start", F.col("start") + F.col("tlen") % 90 - 40)


COMPLEXITY = """
    c AS (SELECT k, count(*) AS n FROM u GROUP BY k), g AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS distinct_, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two FROM c)
    SELECT mode, total, distinct_ AS distinct, round(distinct_ / nullif(total, 0), 6) AS nrf, round(one / nullif(distinct_, 0), 6) AS pbc1, round(one / nullif(two, 0), 6) AS pbc2,
           (SELECT count(*) FROM p WHERE contig = 'c4') AS excluded_contig, (SELECT count(*) FROM p WHERE contig <> 'c4' AND mapq < 10) AS below_mapq, (SELECT count(*) FROM u WHERE (flag & 1024) > 0) AS flagged_duplicates, NULL::VARCHAR AS warning FROM g"""


@R.add(f"""
    WITH p AS (SELECT * FROM {PAIRS} WHERE {PRIMARY} AND (flag & 4) = 0), u AS (SELECT *, (contig, least(start, mate_start), least(start, mate_start) + tlen) AS k FROM p WHERE contig <> 'c4' AND mapq >= 10 AND (flag & 64) > 0 AND (flag & 2) > 0 AND tlen <> 0),
    {COMPLEXITY.replace('mode,', "'paired' AS mode,")}""")
def library_complexity(v):
    return rd.library_complexity(_pairs(v), min_mapq=10, exclude=("c4",))


@R.add(f"""
    WITH p AS (SELECT * FROM {PAIRS} WHERE {PRIMARY} AND (flag & 4) = 0), u AS (SELECT *, (contig, CASE WHEN (flag & 16) > 0 THEN stop ELSE start END, (flag & 16) > 0) AS k FROM p WHERE contig <> 'c4' AND mapq >= 10),
    {COMPLEXITY.replace('mode,', "'single' AS mode,")}""")
def library_complexity_single(v):
    return rd.library_complexity(_pairs(v), mode="single", min_mapq=10, exclude=("c4",))


EVENTS = """
    e AS (SELECT contig, start AS p, 1 AS d FROM {reads} UNION ALL SELECT contig, stop, -1 FROM {reads}), g AS (SELECT contig, p, sum(d) AS d FROM e GROUP BY ALL),
    c AS (SELECT contig, p AS start, lead(p) OVER w AS stop, sum(d) OVER w AS depth FROM g WINDOW w AS (PARTITION BY contig ORDER BY p))"""


@R.add(f"""WITH {EVENTS} SELECT contig, sum(stop - start)::BIGINT AS covered, sum((stop - start) * depth)::BIGINT AS bases, max(depth)::BIGINT AS deepest FROM c WHERE depth > 0 AND stop IS NOT NULL GROUP BY contig""")
def depth(v):
    return rd.depth(v.reads).groupBy("contig").agg(F.count(F.lit(1)).alias("covered"), F.sum("depth").alias("bases"), F.max("depth").alias("deepest"))


@R.add(f"""
    WITH {EVENTS}, r AS (SELECT * FROM c WHERE depth > 0 AND stop IS NOT NULL), k AS (SELECT contig, count(*) AS reads FROM {{reads}} GROUP BY contig),
    s AS (SELECT contig, sum(stop - start) AS covered, sum((stop - start) * depth) AS bases, sum(CASE WHEN depth >= 1 THEN stop - start ELSE 0 END) AS a1, sum(CASE WHEN depth >= 10 THEN stop - start ELSE 0 END) AS a10, sum(CASE WHEN depth >= 20 THEN stop - start ELSE 0 END) AS a20 FROM r GROUP BY contig)
    SELECT contig, reads, covered::BIGINT AS covered, round(100 * covered / 200000, 6) AS percent, round(bases / 200000, 6) AS mean_depth, round(a1 / 200000, 6) AS breadth_1, round(a10 / 200000, 6) AS breadth_10, round(a20 / 200000, 6) AS breadth_20 FROM k JOIN s USING (contig)""")
def coverage_summary(v):
    contigs = v.reads.select("contig").distinct().withColumn("length", F.lit(200_000).cast("long"))
    return rd.coverage_summary(v.reads, contigs)


@R.add(f"""
    WITH g AS (SELECT contig, count(*) AS mapped FROM {{reads}} WHERE (flag & 4) = 0 AND {PRIMARY} GROUP BY contig), t AS (SELECT sum(mapped) AS t, sum(mapped) FILTER (contig = 'c0') AS m, sum(mapped) FILTER (contig = 'c1') AS x, sum(mapped) FILTER (contig = 'c2') AS y FROM g)
    SELECT contig, mapped, round(m / t, 6) AS mito_share, round(x / (y + 1), 6) AS x_to_y FROM g CROSS JOIN t""")
def contig_counts(v):
    return rd.contig_counts(v.reads, mito="c0", x="c1", y="c2")


@R.add(f"""SELECT count(*) AS n, round(avg((tlen % 3 = 0)::INT), 6) AS plus_share FROM {{reads}} WHERE {PRIMARY} AND (flag & 4) = 0 AND tlen % 5 <> 0""")
def orientation_share(v):
    return rd.orientation_share(v.reads.withColumn("ts", F.when(F.col("tlen") % 5 == 0, None).when(F.col("tlen") % 3 == 0, "+").otherwise("-")))


@R.add("""
    WITH s AS (SELECT *, 1 + least(19, (('0x' || substr(sha256('0:' || qname), 1, 8))::BIGINT / 4294967296.0 * 20)::DOUBLE) AS u FROM (SELECT qname, contig || ':' || (start // 500) AS junction, start // 500 % 3 = 0 AS known FROM {reads})),
         f AS (SELECT junction, known, min(floor(u)::INT) AS step FROM s GROUP BY ALL), g AS (SELECT step, count(*) AS n, count(*) FILTER (known) AS k FROM f GROUP BY step),
         c AS (SELECT t.i AS step, sum(coalesce(n, 0)) OVER (ORDER BY t.i) AS a, sum(coalesce(k, 0)) OVER (ORDER BY t.i) AS k FROM (SELECT unnest(range(1, 21)) AS i) t LEFT JOIN g ON g.step = t.i)
    SELECT round(step / 20, 6) AS share, a::BIGINT AS all_junctions, k::BIGINT AS known_junctions,
           CASE WHEN (max(CASE WHEN step = 20 THEN a END) OVER () - max(CASE WHEN step = 16 THEN a END) OVER ()) / nullif(max(CASE WHEN step = 16 THEN a END) OVER (), 0) < 0.02 THEN 'plateau' ELSE 'rising' END AS verdict FROM c""")
def junction_saturation(v):
    j = F.floor(F.col("start") / 500)
    return rd.junction_saturation(v.reads.select("qname", F.concat_ws(":", "contig", j.cast("string")).alias("junction"), (j % 3 == 0).alias("known")))


@R.add("""
    SELECT a.id AS a_id, b.qname AS b_qname, b.line AS b_line FROM {intervals} a JOIN {reads} b ON a.contig = b.contig AND a.start < b.stop AND b.start < a.stop WHERE a.start < a.stop""")
def interval_join(v):
    return iv.interval_join(v.intervals, v.reads).select("a_id", "b_qname", "b_line")


@R.add("""SELECT qname, line FROM {reads} r WHERE EXISTS (SELECT 1 FROM {intervals} i WHERE i.contig = r.contig AND i.start < r.stop AND r.start < i.stop)""")
def interval_semi(v):
    return iv.interval_semi(v.reads, v.intervals).select("qname", "line")


@R.add("""SELECT qname, line FROM {reads} r WHERE NOT EXISTS (SELECT 1 FROM {intervals} i WHERE i.contig = r.contig AND i.start < r.stop AND r.start < i.stop)""")
def interval_anti(v):
    return iv.interval_anti(v.reads, v.intervals).select("qname", "line")


@R.add("""
    WITH x AS (SELECT contig, start, stop, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {intervals}),
         y AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT contig, min(start) AS start, max(stop) AS stop, count(*) AS n FROM y GROUP BY contig, g""")
def merge_intervals(v):
    return iv.merge_intervals(v.intervals, tile=4096)


@R.add("""
    SELECT id, copy_number FROM (SELECT i.id, s.copy_number, row_number() OVER (PARTITION BY i.id ORDER BY s.start, s.copy_number) AS r FROM (SELECT id, contig, (start + stop) // 2 AS at FROM {intervals}) i LEFT JOIN {segments} s ON i.contig = s.contig AND i.at >= s.start AND i.at <= s.stop) WHERE r = 1""")
def point_in_segment(v):
    x = v.intervals.select("id", "contig", F.floor((F.col("start") + F.col("stop")) / 2).cast("long").alias("at"))
    return iv.point_in_segment(x, v.segments).select("id", "copy_number")


@R.add("""SELECT s.id AS s_id, g.segment AS g_segment FROM {intervals} s JOIN {segments} g ON s.contig = g.contig AND s.start > g.start - 200 AND s.start < g.stop + 200""")
def flank_join(v):
    return iv.flank_join(v.intervals.select("id", "contig", F.col("start").alias("pos")), v.segments.select("segment", "contig", "start", "stop"), flank=200).select("s_id", "g_segment")


@R.add("""
    WITH l AS (SELECT id AS link, contig, start AS es, start + 200 AS ee, start + 3000 AS ts, start + 3300 AS te FROM {intervals}),
         o AS (SELECT segment AS loop, contig, start AS s1, start + 300 AS e1, start + 3000 AS s2, start + 3400 AS e2 FROM {segments})
    SELECT link, EXISTS (SELECT 1 FROM o WHERE o.contig = l.contig AND ((es < e1 AND s1 < ee AND ts < e2 AND s2 < te) OR (es < e2 AND s2 < ee AND ts < e1 AND s1 < te))) AS supported FROM l""")
def paired_anchor_support(v):
    s = F.col("start")
    links = v.intervals.select(F.col("id").alias("link"), "contig", s.alias("e_start"), (s + 200).alias("e_stop"), (s + 3000).alias("t_start"), (s + 3300).alias("t_stop"))
    loops = v.segments.select(F.col("segment").alias("loop"), "contig", s.alias("a_start"), (s + 300).alias("a_stop"), (s + 3000).alias("b_start"), (s + 3400).alias("b_stop"))
    return iv.paired_anchor_support(links, loops).select("link", "supported")


@R.add("""SELECT id, greatest(0, CASE WHEN strand = '+' THEN start - 1000 ELSE start - 500 END) AS window_start, CASE WHEN strand = '+' THEN start + 500 ELSE start + 1000 END AS window_stop FROM {intervals}""")
def tss_window(v):
    return iv.tss_window(v.intervals, tss="start").select("id", "window_start", "window_stop")


@R.add("""
    WITH r AS (SELECT contig, CASE WHEN reverse THEN stop - 1 ELSE start END AS f, CASE WHEN reverse THEN start ELSE stop - 1 END AS t, CASE WHEN reverse THEN '-' ELSE '+' END AS o FROM {reads})
    SELECT contig, count(*) AS reads, count(*) FILTER (EXISTS (SELECT 1 FROM {intervals} i WHERE i.contig = r.contig AND f >= i.start AND f < i.stop AND i.strand = o)) AS five_prime,
           count(*) FILTER (EXISTS (SELECT 1 FROM {intervals} i WHERE i.contig = r.contig AND t >= i.start AND t < i.stop AND i.strand <> o)) AS three_prime FROM r GROUP BY contig""")
def end_in_footprint(v):
    return iv.end_in_footprint(v.reads, v.intervals)


@R.add("""
    SELECT DISTINCT v.chrom, v.pos, v.sample, o.start AS event_start, o.stop AS event_stop FROM (SELECT contig AS chrom, start AS pos, size % 12 AS sample FROM {intervals}) v
    JOIN (SELECT contig, start, stop, segment % 12 AS sample FROM {segments}) o ON v.chrom = o.contig AND v.sample = o.sample AND (abs(v.pos - o.start) <= 1000 OR abs(v.pos - o.stop) <= 1000)""")
def variant_near_outlier(v):
    x = v.intervals.select(F.concat(F.lit("chr"), F.col("contig")).alias("chrom"), F.col("start").alias("pos"), (F.col("size") % 12).cast("long").alias("sample"))
    o = v.segments.select("contig", "start", "stop", (F.col("segment") % 12).alias("sample"))
    return iv.variant_near_outlier(x, o).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


@R.add(f"""
    WITH f AS (SELECT *, least(start, mate_start) + tlen // 2 AS c FROM {PAIRS} WHERE (flag & 2) > 0 AND (flag & 64) > 0 AND tlen BETWEEN 1 AND 599), s AS (SELECT contig, start AS at, strand FROM {{intervals}}), n AS (SELECT count(*) AS n FROM s),
         j AS (SELECT f.tlen::BIGINT AS size, CASE WHEN s.strand = '-' THEN s.at - f.c ELSE f.c - s.at END AS o FROM f JOIN s ON f.contig = s.contig AND f.c BETWEEN s.at - 101 AND s.at + 101 AND f.start < s.at + 100 AND f.stop > greatest(0, s.at - 100))
    SELECT size, o AS "offset", round(count(*) / (SELECT n FROM n), 6) AS per_site FROM j WHERE o BETWEEN -100 AND 99 GROUP BY ALL""")
def v_plot(v):
    return rd.v_plot(_pairs(v), v.intervals.select("contig", F.col("start").alias("at"), "strand"), flank=100)


@R.add("""
    WITH RECURSIVE p AS (SELECT contig, start - 100 AS a, score, id FROM {intervals} WHERE start >= 100), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY score DESC, a, id) AS o FROM p),
         g AS (SELECT DISTINCT contig, 0::BIGINT AS o, []::BIGINT[] AS kept FROM o UNION ALL
               SELECT o.contig, o.o, CASE WHEN len(list_filter(kept, lambda x: abs(x - o.a) < 201)) = 0 THEN list_append(kept, o.a) ELSE kept END FROM g JOIN o ON o.contig = g.contig AND o.o = g.o + 1),
         k AS (SELECT contig, unnest(arg_max(kept, o)) AS a FROM g GROUP BY contig),
         f AS (SELECT k.contig, k.a AS start, least(k.a + 201, 99000) AS stop, arg_min(score, o.o) AS score, arg_min(id, o.o) AS id FROM k JOIN o USING (contig, a) GROUP BY ALL)
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM {segments} s WHERE s.segment % 10 = 0 AND s.contig = f.contig AND f.start < s.stop AND s.start < f.stop)""")
def consensus_peaks(v):
    contigs = v.intervals.select("contig", F.lit(99_000).cast("long").alias("length")).distinct()
    return iv.consensus_peaks(v.intervals.select("contig", F.col("start").alias("summit"), "score", "id"), half=100, contigs=contigs, blacklist=v.segments.where("segment % 10 = 0"))


@R.add("""
    WITH RECURSIVE h AS (SELECT tlen // 5 AS b, count(*) AS k FROM {reads} WHERE (flag & 2) > 0 AND (flag & 64) > 0 AND tlen BETWEEN 1 AND 1499 GROUP BY 1), y AS MATERIALIZED (SELECT r.b, coalesce(k, 0) AS k FROM range(300) r(b) LEFT JOIN h USING (b)),
         f AS (SELECT *, sum(new) OVER (ORDER BY b) AS run FROM (SELECT *, (k IS DISTINCT FROM lag(k) OVER (ORDER BY b))::INT AS new FROM y)), r AS (SELECT run, any_value(k) AS k, min(b) AS a, max(b) AS z FROM f GROUP BY run),
         t AS MATERIALIZED (SELECT p, k, row_number() OVER (ORDER BY k DESC, p DESC) AS o FROM (SELECT (a + z) // 2 AS p, k, lag(k) OVER w AS l, lead(k) OVER w AS n FROM r WINDOW w AS (ORDER BY run)) WHERE l < k AND n < k),
         g AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS kept UNION ALL SELECT t.o, CASE WHEN len(list_filter(kept, lambda q: abs(q - p) < 10)) = 0 THEN list_append(kept, p) ELSE kept END FROM g JOIN t ON t.o = g.o + 1),
         c AS (SELECT t.p, t.k FROM t JOIN (SELECT kept FROM g ORDER BY o DESC LIMIT 1) ON list_contains(kept, t.p)),
         l AS (SELECT c.p, c.k, coalesce((SELECT max(b) FROM y WHERE b < c.p AND y.k > c.k), -1) AS lo, coalesce((SELECT min(b) FROM y WHERE b > c.p AND y.k > c.k), 300) AS hi FROM c),
         m AS (SELECT l.p, l.k, l.k - greatest((SELECT min(y.k) FROM y WHERE y.b > l.lo AND y.b <= l.p), (SELECT min(y.k) FROM y WHERE y.b >= l.p AND y.b < l.hi)) AS prominence FROM l)
    SELECT (p + 0.5) * 5::DOUBLE AS peak, k AS height FROM m WHERE prominence >= 0.05 * (SELECT max(k) FROM y) AND (p + 0.5) * 5 > 150 AND (p + 0.5) * 5 < 250 ORDER BY k DESC, p LIMIT 1""")
def fragment_histogram_peak(v):
    return rd.fragment_histogram_peak(v.reads)


CIGARS = """
    c AS (SELECT *, line % 3 AS ls, orderkey_ % 4 AS lh, (orderkey_ + line) % 3 AS ts, line % 2 AS th FROM (SELECT *, qname AS orderkey_ FROM {reads})),
    u AS (SELECT *, start - ls - lh AS us, start + 50 + ts + th AS ue FROM c)"""


def _clipped(v):
    """Reads with CIGARs of H, S, M, S, H; without a clip where its length is 0."""
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    ls, lh, ts, th = F.col("line") % 3, F.col("qname") % 4, (F.col("qname") + F.col("line")) % 3, F.col("line") % 2
    return v.reads.withColumn("cigar", F.concat(part(lh, "H"), part(ls, "S"), F.lit("50M"), part(ts, "S"), part(th, "H")))


@R.add(f"""
    WITH {CIGARS.replace('FROM {reads})', 'FROM (SELECT * REPLACE ((start // 20000) * 20000 AS start) FROM {reads}))')}, p AS (SELECT sample % 3 AS library, qname, list_sort(list({{{{'c': contig, 'a': CASE WHEN reverse THEN ue ELSE us END, 'r': reverse}}}})) AS ends, sum(mapq) AS q FROM u WHERE {PRIMARY} AND (flag & 4) = 0 GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY library, ends ORDER BY q DESC, qname) AS r FROM p)
    SELECT r.sample % 3 AS library, r.qname, r.line, coalesce(k.r > 1, false) AS duplicate FROM {{reads}} r LEFT JOIN k ON k.library = r.sample % 3 AND k.qname = r.qname""")
def mark_duplicates(v):
    r = _clipped(v).withColumn("start", (F.floor(F.col("start") / 20000) * 20000).cast("long"))
    r = rd.with_unclipped_ends(r).withColumn("library", F.col("sample") % 3).withColumn("quality", F.col("mapq"))
    return rd.mark_duplicates(r).select("library", "qname", "line", "duplicate")


@R.add(f"""WITH {CIGARS} SELECT qname, line, us AS u_start, ue AS u_stop FROM u""")
def unclipped_ends(v):
    return rd.with_unclipped_ends(_clipped(v)).select("qname", "line", "u_start", "u_stop")
