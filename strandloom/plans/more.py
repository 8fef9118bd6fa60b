"""Registered queries: readers by round trip, pileup and junctions, least squares, screens, proteomics checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import events as ev
from strandloom.operators import matrix as mx
from strandloom.operators import proteins as pr
from strandloom.operators import reads as rd
from strandloom.operators import variants as va
from strandloom.plans.core import Registry, bh, norm_two_sided, t_two_sided
from strandloom.scratch import shared_root
from strandloom.sources import text

R = Registry()


def _file(df: DataFrame, name: str, *fields) -> str:
    """Writes rows of tab-separated fields to a new text folder."""
    import uuid

    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.select(F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]).alias("value")).write.text(path)
    return path


@R.add("SELECT chrom, pos, ref, alt, round(qual, 6) AS qual, filter, size::VARCHAR AS dp FROM {variants}")
def read_vcf(v):
    x = v.variants.withColumn("id", F.lit(".")).withColumn("info", F.concat(F.lit("DP="), F.col("size").cast("string"), F.lit(";DB")))
    p = _file(x, "vcf", "chrom", "pos", "id", "ref", "alt", F.coalesce(F.col("qual").cast("string"), F.lit(".")), "filter", "info")
    return text.read_vcf(v.spark, p).select("chrom", "pos", "ref", "alt", "qual", "filter", F.col("info")["DP"].alias("dp"))


@R.add("SELECT contig, start, stop, id::VARCHAR AS name FROM {intervals}")
def read_bed(v):
    return text.read_bed(v.spark, _file(v.intervals, "bed", "contig", "start", "stop", "id")).select("contig", "start", "stop", F.get("rest", F.lit(0)).alias("name"))


@R.add("SELECT contig, start, stop, id::VARCHAR AS id, round(score, 6) AS score, start + size AS summit FROM {intervals}")
def read_narrowpeak(v):
    z = F.lit("0")
    return text.read_narrowpeak(v.spark, _file(v.intervals, "peaks", "contig", "start", "stop", "id", z, "strand", "score", z, z, "size"))


@R.add("SELECT contig, start AS a_start, stop AS a_stop, contig AS b_contig, start + 5000 AS b_start, stop + 5000 AS b_stop FROM {intervals}")
def read_bedpe(v):
    return text.read_bedpe(v.spark, _file(v.intervals, "bedpe", "contig", "start", "stop", "contig", F.col("start") + 5000, F.col("stop") + 5000))


@R.add("SELECT qname::VARCHAR AS qname, flag, contig, start, start + 9 AS stop, mapq, tlen, line::VARCHAR AS nh FROM {reads}")
def read_sam(v):
    star = F.lit("*")
    p = _file(v.reads, "sam", "qname", "flag", "contig", F.col("start") + 1, "mapq", F.lit("2S4M1D4M"), F.lit("="), F.lit("0"), "tlen", F.lit("ACGTACGTAC"), star, F.concat(F.lit("NH:i:"), F.col("line").cast("string")))
    return text.read_sam(v.spark, p).select("qname", "flag", "contig", "start", "stop", "mapq", "tlen", F.col("tags")["NH"].alias("nh"))


@R.add('SELECT brand AS "set", id::VARCHAR AS gene FROM {parts}')
def read_gmt(v):
    x = v.parts.groupBy("brand").agg(F.array_join(F.collect_list(F.col("id").cast("string")), "\t").alias("genes"))
    return text.read_gmt(v.spark, _file(x, "gmt", "brand", F.lit("d"), "genes"))


@R.add("SELECT id::VARCHAR AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM {texts} WHERE regexp_matches(upper(text), '[ACGT]')")
def read_fasta(v):
    d = v.texts.select("id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where("seq <> ''")
    lines = F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" d\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    return text.read_fasta(v.spark, _file(d, "fasta", lines))


@R.add("SELECT feature, sample, n FROM {counts} WHERE feature >= 1 AND sample >= 0")
def read_mtx(v):
    c = v.counts
    most = c.agg(F.max("feature"), F.count(F.lit(1))).first()
    head = v.spark.createDataFrame([(f"%%MatrixMarket\n{most[0]} 12 {most[1]}",)], "value string")
    body = c.select(F.concat_ws(" ", F.col("feature").cast("string"), (F.col("sample") + 1).cast("string"), F.col("n").cast("string")).alias("value"))
    whole = head.withColumn("k", F.lit(0)).unionByName(body.withColumn("k", F.lit(1))).repartition(1).sortWithinPartitions("k", "value")
    p = _file(whole, "mtx", "value")
    g = _file(v.spark.range(1, most[0] + 1).coalesce(1), "features", "id")
    b = _file(v.spark.range(12).coalesce(1), "barcodes", "id")
    x = text.read_mtx(v.spark, p, g, b)
    return x.select(F.col("gene").cast("long").alias("feature"), F.col("cell").cast("int").alias("sample"), "n")


def _bases(v):
    """Reads of four bases, a deleted one and four more; the third base is of low quality."""
    q = F.array(*[F.lit(x) for x in (30, 30, 5, 30, 30, 30, 30, 30)])
    return v.reads.select("contig", (F.col("start") % 3000).alias("start"), F.lit("4M1D4M").alias("cigar"), F.substr(F.lit("ACGTACGTNCGT"), (F.col("line") % 5 + 1).cast("int"), F.lit(8)).alias("seq"), q.alias("quals"), "mapq")


PILE = """
    r AS (SELECT contig, start % 3000 AS s, substr('ACGTACGTNCGT', (line % 5 + 1)::INT, 8) AS seq FROM {reads} WHERE mapq >= 20),
    b AS (SELECT contig, s + i AS pos, CASE WHEN i = 4 THEN 'DEL' ELSE substr(seq, (CASE WHEN i < 4 THEN i ELSE i - 1 END + 1)::INT, 1) END AS base FROM (SELECT *, unnest([0, 1, 3, 4, 5, 6, 7, 8]) AS i FROM r)),
    g AS (SELECT contig, pos, base, count(*) AS n FROM b WHERE base <> 'N' GROUP BY ALL), p AS (SELECT *, sum(CASE WHEN base <> 'DEL' THEN n END) OVER (PARTITION BY contig, pos) AS depth FROM g)"""


@R.add(f"WITH {PILE} SELECT contig, pos, base, n, round(CASE WHEN base <> 'DEL' THEN n / depth END, 6) AS frequency, depth::BIGINT AS depth FROM p")
def pileup_alleles(v):
    return rd.pileup_alleles(_bases(v))


@R.add(f"WITH {PILE} SELECT contig, pos + 1 AS pos, substr('ACGN', (pos % 4)::INT + 1, 1) AS ref, base AS alt, n, depth::BIGINT AS depth, round(n / depth, 6) AS frequency FROM p WHERE base <> 'DEL' AND pos % 4 <> 3 AND base <> substr('ACGN', (pos % 4)::INT + 1, 1) AND depth >= 10 AND n / depth >= 0.1")
def call_snvs(v):
    p = rd.pileup_alleles(_bases(v))
    ref = p.select("contig", "pos").distinct().withColumn("ref", F.substr(F.lit("ACGN"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))
    return rd.call_snvs(p, ref)


@R.add("""
    WITH r AS (SELECT contig, start // 500 * 500 AS s, qname, CASE WHEN line % 3 = 0 THEN 4 ELSE 12 END AS left_, mapq FROM {reads} WHERE (flag & 256) = 0 AND (flag & 2048) = 0 AND (flag & 4) = 0 AND CASE WHEN line % 2 = 0 THEN tlen % 2 = 0 ELSE mapq >= 30 END),
         j AS (SELECT contig, s + left_ AS a, s + left_ + 100 AS z, qname, least(left_, 16) AS o FROM r)
    SELECT contig, a AS i_start, z AS i_stop, count(DISTINCT CASE WHEN o >= 8 THEN qname END) AS reads, count(DISTINCT qname) AS reads_all, max(o)::INT AS max_overhang FROM j GROUP BY ALL""")
def junction_support(v):
    return rd.junction_support(_spliced(v), min_mapq=30)


def _spliced(v):
    r = v.reads.withColumn("start", F.floor(F.col("start") / 500) * 500).withColumn("cigar", F.when(F.col("line") % 3 == 0, "4M100N16M").otherwise("12M100N16M"))
    return r.withColumn("nh", F.when(F.col("line") % 2 == 0, 1 + F.col("tlen") % 2))


@R.add("""
    WITH s AS (SELECT contig, start AS w FROM {intervals} WHERE start >= 500), k AS (SELECT count(*) AS n FROM s), o AS (SELECT count(*) AS k FROM {intervals} WHERE start < 500),
         x AS (SELECT s.w, r.start AS a, r.stop AS z FROM s JOIN {reads} r ON r.contig = s.contig AND r.start < s.w + 500 AND r.stop > s.w - 500),
         t AS (SELECT sum(greatest(0, least(z, w + 50) - greatest(a, w - 50))) AS c, sum(greatest(0, least(z, w - 400) - greatest(a, w - 500)) + greatest(0, least(z, w + 500) - greatest(a, w + 400))) AS o FROM x)
    SELECT n AS sites, o.k AS skipped, round(c / 100.0 / (t.o / 200.0), 6) AS score FROM t CROSS JOIN k CROSS JOIN o""")
def tss_enrichment(v):
    return rd.tss_enrichment(v.reads, v.intervals.select("contig", F.col("start").alias("at"), "strand"), flank=500)


OLS = """
    m AS (SELECT feature, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(b) AS mb FROM d GROUP BY feature),
    s AS (SELECT feature, any_value(n) AS n, sum((c - mc) * (c - mc)) AS cc, sum((b - mb) * (b - mb)) AS bb, sum((c - mc) * (b - mb)) AS cb, sum((c - mc) * (y - my)) AS cy, sum((b - mb) * (y - my)) AS b_y, sum((y - my) * (y - my)) AS yy FROM d JOIN m USING (feature) GROUP BY feature),
    o AS (SELECT *, CASE WHEN n > 3 AND round(cc * bb - cb * cb, 9) > 0 THEN cc * bb - cb * cb END AS det FROM s),
    e AS (SELECT *, (cy * bb - b_y * cb) / det AS beta, (b_y * cc - cy * cb) / det AS g FROM o),
    f AS (SELECT feature, n, beta, sqrt(bb / det * greatest(0.0, yy - beta * cy - g * b_y) / (n - 3)) AS se, CASE WHEN det IS NOT NULL THEN (n - 3)::DOUBLE END AS df FROM e),
    t AS (SELECT *, beta / nullif(se, 0) AS t FROM f)"""


@R.add(f"WITH d AS (SELECT feature, log2(n + 1) AS y, is_case::INT AS c, batch AS b FROM {{counts}}), {OLS} SELECT feature, n, round(beta, 6) AS beta, round(se, 6) AS se, df, round(t, 5) AS t, round({t_two_sided('t', 'df')}, 6) AS p FROM t")
def feature_ols_terms(v):
    x = v.counts.withColumn("x", F.log2(F.col("n") + 1)).withColumn("case", F.col("is_case").cast("double")).withColumn("b", F.col("batch").cast("double"))
    return mx.feature_ols(x, design=["case", "b"], term="case").select("feature", "n", "beta", "se", "df", F.round("t", 5).alias("t"), "p")


@R.add(f"""
    WITH k AS (SELECT feature FROM {{counts}} WHERE n > 0 GROUP BY feature HAVING count(DISTINCT sample) >= 11), z AS (SELECT DISTINCT sample, is_case, batch FROM {{counts}}),
         l AS (SELECT k.feature, z.sample, is_case, batch, ln(coalesce(c.n, 0) + 0.5) AS l FROM k CROSS JOIN z LEFT JOIN (SELECT feature, sample, n FROM {{counts}}) c ON c.feature = k.feature AND c.sample = z.sample),
         d AS (SELECT feature, l - avg(l) OVER (PARTITION BY sample) AS y, is_case::INT AS c, batch AS b FROM l), {OLS}, p AS (SELECT *, {t_two_sided('t', 'df')} AS p FROM t)
    SELECT feature, n, round(beta, 6) AS beta, round(p, 6) AS p, round(q, 5) AS q FROM {bh("p")}""")
def differential_taxa(v):
    s = v.counts.select("sample", F.col("is_case").cast("double").alias("case"), F.col("batch").cast("double").alias("b")).distinct()
    d = mx.differential_taxa(v.counts.select("feature", "sample", "n"), s, design=["case", "b"], term="case", least=11)
    return d.select("feature", "n", "beta", "p", F.round("q", 5).alias("q"))


@R.add("SELECT id, price::DOUBLE AS value, 'price' AS sample FROM {parts} UNION ALL SELECT id, size::DOUBLE, 'size' FROM {parts}")
def melt(v):
    return mx.melt(v.parts.select("id", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size")), ids=["id"])


@R.add('SELECT feature, min(n) FILTER (sample = 0) AS "0", min(n) FILTER (sample = 1) AS "1", min(n) FILTER (sample = 2) AS "2" FROM {counts} GROUP BY feature')
def pivot_matrix(v):
    return mx.pivot_matrix(v.counts, rows=["feature"], column="sample", value="n", values=[0, 1, 2])


@R.add("SELECT id, 'A' || id AS leading_id FROM {parts} WHERE size % 3 <> 0 AND size % 5 <> 0")
def drop_bookkeeping_rows(v):
    plus = lambda k: F.when(F.col("size") % k == 0, "+")
    x = v.parts.select("id", plus(3).alias("reverse"), plus(5).alias("contaminant"), F.concat(F.lit("A"), F.col("id").cast("string"), F.lit(";B")).alias("protein_ids"))
    return mx.drop_bookkeeping_rows(x, flags=["reverse", "contaminant"]).select("id", "leading_id")


@R.add("WITH g AS (SELECT orderkey, line, avg(discount) AS d, min(partkey) % 100 AS v FROM {lines} GROUP BY ALL) SELECT v AS variant, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) AS n FROM g WHERE line = 1 GROUP BY 1")
def variant_scores(v):
    x = v.lines.groupBy(F.concat_ws(":", "orderkey", "line").alias("guide"), (F.col("line") - 1).alias("bystanders")).agg(F.avg("discount").alias("score"), (F.min("partkey") % 100).alias("variant"))
    return mx.variant_scores(x.select("guide", "score"), x.select("guide", "bystanders", "variant"))[0]


@R.add("""
    WITH a AS (SELECT partkey AS gene, avg(discount) - 0.05 AS e, avg(tax) AS f FROM {lines} WHERE line <= 3 GROUP BY 1), b AS (SELECT partkey AS gene, avg(discount) - 0.05 AS e, avg(tax) AS f FROM {lines} WHERE line > 3 GROUP BY 1)
    SELECT gene, round(a.e, 6) AS effect_a, round(b.e, 6) AS effect_b FROM a JOIN b USING (gene) WHERE round(a.f, 9) < 0.04 AND round(b.f, 9) < 0.04 AND sign(round(a.e, 9)) = sign(round(b.e, 9))""")
def cross_validate_hits(v):
    side = lambda c: v.lines.where(c).groupBy(F.col("partkey").alias("gene")).agg(F.round(F.avg("discount") - 0.05, 9).alias("effect"), F.round(F.avg("tax"), 9).alias("fdr"))
    return mx.cross_validate_hits(side("line <= 3"), side("line > 3"), alpha=0.04)


@R.add("SELECT id, CASE WHEN price > 970 THEN 'essential' WHEN price < 930 THEN 'tumor_suppressor' ELSE 'neutral' END AS call FROM {parts} WHERE size <> 7")
def call_by_threshold(v):
    return mx.call_by_threshold(v.parts, score="price", essential=970, suppressor=930, controls=F.col("size") == 7).select("id", "call")


@R.add("""SELECT substr(flag || status || 'ACGT', 2, 1) <> 'F' AS target_edited, substr(flag || status || 'ACGT', 1, 1) <> 'R' AS bystander_1_edited, round(sum(quantity), 6) AS pct FROM {lines} GROUP BY ALL""")
def edit_pattern_partition(v):
    x = v.lines.select(F.concat("flag", "status", F.lit("ACGT")).alias("aligned"), F.lit("RFACGT").alias("reference"), F.col("quantity").alias("pct"))
    return mx.edit_pattern_partition(x, target=2, bystanders=[1])


@R.add("""
    WITH j AS (SELECT size / 50.0 AS e, CASE WHEN id % 7 <> 0 THEN id % 40 END AS g FROM {parts})
    SELECT count(*) AS guides, count(*) FILTER (g IS NULL) AS unmapped, round(avg((e < 0.3)::INT), 6) AS low_share, round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75), 6) AS q3, (SELECT count(*) FROM (SELECT g FROM j WHERE g IS NOT NULL GROUP BY g HAVING max(e) < 0.3)) AS genes_all_low FROM j""")
def guide_efficacy_summary(v):
    s = v.parts.select(F.col("id").alias("guide"), (F.col("size") / 50.0).alias("efficacy"))
    return mx.guide_efficacy_summary(s, v.parts.where("id % 7 <> 0").select(F.col("id").alias("guide"), (F.col("id") % 40).alias("gene")))


@R.add("""
    WITH g AS (SELECT partkey AS gene, avg(discount) AS v FROM {lines} GROUP BY 1), x AS (SELECT count(*) FILTER (gene % 3 = 0) AS a, avg(v) FILTER (gene % 3 = 0) AS b, count(*) FILTER (gene % 3 = 1) AS c, avg(v) FILTER (gene % 3 = 1) AS d FROM g)
    SELECT a AS essential_present, round(b, 6) AS essential_mean, c AS other_present, round(d, 6) AS other_mean, CASE WHEN a < 100 OR c < 100 THEN 'too few' WHEN b < d THEN 'ok' ELSE 'not separated' END AS verdict FROM x""")
def reference_set_check(v):
    x = v.lines.select(F.col("partkey").alias("gene"), F.col("discount").alias("lfc"))
    return mx.reference_set_check(x, x.where("gene % 3 = 0"), x.where("gene % 3 = 1"))


@R.add("""
    WITH g AS (SELECT suppkey % 12 AS run, count(*) AS rows, pow(corr(quantity, price), 2) AS r2, quantile_cont(tax, 0.5) AS w FROM {lines} WHERE discount <= 0.05 GROUP BY 1), m AS (SELECT *, w / quantile_cont(w, 0.5) OVER () AS f FROM g)
    SELECT run, rows, round(r2, 6) AS r2, round(w, 6) AS median_width, round(f, 6) AS width_vs_median, r2 < 0.99 OR f > 1.25 AS flag FROM m""")
def run_metrics(v):
    x = v.lines.select((F.col("suppkey") % 12).alias("run"), F.col("quantity").alias("rt"), F.col("price").alias("predicted"), F.col("tax").alias("width"), F.col("discount").alias("q"))
    return mx.run_metrics(x, alpha=0.05)


@R.add("""
    WITH p AS (SELECT price AS h, quantity AS l, line - 1 AS k FROM {lines}), s AS (SELECT h / (h + l) AS r FROM p WHERE k = 0)
    SELECT (SELECT count(*) FROM s) AS n_peptides, count(*) AS n_signal_peptides, round(sum(h) FILTER (k = 0) / sum(h + l) FILTER (k = 0), 6) AS incorporation, (SELECT round(quantile_cont(r, 0.5), 6) FROM s) AS median_peptide_incorporation, (SELECT count(*) FROM s WHERE r < 0.95) AS peptides_below_95pct, round(regr_slope(log2(h / l), k), 6) AS log2_slope_per_proline FROM p""")
def silac_checks(v):
    x = v.lines.select(F.col("price").alias("heavy"), F.col("quantity").alias("light"), (F.col("line") - 1).alias("prolines"))
    return mx.silac_checks(x).select("n_peptides", "n_signal_peptides", "incorporation", "median_peptide_incorporation", "peptides_below_95pct", "log2_slope_per_proline")


@R.add("SELECT id, CASE WHEN size % 2 = 0 AND size % 3 = 0 THEN 1 WHEN size % 2 = 1 AND size % 3 = 0 THEN 2 WHEN size % 2 = 1 THEN 3 END AS level FROM {parts} WHERE size / 50.0 >= 0.7")
def feature_level_filter(v):
    x = v.parts.select("id", (F.col("size") / 50.0).alias("fill"), F.when(F.col("size") % 2 == 0, "reference").otherwise("library").alias("tag"), (F.col("size") % 3 == 0).alias("ms2_matched"))
    return mx.feature_level_filter(x).select("id", "level")


@R.add("""
    WITH r AS (SELECT line AS level, suppkey % 8 AS lot, (price / (quantity + 1)) / ((tax + 1) / (discount + 1)) AS r FROM {lines})
    SELECT level, count(DISTINCT lot) AS lots, round(avg(r), 4) AS factor, round(stddev_samp(r) / avg(r), 6) AS cv, count(DISTINCT lot) >= 6 AND stddev_samp(r) / avg(r) <= 0.15 AS pass FROM r GROUP BY level""")
def matrix_factor(v):
    x = v.lines.select(F.col("line").alias("level"), (F.col("suppkey") % 8).alias("lot"), F.col("price").alias("analyte_matrix"), (F.col("quantity") + 1).alias("analyte_neat"), (F.col("tax") + 1).alias("is_matrix"), (F.col("discount") + 1).alias("is_neat"))
    return mx.matrix_factor(x).withColumn("factor", F.round("factor", 4))


@R.add("SELECT line AS level, round(avg(price) FILTER (flag = 'R') / avg(price) FILTER (flag = 'A'), 6) AS recovery FROM {lines} GROUP BY line")
def recovery(v):
    return mx.recovery(v.lines.select(F.col("line").alias("level"), F.when(F.col("flag") == "R", "pre").when(F.col("flag") == "A", "post").alias("stage"), F.col("price").alias("area")))


@R.add("SELECT round(max(quantity) FILTER (flag = 'R') / avg(price) FILTER (flag = 'A'), 6) AS carryover, max(quantity) FILTER (flag = 'R') / avg(price) FILTER (flag = 'A') <= 0.2 AS pass FROM {lines}")
def carryover(v):
    return mx.carryover(v.lines.select(F.when(F.col("flag") == "R", "blank").when(F.col("flag") == "A", "lowest").alias("kind"), F.when(F.col("flag") == "R", F.col("quantity")).otherwise(F.col("price")).alias("area")))


@R.add("SELECT id AS read, CASE WHEN size >= 10 THEN substr(repeat('ACGT', 3), 1, 8) END AS umi, CASE WHEN size >= 10 THEN id || '_ACGTACGT' END AS name FROM {parts}")
def extract_umi(v):
    a = v.parts.select(F.col("id").alias("read"))
    b = v.parts.select(F.col("id").alias("read"), F.when(F.col("size") >= 10, "ACGTACGTACGT").otherwise("ACG").alias("seq"))
    return pr.extract_umi(a, b, length=8)


@R.add(f"""
    WITH p AS (SELECT partkey % 20 AS a, 20 + suppkey % 20 AS b, avg(discount) AS mu, count(*) AS n FROM {{lines}} GROUP BY 1, 2), s AS (SELECT size AS gene, avg(price) / 20000 AS v FROM {{parts}} WHERE size < 39 GROUP BY size),
         g AS (SELECT p.*, x.v + y.v AS expected, mu - x.v - y.v AS gi FROM p JOIN s x ON x.gene = a JOIN s y ON y.gene = b), z AS (SELECT *, (gi - avg(gi) OVER ()) / stddev_pop(gi) OVER () AS z FROM g), q AS (SELECT *, {norm_two_sided("z")} AS p FROM z)
    SELECT a, b, n, round(gi, 6) AS gi, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN q < 0.05 AND z < 0 THEN 'synthetic_lethal' WHEN q < 0.05 AND z > 0 THEN 'synthetic_rescue' ELSE 'no_interaction' END AS class FROM {bh("q")}""")
def genetic_interaction(v):
    p = v.lines.select((F.col("partkey") % 20).alias("a"), (20 + F.col("suppkey") % 20).alias("b"), F.col("discount").alias("lfc"))
    s = v.parts.where("size < 39").groupBy(F.col("size").alias("gene")).agg((F.avg("price") / 20000).alias("lfc"))
    return mx.genetic_interaction(p, s).select("a", "b", "n", "gi", "z", "p", "q", "class")


@R.add(f"WITH x AS (SELECT id, sqrt(size / 5.0) AS z FROM {{parts}}), p AS (SELECT id, {norm_two_sided('z')} AS p FROM x) SELECT id, round(p, 6) AS p, round(q, 6) AS q FROM {bh('p')}")
def chisq_to_q(v):
    return ev.chisq_to_q(v.parts.select("id", (F.col("size") / 5.0).alias("chisq"))).select("id", "p", "q")


VARIANTS = """
    s AS (SELECT id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM {texts}), c AS (SELECT id, seq, len(seq) AS n, unnest([0, 1, 2, 3, 4]) AS j FROM s WHERE len(seq) >= 200),
    v AS (SELECT id, seq, j, 1 + j % 3 AS k, 100 + (id * 7 + j * 13) % (n - 150) AS p FROM c)"""


@R.add(f"""
    WITH RECURSIVE {VARIANTS}, roll AS (SELECT * FROM v UNION ALL SELECT id, seq, j, k, p - 1 FROM roll WHERE p > 1 AND substr(seq, p, 1) = substr(seq, p + k, 1)), e AS (SELECT id, j, any_value(k) AS k, min(p) AS p, any_value(seq) AS seq FROM roll GROUP BY id, j)
    SELECT id AS chrom, j AS number, p::BIGINT AS pos, substr(seq, p, k + 1) AS ref, substr(seq, p, 1) AS alt FROM e""")
def normalize_variant(v):
    d = v.texts.select("id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).withColumn("n", F.length("seq")).where("n >= 200")
    x = d.withColumn("j", F.explode(F.array(*[F.lit(k) for k in range(5)]))).withColumn("k", 1 + F.col("j") % 3).withColumn("p", 100 + (F.col("id") * 7 + F.col("j") * 13) % (F.col("n") - 150))
    x = x.select(F.col("id").alias("chrom"), F.col("j").alias("number"), F.col("p").alias("pos"), F.expr("substr(seq, cast(p as int), k + 1)").alias("ref"), F.expr("substr(seq, cast(p as int), 1)").alias("alt"))
    ref = d.select(F.col("id").alias("chrom"), F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,1000}"), F.lit(0))).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("long"))
    return va.normalize_variant(x, ref, chunk=1000, anchor_after=True)
