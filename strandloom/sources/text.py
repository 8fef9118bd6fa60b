"""Readers of the field's text formats as DataFrames with fixed schemas, and the two writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, skip: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(skip) & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: chrom, pos, id, ref, alt (as written), qual, filter, info map, format, samples; '.' in QUAL is null."""
    f = _fields(spark, path, "^#")
    c = lambda i: F.get("f", F.lit(i))
    return f.select(c(0).alias("chrom"), c(1).cast("long").alias("pos"), c(2).alias("id"), c(3).alias("ref"), c(4).alias("alt"), c(5).try_cast("double").alias("qual"), c(6).alias("filter"), F.str_to_map(c(7), F.lit(";"), F.lit("=")).alias("info"), c(8).alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop and the rest of the fields; comment, track and browser lines are skipped."""
    f = _fields(spark, path, "^(#|track|browser)")
    return f.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("stop"), F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))).alias("rest"))


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """Peaks with their summit. A row without exactly ten fields, with coordinates or a summit that aren't whole numbers, an end at or before the start, or a summit outside the peak (-1: none called) is an error, and so is a file without rows."""
    f = _fields(spark, path, "^(#|track|browser)")
    if f.isEmpty():
        raise ValueError(f"no narrowPeak rows in {path}")
    at = lambda i: F.get("f", F.lit(i))
    start, stop, summit = (at(i).try_cast("long") for i in (1, 2, 9))
    whole = lambda i: F.coalesce(at(i).rlike("^[0-9]+$"), F.lit(False))
    good = (F.size("f") == 10) & whole(1) & whole(2) & whole(9) & F.coalesce((stop > start) & (summit < stop - start), F.lit(False))
    f = f.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a narrowPeak row: "), F.concat_ws(" ", "f"))).cast("boolean")))
    return f.select(at(0).alias("contig"), start.alias("start"), stop.alias("stop"), at(3).alias("id"), at(6).cast("double").alias("score"), (start + summit).alias("summit"))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Two intervals per row."""
    f = _fields(spark, path, "^(#|track|browser)")
    n = lambda i: F.get("f", F.lit(i)).cast("long")
    return f.select(F.get("f", F.lit(0)).alias("contig"), n(1).alias("a_start"), n(2).alias("a_stop"), F.get("f", F.lit(3)).alias("b_contig"), n(4).alias("b_start"), n(5).alias("b_stop"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows: qname, flag, contig, start (0-based), stop, mapq, cigar, tlen, seq, quals, tags map (by name)."""
    f = _fields(spark, path, "^@")
    c = lambda i: F.get("f", F.lit(i))
    d = f.select(c(0).alias("qname"), c(1).cast("int").alias("flag"), c(2).alias("contig"), (c(3).cast("long") - 1).alias("start"), c(4).cast("int").alias("mapq"), c(5).alias("cigar"), c(8).cast("int").alias("tlen"), c(9).alias("seq"), c(10).alias("_q"), F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))).alias("_t"))
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    stop = F.col("start") + F.aggregate(ops, F.lit(0), lambda a, n: a + n.cast("int"))
    quals = F.when(F.col("_q") != "*", F.transform(F.filter(F.split("_q", ""), lambda x: x != ""), lambda x: F.ascii(x) - 33))
    tags = F.map_from_entries(F.transform("_t", lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("v"))))
    return d.withColumn("stop", stop).withColumn("quals", quals).withColumn("tags", tags).drop("_q", "_t")


def read_mtx(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """(cell, gene, n) of a coordinate matrix; ids are joined by their line in the (small) side files."""

    def lines(path: str, name: str) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("_p", "_v")).select((F.col("_p") + 1).cast("long").alias(f"_{name}"), F.split("_v", "\t")[0].alias(name))

    line = spark.read.text(matrix).select("value", "_metadata.file_block_start")
    #: The size line is the first that is no comment, in the file's first block.
    head = line.where(~F.col("value").startswith("%") & (F.col("file_block_start") == 0) & (F.length(F.trim("value")) > 0)).limit(1).first()
    t = line.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select("value")
    same = F.col("value") == F.lit(head[0] if head else "")
    #: Entries that read like it stay: of equal lines, one goes.
    more = t.where(same).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.explode(F.sequence(F.lit(2).cast("long"), "k"))).select(F.lit(head[0] if head else "").alias("value"))
    f = t.where(~same).unionByName(more).select(F.split(F.trim("value"), r"\s+").alias("f"))
    g, b = lines(features, "gene"), lines(barcodes, "cell")
    r = f.select(*[F.get("f", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("_gene", "_cell", "n"))])
    return r.join(g, "_gene").join(b, "_cell").select("cell", "gene", "n")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): the second pipe field of a header where there is one, else its first word. A '>' within a header line is not supported."""
    r = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    name = F.when(head.contains("|"), F.split(head, r"\|")[1]).otherwise(F.split(head, r"\s")[0])
    return r.select(name.alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set, gene) of a gene-set file."""
    f = _fields(spark, path, "^#")
    return f.select(F.get("f", F.lit(0)).alias("set"), F.explode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("gene")).where("gene <> ''")


def read_report_matrix(spark: SparkSession, path: str, *, feature: str = "Protein.Group", run: str = "Run", value: str = "PG.MaxLFQ", limits: dict[str, float] | None = None) -> DataFrame:
    """(feature, run, log2) of a report at q limits; of repeated cells the least value, 0 as null."""
    limits = {"Q.Value": 0.01, "PG.Q.Value": 0.01, "Lib.Q.Value": 0.01} if limits is None else limits
    ok = F.lit(True)
    for c, x in limits.items():
        ok = ok & (F.col(f"`{c}`") <= x)
    v = F.min(f"`{value}`")
    return spark.read.parquet(path).where(ok).groupBy(F.col(f"`{feature}`").alias("feature"), F.col(f"`{run}`").alias("run")).agg(F.log2(F.when(v > 0, v)).alias("log2"))


def write_by_key(df: DataFrame, path: str, *, key: str) -> None:
    """Files per key; an existing path is an error."""
    df.write.partitionBy(key).mode("errorifexists").parquet(path)


def manifest(df: DataFrame, *, key: str) -> DataFrame:
    """Records per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def write_in_chunks(df: DataFrame, path: str, *, records: int) -> None:
    """Files of at most ``records`` rows; an existing path is an error."""
    df.write.option("maxRecordsPerFile", records).mode("errorifexists").parquet(path)
