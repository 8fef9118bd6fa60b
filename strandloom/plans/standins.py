"""Domain shapes made from the driver's tables.

Each stand-in is a list of expressions that Spark and DuckDB read alike, so a
query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions, condition)
STANDINS: dict[str, tuple[str, list[str], str]] = {
    "reads": ("lineitem", [
        "l_orderkey AS qname", "l_linenumber AS line", "concat('c', CAST(l_suppkey % 5 AS STRING)) AS contig", "CAST(floor(l_extendedprice) AS BIGINT) AS start",
        "CAST(floor(l_extendedprice) + 50 + floor(l_quantity) AS BIGINT) AS stop", "CAST(floor(l_quantity) AS INT) AS mapq",
        "CAST((CASE WHEN l_linenumber <= 2 THEN 3 ELSE 1 END) + (CASE WHEN l_linestatus = 'F' THEN 16 ELSE 32 END) + (CASE WHEN l_linenumber % 2 = 0 THEN 64 ELSE 128 END)"
        " + (CASE WHEN l_linenumber = 6 THEN 256 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END) + (CASE WHEN l_linenumber = 7 THEN 2048 ELSE 0 END) AS INT) AS flag",
        "CAST(l_partkey % 700 AS INT) AS tlen", "l_linestatus = 'F' AS reverse", "l_suppkey % 12 AS sample",
    ], "true"),
    "intervals": ("part", ["p_partkey AS id", "concat('c', CAST(p_size % 5 AS STRING)) AS contig", "p_partkey * 50 AS start", "p_partkey * 50 + p_size * 10 + 1 AS stop", "p_retailprice AS score", "p_brand AS brand", "p_size AS size", "CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand"], "true"),
    "segments": ("supplier", ["concat('c', CAST(s_suppkey % 5 AS STRING)) AS contig", "s_suppkey * 1000 AS start", "s_suppkey * 1000 + 1000 AS stop", "CAST(1 + s_nationkey % 8 AS DOUBLE) AS copy_number", "s_suppkey AS segment"], "true"),
    "variants": ("part", [
        "concat('chr', CAST(p_size % 5 AS STRING)) AS chrom", "p_partkey AS pos", "substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref",
        "CASE WHEN p_size % 7 = 0 THEN concat(substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1), 'TT') WHEN p_size % 5 = 0 THEN concat(substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1), ',', substr('GTAC', CAST(p_partkey % 4 AS INT) + 1, 1)) ELSE substr('GTCA', CAST((p_partkey + p_size) % 4 AS INT) + 1, 1) END AS alt",
        "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_retailprice END AS qual", "CASE WHEN p_brand = 'Brand#1' THEN 'LowQual' ELSE 'PASS' END AS filter", "p_size AS size", "p_partkey % 10 AS tenth",
    ], "true"),
    "genotypes": ("orders", ["o_orderkey % 200 AS site", "o_custkey % 60 AS sample", "CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN '0/1' WHEN '3' THEN '1/1' WHEN '4' THEN './.' ELSE '0/0' END AS gt", "o_orderkey AS k", "CAST(o_custkey % 50 AS INT) AS gq", "CAST(10 + o_orderkey % 30 AS INT) AS ref_depth", "CAST(5 + o_custkey % 20 AS INT) AS alt_depth"], "true"),
    "counts_raw": ("lineitem", ["l_partkey AS feature", "CAST(l_suppkey % 12 AS INT) AS sample", "CAST(floor(l_quantity) AS BIGINT) AS k"], "true"),
    "psms": ("events", ["user_id * 100 + event_id % 100 AS scan", "value AS score", "concat(CASE WHEN event_type = 'error' THEN 'DECOY_' ELSE '' END, 'P', CAST(event_id % 50 AS STRING)) AS protein", "event_id AS psm", "event_type AS kind", "user_id AS run"], "true"),
    "peptides": ("lineitem", ["l_orderkey AS peptide", "concat(CASE WHEN l_suppkey % 4 = 3 THEN 'DECOY_' ELSE '' END, 'S', CAST(l_suppkey AS STRING)) AS protein", "l_extendedprice AS intensity", "l_quantity AS rt", "l_partkey AS partkey", "l_linenumber AS line"], "true"),
    "gwas1": ("part", ["p_partkey AS snp", "substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS a1", "substr('CTAG', CAST((p_partkey + p_size) % 4 AS INT) + 1, 1) AS a2", "(p_retailprice - 950) / 100 AS beta", "CAST(0.01 + p_size / 1000.0 AS DOUBLE) AS se", "CAST(0.01 + (p_partkey % 49) / 100.0 AS DOUBLE) AS maf", "p_brand AS locus", "p_partkey * 1000 AS pos", "p_size AS size"],
              "substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) <> substr('CTAG', CAST((p_partkey + p_size) % 4 AS INT) + 1, 1)"),
    "orders": ("orders", ["o_orderkey AS unit", "o_custkey AS donor", "o_orderpriority AS block", "o_totalprice AS price", "o_orderstatus AS status"], "true"),
    "cell_rows": ("orders", ["o_orderkey AS orderkey", "o_custkey AS cell"], "true"),
    "customers": ("customer", ["c_custkey AS cell", "c_nationkey AS donor", "c_mktsegment AS segment", "CAST(c_nationkey % 8 AS INT) AS cluster", "c_acctbal AS score"], "true"),
    "lines": ("lineitem", ["l_orderkey AS orderkey", "CAST(l_partkey % 200 AS INT) AS gene", "CAST(floor(l_quantity) AS BIGINT) AS k", "l_suppkey AS suppkey", "l_partkey AS partkey", "l_discount AS discount", "l_extendedprice AS price", "l_returnflag AS flag", "l_linestatus AS status", "l_linenumber AS line", "l_tax AS tax", "l_quantity AS quantity"], "true"),
    "texts": ("documents", ["doc_id AS id", "text", "lang", "source", "n_chars"], "true"),
    "labels": ("labels", ["doc_id AS id", "quality", "toxic"], "true"),
    "vectors": ("embeddings", ["vec_id AS id", "embedding", "label"], "true"),
    "parts": ("part", ["p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_type AS type", "p_size AS size", "p_retailprice AS price"], "true"),
    "mutations": ("lineitem", ["CAST(l_partkey % 40 AS INT) AS gene", "l_suppkey AS sample", "CASE l_returnflag WHEN 'R' THEN 'Missense' WHEN 'A' THEN 'Nonsense' ELSE 'Silent' END AS class"], "true"),
    "suppliers": ("supplier", ["s_suppkey AS sample", "s_nationkey AS nation", "s_acctbal AS balance"], "true"),
}

#: Stand-ins made from others by SQL that both read.
DERIVED: dict[str, str] = {
    "counts": "SELECT feature, sample, CAST(sum(k) AS BIGINT) AS n, sample < 6 AS is_case, sample % 2 AS batch FROM {counts_raw} GROUP BY feature, sample",
    "cells": "SELECT o.cell AS cell, l.gene AS gene, CAST(sum(l.k) AS BIGINT) AS n FROM {lines} l JOIN {cell_rows} o ON l.orderkey = o.orderkey GROUP BY o.cell, l.gene",
    "calls": "SELECT site, sample, min_by(gt, k) AS gt, min_by(gq, k) AS gq, min_by(ref_depth, k) AS ref_depth, min_by(alt_depth, k) AS alt_depth FROM {genotypes} GROUP BY site, sample",
    "gwas2": "SELECT v.snp AS snp, CASE WHEN v.snp % 3 = 0 THEN v.a2 WHEN v.snp % 3 = 1 THEN translate(v.a1, 'ACGT', 'TGCA') ELSE v.a1 END AS a1, CASE WHEN v.snp % 3 = 0 THEN v.a1 WHEN v.snp % 3 = 1 THEN translate(v.a2, 'ACGT', 'TGCA') ELSE v.a2 END AS a2, x.b AS beta, CAST(0.02 + v.size / 2000.0 AS DOUBLE) AS se, v.maf AS maf FROM {gwas1} v JOIN (SELECT partkey, avg(discount) - 0.05 AS b FROM {lines} GROUP BY partkey) x ON x.partkey = v.snp",
    "scored": "SELECT d.id AS id, d.n_chars AS score, d.lang AS lang, l.quality AS label FROM {texts} d JOIN {labels} l ON d.id = l.id",
    "snvs": "SELECT chrom, pos, ref, alt, qual, filter, size, tenth FROM {variants} WHERE ref <> alt",
}


def sql_of(name: str) -> str:
    """A stand-in as a subquery for DuckDB."""
    if name in DERIVED:
        return f"({DERIVED[name].format_map(_Sql())})"
    table, exprs, where = STANDINS[name]
    return f"(SELECT {', '.join(exprs)} FROM {table} WHERE {where})"


class _Sql(dict):
    def __missing__(self, name: str) -> str:
        return sql_of(name)


def fill(text: str) -> str:
    """Replaces {name} by the stand-in's subquery; doubled braces are braces."""
    return text.format_map(_Sql())


class Views:
    """The stand-ins as DataFrames: ``views.reads`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            text, parts = DERIVED[name], {}
            for k in [*STANDINS, *DERIVED]:
                if "{" + k + "}" in text:
                    parts[k] = getattr(self, k)
            return self.spark.sql(text, **parts)
        if name not in STANDINS:
            raise AttributeError(name)
        table, exprs, where = STANDINS[name]
        return self.table(table).where(where).selectExpr(*exprs)
