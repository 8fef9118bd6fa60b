"""Peptide identification: target-decoy control, protein groups, libraries, motifs, spectra, consensus of replicates."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandloom.functions import tails
from strandloom.operators.components import components
from strandloom.operators.stats import adjust_p, quantiles, running_least
from strandloom.scratch import Scratch

#: Prefixes that mark a decoy, in any case: fixed values.
DECOY = "^(decoy_|rev_|xxx_)"


def is_decoy(protein: str = "protein") -> Column:
    return F.lower(protein).rlike(DECOY)


def target_decoy_q(df: DataFrame, *, scan: str = "scan", score: str = "score", protein: str = "protein", tie: str = "psm") -> DataFrame:
    """Best match per scan with q: (decoys + 1) / max(targets, 1) at its score or better, then the least from there down. No decoys at all is an error."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(scan).orderBy(F.col(score).desc(), tie))).where("_r = 1").drop("_r").withColumn("decoy", is_decoy(protein))
    if df.where(is_decoy(protein)).isEmpty():
        raise ValueError("no decoys in the table")
    sums = {"_d": F.col("decoy").cast("int"), "_t": (~F.col("decoy")).cast("int")}
    return running_least(best, score, sums, (F.col("_d") + 1) / F.greatest("_t", F.lit(1)), out="q", value_out="fdr", descending=True).drop("_d", "_t")


def separate_search_q(targets: DataFrame, decoys: DataFrame, *, scan: str = "scan", score: str = "score") -> DataFrame:
    """q of targets from a decoy search of its own: pi0 = min(1, 2 x share of targets below the decoy median). No decoys, or a scan with several rows in one table, is an error."""
    mid = quantiles(decoys, score, [0.5])[0]
    if mid is None:
        raise ValueError("no decoys in the table")
    for name, d in (("targets", targets), ("decoys", decoys)):
        if not d.groupBy(scan).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: a scan has more than one row")
    p = targets.agg(F.least(F.lit(1.0), 2 * F.avg((F.col(score) < F.lit(mid)).cast("double"))).alias("pi0"))
    both = targets.select(score, F.lit(1).alias("_t"), F.lit(0).alias("_d")).unionByName(decoys.select(score, F.lit(0).alias("_t"), F.lit(1).alias("_d"))).groupBy(score).agg(F.sum("_t").alias("_t"), F.sum("_d").alias("_d"))
    value = F.least(F.lit(1.0), F.col("pi0") * F.col("d_above") / F.nullif("t_above", F.lit(0)))
    q = running_least(both.crossJoin(p), score, {"t_above": F.col("_t"), "d_above": F.col("_d")}, value, out="q", value_out="fdr", descending=True)  # one row
    return targets.join(q.select(score, "pi0", "fdr", "q"), score)


#: Cells per bandwidth, terms of the series, and the tail that the cut leaves out at most.
_CELLS, _TERMS, _TAIL = 4, 22, 1e-21


def _gauss_sums(batches, cells, moments, bandwidth, reach, score):
    """The rows of the batches with pep, from the moments of the cells near each score."""
    width = bandwidth / _CELLS
    for b in batches:
        x = b.column(b.schema.get_field_index(score)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        at, ok = np.floor(np.nan_to_num(x) / width).astype(np.int64), np.isfinite(x)
        dense = np.zeros((2, len(x)))
        for step in range(-reach, reach + 1):
            i = np.minimum(np.searchsorted(cells, at + step), len(cells) - 1)
            near = np.flatnonzero((cells[i] == at + step) & ok)
            if len(near):
                i = i[near]
                u = (x[near] - (cells[i] + 0.5) * width) / bandwidth
                value = np.zeros((2, len(near)))
                for k in range(_TERMS - 1, -1, -1):
                    value = value * u + moments[:, i, k]
                dense[:, near] += np.exp(-u * u / 2) * value
        pep = np.minimum(1.0, dense[0] / np.maximum(dense[1], 1e-9))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pep, mask=~ok)], names=[*b.schema.names, "pep"])


def posterior_error(df: DataFrame, *, score: str = "score", protein: str = "protein", bandwidth: float = 0.3, block: int = 50_000) -> DataFrame:
    """Adds pep: the Gaussian-smoothed density of decoys over that of targets at a row's score (at least 1e-9), at most 1. Scores that are null or not finite have none.

    Give it the best match per scan. The sums run over all pairs of scores, but
    not pair by pair: scores fall into cells of a quarter bandwidth, and with u
    the distance of a score from a cell's middle and v that of one in the cell
    (in bandwidths), exp(-(u - v)^2 / 2) = exp(-u^2 / 2) sum_k u^k (exp(-v^2 / 2) v^k / k!),
    so a cell is summed up by the bracket for k below 22. Cells farther off than
    the cut are left out. Of n rows the cut leaves out 1e-21 at most, and as
    u v <= 1.5 up to 12 bandwidths, the series less than 1e-16 of a sum, so pep
    is the exact sum's to about 1e-12. Cells go to the tasks in blocks of
    ``block`` occupied ones with their neighbours, each for the rows of its range.
    """
    width = bandwidth / _CELLS
    s = Scratch(df.sparkSession, "posterior")
    d = s.saved(df, "rows", stays=True)
    x = F.col(score).cast("double")
    v = (x - (F.floor(x / width) + 0.5) * width) / bandwidth
    decoy = F.coalesce(is_decoy(protein), F.lit(False))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    rows = d.where(finite).select(F.floor(x / width).alias("cell"), decoy.alias("decoy"), v.alias("v"), F.exp(-v * v / 2).alias("w"))
    sums = [F.sum(F.when(side, F.col("w") * F.pow("v", F.lit(k)) / float(math.factorial(k))).otherwise(0.0)).alias(f"{name}{k}") for name, side in (("d", F.col("decoy")), ("t", ~F.col("decoy"))) for k in range(_TERMS)]
    cells = s.saved(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sums), "cells")
    total, occupied = cells.agg(F.sum("n"), F.count(F.lit(1))).first()
    schema = StructType([*d.schema.fields, StructField("pep", DoubleType())])
    if not occupied:
        return d.withColumn("pep", F.lit(None).cast("double"))
    reach = math.ceil(_CELLS * math.sqrt(2 * math.log(total / _TAIL))) + 1
    n = -(-occupied // block)
    cuts = sorted({int(c) for c in quantiles(cells, "cell", [k / n for k in range(1, n)])}) if n > 1 else []
    out, at = None, F.floor(x / width)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        mine, near = finite, F.lit(True)
        if lo is not None:
            mine, near = mine & (at >= lo), near & (F.col("cell") >= lo - reach)
        if hi is not None:
            mine, near = mine & (at < hi), near & (F.col("cell") < hi + reach)
        held = cells.where(near).orderBy("cell").collect()
        known = np.array([r.cell for r in held], np.int64)
        moments = np.array([[[r[f"{c}{k}"] for k in range(_TERMS)] for r in held] for c in "dt"])
        rest = ~F.coalesce(finite, F.lit(False)) if lo is None else F.lit(False)
        part = d.where(rest | mine).mapInArrow(partial(_gauss_sums, cells=known, moments=moments, bandwidth=bandwidth, reach=reach, score=score), schema)
        out = part if out is None else out.unionByName(part)
    s.close()
    return out


def collapse_proteins(df: DataFrame, *, peptide: str = "peptide", protein: str = "protein") -> DataFrame:
    """Proteins with equal sets of observed peptides as one group: members in order, the first as its name, its peptides and their number."""
    sets = df.groupBy(protein).agg(F.array_sort(F.collect_set(peptide)).alias("peptides"))
    g = sets.groupBy("peptides").agg(F.array_sort(F.collect_list(protein)).alias("members"))
    return g.select(F.col("members")[0].alias("name"), "members", "peptides", F.size("peptides").alias("n_peptides"))


def protein_components(nodes: DataFrame) -> DataFrame:
    """(name, component): groups that share peptides, directly or through others; each peptide ties its groups to the least name."""
    links = nodes.select("name", F.explode("peptides").alias("peptide"))
    least = links.groupBy("peptide").agg(F.min("name").alias("least"))
    return components(links.join(least, "peptide"), nodes, a="name", b="least", key="name")


def _cover(pdf: pd.DataFrame) -> pd.DataFrame:
    left = {r.name: set(r.peptides) for r in pdf.itertuples(index=False)}
    size = {k: len(v) for k, v in left.items()}
    out, covered, order = [], set(), 0
    while True:
        best = min(((-len(v - covered), -size[k], k) for k, v in left.items()), default=None)
        if best is None or best[0] == 0:
            break
        order += 1
        k = best[2]
        out.append((k, pdf["component"].iloc[0], True, order, -best[0]))
        covered |= left.pop(k)
    return pd.DataFrame(out + [(k, pdf["component"].iloc[0], False, None, 0) for k in sorted(left)], columns=["name", "component", "selected", "pick", "new_peptides"])


def _cover_in_rounds(s: Scratch, nodes: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """The greedy cover by joins: a group that is best among all that share a new peptide with it is picked before any of them, so all such groups are picked at once."""
    links = s.saved(nodes.select("name", "component", F.size("peptides").alias("size"), F.explode("peptides").alias("peptide")), "links")
    left, picked = links, None
    for _ in range(most_rounds):
        gain = left.groupBy("name", "component", "size").agg(F.count(F.lit(1)).alias("gain"))
        rank = s.saved(gain.withColumn("rank", F.struct((-F.col("gain")).alias("a"), (-F.col("size")).alias("b"), F.col("name").alias("c"))), "gain")
        if rank.isEmpty():
            break
        own = left.join(rank.select("name", "rank"), "name")
        best = own.groupBy("peptide").agg(F.min("rank").alias("best"))
        beaten = own.join(best, "peptide").where("rank <> best").select("name").distinct()
        now = s.saved(rank.join(beaten, "name", "left_anti").drop("rank"), "picked")
        picked = now if picked is None else picked.unionByName(now)
        gone = left.join(now.select("name"), "name", "left_semi").select("peptide").distinct()
        left = s.saved(left.join(gone, "peptide", "left_anti"), "left")
    else:
        raise RuntimeError("the cover did not end")
    w = Window.partitionBy("component").orderBy(F.col("gain").desc(), F.col("size").desc(), "name")
    out = nodes.select("name", "component")
    if picked is None:
        return out.select("name", "component", F.lit(False).alias("selected"), F.lit(None).cast("int").alias("pick"), F.lit(0).alias("new_peptides"))
    picked = picked.withColumn("pick", F.row_number().over(w)).select("name", "pick", F.col("gain").cast("int").alias("new_peptides"))
    j = out.join(picked, "name", "left")
    return s.saved(j.select("name", "component", F.col("pick").isNotNull().alias("selected"), "pick", F.coalesce("new_peptides", F.lit(0)).alias("new_peptides")), "cover", stays=True)


def parsimony_groups(nodes: DataFrame, *, task_links: int = 500_000) -> DataFrame:
    """Greedy cover per component: the group with most new peptides, then the larger, then by name; the rest is dropped.

    Components never compete: one of at most ``task_links`` peptide links is
    covered in a task, larger ones in rounds of joins with the same result.
    """
    s = Scratch(nodes.sparkSession, "parsimony")
    x = s.saved(nodes.join(protein_components(nodes), "name").select("name", "component", "peptides"), "nodes", stays=True)
    size = s.saved(x.groupBy("component").agg(F.sum(F.size("peptides")).alias("links")), "sizes", stays=True)
    few, many = (x.join(size.where(c).select("component"), "component", "left_semi") for c in (F.col("links") <= task_links, F.col("links") > task_links))
    out = few.groupBy("component").applyInPandas(_cover, "name string, component string, selected boolean, pick int, new_peptides int")
    if not size.where(F.col("links") > task_links).isEmpty():
        out = out.unionByName(_cover_in_rounds(s, many))
    s.close()
    return out


def picked_group_fdr(df: DataFrame, *, accessions: str = "accessions", score: str = "score", prefix: str = "DECOY_") -> DataFrame:
    """Target groups with q: of a target and its decoy (equal accessions without the prefix) the better stays; fdr = decoys / targets (no +1; 1 before the first target), least from there down, 1 at most.

    A group is a decoy if all its accessions are; no decoys at all is an error.
    """
    base = F.array_sort(F.array_distinct(F.transform(accessions, lambda a: F.replace(a, F.lit(prefix), F.lit("")))))
    decoy = F.forall(accessions, lambda a: a.startswith(prefix))
    d = df.withColumn("_base", base).withColumn("decoy", decoy)
    if df.where(decoy).isEmpty():
        raise ValueError(f"no decoy groups with prefix {prefix!r}")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_base").orderBy(F.col(score).desc(), "decoy"))).where("_r = 1").drop("_r", "_base")
    sums = {"_d": F.col("decoy").cast("int"), "_t": (~F.col("decoy")).cast("int")}
    value = F.when(F.col("_t") > 0, F.col("_d") / F.col("_t")).otherwise(1.0)
    return running_least(d, score, sums, value, out="q", value_out="fdr", descending=True).withColumn("q", F.least(F.lit(1.0), F.col("q"))).where("not decoy").drop("_d", "_t", "decoy")


def merge_libraries(df: DataFrame, *, transition: list[str], precursor: list[str], intensity: str = "intensity", library: str = "library") -> DataFrame:
    """One row per transition: that of the library whose precursor has the largest total intensity (ties by library)."""
    t = df.groupBy(library, *precursor).agg(F.sum(intensity).alias("_t"))
    w = Window.partitionBy(*transition).orderBy(F.col("_t").desc(), library, F.col(intensity).desc())
    return df.join(t, [library, *precursor]).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_t")


def library_stats(library: DataFrame, *, precursor: list[str], protein: str = "protein") -> DataFrame:
    """One row of a merged library: precursors, proteins, transitions, and transitions per precursor to one decimal."""
    d = library.agg(F.count_distinct(F.struct(*precursor)).alias("precursors"), F.count_distinct(protein).alias("proteins"), F.count(F.lit(1)).alias("transitions"))
    return d.withColumn("transitions_per_precursor", F.round(F.col("transitions") / F.nullif("precursors", F.lit(0)), 1))


def motif_enrichment(foreground: DataFrame, background: DataFrame, *, window: str = "window") -> DataFrame:
    """Per (offset, residue) of foreground windows (odd length, site in the middle): counts against all residues at that offset in foreground and background, Fisher's one-sided p, BH. Offset 0 and '_' or 'X' are left out."""

    def residues(t: DataFrame, name: str) -> DataFrame:
        x = t.select(F.posexplode(F.split(window, "")).alias("_p", "residue"), F.length(window).alias("_n")).withColumn("offset", F.col("_p") - F.floor(F.col("_n") / 2).cast("int"))
        return x.where((F.col("offset") != 0) & ~F.col("residue").isin("_", "X", "")).groupBy("offset", "residue").agg(F.count(F.lit(1)).alias(name))

    fg, bg = residues(foreground, "fg"), residues(background, "bg")
    j = fg.join(bg, ["offset", "residue"], "left").fillna(0, ["bg"])
    j = j.join(fg.groupBy("offset").agg(F.sum("fg").alias("fg_total")), "offset").join(bg.groupBy("offset").agg(F.sum("bg").alias("bg_total")), "offset", "left").fillna(0, ["bg_total"])
    p = tails.hypergeom_p("fg", F.col("fg_total") + F.col("bg_total"), F.col("fg") + F.col("bg"), "fg_total")
    return adjust_p(j.select("offset", "residue", "fg", "fg_total", "bg", "bg_total", p.alias("p")))


def match_spectra(query: DataFrame, library: DataFrame, *, tolerance: float = 0.01, least_peaks: int = 6, least_score: float = 0.7, tie: float = 0.02) -> DataFrame:
    """Cosine of long peak tables (spectrum, mz, intensity) over peaks within the tolerance, one to one; matches near the best are kept.

    Peaks meet in buckets of the tolerance and their neighbours. Pairs of peaks
    are taken by their product, largest first, each peak once; a pair of
    spectra has at most their peaks as candidates.
    """
    q = query.select(F.col("spectrum").alias("q"), F.col("mz").alias("qm"), F.col("intensity").alias("qi")).withColumn("_b", F.floor(F.col("qm") / tolerance))
    x = library.select(F.col("spectrum").alias("l"), F.col("mz").alias("lm"), F.col("intensity").alias("li")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("lm") / tolerance) + k for k in (-1, 0, 1)])))
    j = q.join(x, "_b").where(F.abs(F.col("qm") - F.col("lm")) <= tolerance)
    j = j.groupBy("q", "l").agg(F.array_sort(F.collect_list(F.struct((-F.col("qi") * F.col("li")).alias("w"), "lm", "qm"))).alias("_p"))
    none = F.array().cast("array<struct<w:double,lm:double,qm:double>>")
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["lm"] == x["lm"]) | (k["qm"] == x["qm"]))
    pair = lambda x: F.struct(x["w"].cast("double").alias("w"), x["lm"].cast("double").alias("lm"), x["qm"].cast("double").alias("qm"))
    j = j.withColumn("_k", F.aggregate("_p", none, lambda kept, x: F.when(free(kept, x), F.array_append(kept, pair(x))).otherwise(kept)))
    j = j.select("q", "l", F.size("_k").cast("long").alias("peaks"), F.aggregate("_k", F.lit(0.0), lambda a, k: a - k["w"]).alias("_s"))
    nq = query.groupBy(F.col("spectrum").alias("q")).agg(F.sqrt(F.sum(F.col("intensity") * F.col("intensity"))).alias("_nq"))
    nl = library.groupBy(F.col("spectrum").alias("l")).agg(F.sqrt(F.sum(F.col("intensity") * F.col("intensity"))).alias("_nl"))
    s = j.join(nq, "q").join(nl, "l")
    s = s.select("q", "l", "peaks", (F.col("_s") / (F.col("_nq") * F.col("_nl"))).alias("score")).where((F.col("peaks") >= least_peaks) & (F.col("score") >= least_score))
    return s.withColumn("_m", F.max("score").over(Window.partitionBy("q"))).where(F.col("score") >= F.col("_m") - tie).drop("_m")


def kinase_activity(sites: DataFrame, prior: DataFrame, *, least: int = 2) -> DataFrame:
    """z per kinase = (mean of its sites - mean of all) sqrt(m) / sd of all, over finite values; sites (gene, residue, value), prior (kinase, gene, residue).

    Values that are equal up to rounding (1e-12 of their size) have no spread:
    z, p and q are null.
    """
    s = sites.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    g = s.join(prior.distinct(), ["gene", "residue"]).groupBy("kinase").agg(F.count(F.lit(1)).alias("m"), F.avg("value").alias("mean")).where(F.col("m") >= least)
    varied = F.max("value") - F.min("value") > 1e-12 * F.max(F.abs("value"))
    g = g.crossJoin(s.agg(F.avg("value").alias("_a"), F.when(varied, F.stddev_samp("value")).alias("_s")))  # one row
    g = g.select("kinase", "m", "mean", ((F.col("mean") - F.col("_a")) * F.sqrt("m") / F.col("_s")).alias("z"))
    return adjust_p(g.withColumn("p", tails.norm_two_sided("z")))


def consensus_assignments(replicates: list[DataFrame], *, read: str = "read", site: list[str], pair: list[str], expressed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, excluded with the reason, pair totals): a read is accepted if every replicate gives it one assignment, the same one, of an expressed pair."""
    k = len(replicates)
    every = None
    for i, r in enumerate(replicates):
        t = r.select(read, *site, *pair).withColumn("_rep", F.lit(i))
        every = t if every is None else every.unionByName(t)
    what = F.struct(*site, *pair)
    g = every.groupBy(read).agg(F.count_distinct("_rep").alias("support"), F.count_distinct(what).alias("_n"), F.min(what).alias("_w"), F.count(F.lit(1)).alias("_rows"))
    reason = F.when(F.col("support") < k, "missing in a replicate").when(F.col("_n") > 1, "unstable").when(F.col("_rows") > k, "repeated")
    g = g.withColumn("reason", reason).select(read, "support", "reason", *[F.col(f"_w.{c}").alias(c) for c in [*site, *pair]])
    if expressed is not None:
        e = expressed.select(*pair).distinct().withColumn("_e", F.lit(True))
        g = g.join(F.broadcast(e) if expressed.count() < 1_000_000 else e, pair, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_e").isNull(), "not expressed"))).drop("_e")
    ok = g.where("reason is null").drop("reason")
    totals = ok.groupBy(*pair).agg(F.count(F.lit(1)).alias("reads"), F.count_distinct(F.struct(*site)).alias("sites"))
    return ok, g.where("reason is not null"), totals


#: Monoisotopic residue masses, water and proton (Da): fixed values of published tables.
RESIDUE_MASS = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER, PROTON = 18.010565, 1.007276


def fragment_transitions(peptides: DataFrame, *, sequence: str = "sequence", charge: str = "charge", most: int = 6) -> DataFrame:
    """One row per singly charged y-ion, y1 to y6 at most, of a peptide and its precursor charge: series number, fragment, m/z, precursor m/z, intensity, group id and annotation. Unknown residues give null m/z, empty sequences no row."""
    mass = F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])
    total = lambda s: F.aggregate(F.filter(F.split(s, ""), lambda r: r != ""), F.lit(WATER), lambda a, r: a + F.element_at(mass, r))
    numbers = F.sequence(F.lit(1), F.least(F.lit(most), F.length(sequence)))
    d = peptides.where(F.length(sequence) > 0).withColumn("precursor_mz", (total(sequence) + F.col(charge) * PROTON) / F.col(charge))
    d = d.withColumn("number", F.explode(numbers)).withColumn("fragment", F.right(sequence, F.col("number")))
    d = d.withColumn("mz", total("fragment") + PROTON).withColumn("intensity", 1000.0 / F.col("number"))
    return d.withColumn("group_id", F.concat_ws("_", sequence, charge)).withColumn("annotation", F.concat(F.lit("y"), F.col("number"), F.lit("^1")))


def reciprocal_best_hits(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs (query, subject) that are each other's best by bit score; ties go to the first subject."""

    def best(t: DataFrame) -> DataFrame:
        return t.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("bitscore").desc(), "subject"))).where("_r = 1")

    b = best(backward).select(F.col("query").alias("subject"), F.col("subject").alias("query"), F.col("bitscore").alias("back_bitscore"))
    return best(forward).select("query", "subject", "bitscore").join(b, ["query", "subject"])


def top_hits(df: DataFrame, *, coverage: float = 80.0, n: int = 1) -> DataFrame:
    """The best n hits of each query by bit score with coverage enough; ties by subject."""
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bitscore").desc(), "subject"))
    return df.where(F.col("coverage") >= coverage).withColumn("rank", r).where(F.col("rank") <= n)


def domain_clan_join(hits: DataFrame, clans: DataFrame) -> DataFrame:
    """Domain hits with the clan of their accession (without its version); none is No_clan."""
    d = hits.withColumn("accession", F.split("accession", r"\.")[0])
    return d.join(clans, "accession", "left").withColumn("clan", F.coalesce("clan", F.lit("No_clan")))


def consensus_methods(tables: dict[str, tuple[DataFrame, Column]], *, gene: str = "gene") -> DataFrame:
    """Per gene: whether each method calls it (missing is not a hit) and how many do."""
    out, total = None, F.lit(0)
    for name, (t, cond) in tables.items():
        hit = t.groupBy(gene).agg(F.max(cond).alias(name))
        out = hit if out is None else out.join(hit, gene, "full")
    for name in tables:
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
        total = total + F.col(name).cast("int")
    return out.withColumn("n_methods", total)


def method_overlap(hits: DataFrame, methods: list[str], *, alpha: float = 0.05) -> DataFrame:
    """Per pair of methods of ``consensus_methods``: a, b, genes, hits_a, hits_b, shared, expected, p and enriched.

    p is the hypergeometric chance of as large an overlap. Methods of one
    comparison overlap by more than chance; a pair that doesn't should be
    checked before its consensus is trusted. Pairs with a method without hits
    are left out.
    """
    n = F.count_if
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("genes"), n(F.col(a)).alias("hits_a"), n(F.col(b)).alias("hits_b"), n(F.col(a) & F.col(b)).alias("shared")) for a, b in pairs]
    d = hits.agg(F.array(*each).alias("p")).select(F.inline("p")).where("hits_a > 0 and hits_b > 0")
    d = d.withColumn("expected", F.col("hits_a") * F.col("hits_b") / F.col("genes")).withColumn("p", tails.hypergeom_p("shared", "genes", "hits_a", "hits_b"))
    return d.withColumn("enriched", F.col("p") <= alpha)


def extract_umi(first: DataFrame, second: DataFrame, *, length: int) -> DataFrame:
    """Reads of ``first`` with the first bases of their mate appended to the name; a mate that is too short or missing is an error row (umi null)."""
    m = second.select("read", F.when(F.length("seq") >= length, F.substring("seq", 1, length)).alias("umi"))
    return first.join(m, "read", "left").withColumn("name", F.when(F.col("umi").isNotNull(), F.concat_ws("_", "read", "umi")))
