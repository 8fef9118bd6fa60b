"""Sequences and alignments: summaries, columns, weights, codons, guide sites; and similarity of bit sets."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators.stats import adjust_p, quantiles, ranked
from strandloom.scratch import Scratch

#: The standard genetic code in the order TCAG of each base: a fixed value.
BASES, CODE = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def sequence_summary(df: DataFrame, files: DataFrame | None = None, *, file: str = "file", seq: str = "seq") -> DataFrame:
    """Per file: records, bases, shortest, longest, mean; a listed file without records has zeros."""
    n = F.length(seq)
    g = df.groupBy(file).agg(F.count(F.lit(1)).alias("records"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"))
    return g if files is None else files.select(file).distinct().join(g, file, "left").fillna(0)


def columns(df: DataFrame, *, key: str = "id", seq: str = "seq") -> DataFrame:
    """(id, col, residue) of aligned rows, residues in upper case, '.' as '-'."""
    return df.select(key, F.posexplode(F.split(F.translate(F.upper(seq), ".", "-"), "")).alias("col", "residue")).where("residue <> ''")


def gap_statistics(df: DataFrame, *, key: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Gaps per row and per column, with shares."""
    c = columns(df, key=key, seq=seq)
    gap = F.col("residue") == "-"
    per = lambda k: c.groupBy(k).agg(F.count_if(gap).alias("gaps"), F.avg(gap.cast("double")).alias("gap_share"))
    return per(key), per("col")


def filter_sequences(df: DataFrame, *, pattern: str = ".*", max_gap: float = 0.5, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows whose id matches, with gaps few enough; of equal sequences (case and '.' aside) the first id stays."""
    s = F.translate(F.upper(seq), ".", "-")
    gaps = (F.length(s) - F.length(F.translate(s, "-", ""))) / F.nullif(F.length(s), F.lit(0))
    d = df.where(F.col(key).cast("string").rlike(pattern) & (gaps <= max_gap)).withColumn("_s", F.sha2(s, 256))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key))).where("_r = 1").drop("_s", "_r")


def consensus_sequence(df: DataFrame, *, least: float = 0.5, ambiguous: str = "X", key: str = "id", seq: str = "seq") -> DataFrame:
    """Per column: the commonest residue (of equal ones that of the row with the least key), its share of all rows, and the consensus letter ('ambiguous' below the share). Gaps are in the denominator only."""
    c = columns(df, key=key, seq=seq)
    n = c.groupBy("col").agg(F.count(F.lit(1)).alias("rows"))
    r = c.where("residue <> '-'").groupBy("col", "residue").agg(F.count(F.lit(1)).alias("k"), F.min(key).alias("first"))
    best = r.groupBy("col").agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "residue")).alias("_b"))
    d = n.join(best, "col", "left").select("col", F.col("_b.residue").alias("residue"), (F.coalesce(-F.col("_b.k"), F.lit(0)) / F.col("rows")).alias("share"))
    return d.withColumn("consensus", F.when(F.col("residue").isNull(), "-").when(F.col("share") >= least, F.col("residue")).otherwise(ambiguous))


def join_columns(df: DataFrame, *, letter: str = "consensus") -> DataFrame:
    """A sequence from its columns in order; one string per alignment."""
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", letter))), lambda x: x[letter]), "").alias("seq"))


def conserved_positions(df: DataFrame, *, least: float = 0.9, **how) -> DataFrame:
    """Columns whose commonest residue reaches the share of all rows."""
    return consensus_sequence(df, **how).where(F.col("share") >= least).select("col", "residue", "share")


def conservation_profile(df: DataFrame, *, occupancy: float = 0.5, half: int = 5, **how) -> DataFrame:
    """Per column: conservation (commonest over non-gap rows; null where too few rows have a residue) and its moving mean, nulls skipped."""
    c = columns(df, **how)
    r = c.groupBy("col", "residue").agg(F.count(F.lit(1)).alias("k"))
    g = r.groupBy("col").agg(F.sum("k").alias("_n"), F.sum(F.when(F.col("residue") != "-", F.col("k")).otherwise(0)).alias("_r"), F.max(F.when(F.col("residue") != "-", F.col("k"))).alias("_m"))
    g = g.select("col", F.when(F.col("_r") / F.col("_n") >= occupancy, F.col("_m") / F.nullif("_r", F.lit(0))).alias("conservation"))
    return g.withColumn("smoothed", F.avg("conservation").over(Window.orderBy("col").rowsBetween(-half, half)))  # one row per column


def column_entropy(df: DataFrame, **how) -> DataFrame:
    """Entropy in bits per column over residues, gaps aside."""
    c = columns(df, **how).where("residue <> '-'")
    r = c.groupBy("col", "residue").agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy("col"))
    return r.withColumn("_p", p).groupBy("col").agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def information_content(df: DataFrame, *, letters: int = 4, **how) -> DataFrame:
    """log2(letters) minus the entropy."""
    return column_entropy(df, **how).withColumn("information", F.log2(F.lit(float(letters))) - F.col("entropy"))


def _grid(df: DataFrame, background: dict[str, float], **how) -> DataFrame:
    c = columns(df, **how)
    letters = df.sparkSession.createDataFrame(sorted(background.items()), "residue string, q double")
    k = c.groupBy("col", "residue").agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy("col").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("residue") == "-").alias("gaps"), F.count_if(F.col("residue").isin(list(background))).alias("n"))
    return g.crossJoin(F.broadcast(letters)).join(k, ["col", "residue"], "left").fillna(0, ["k"])  # columns by an alphabet


def jsd_conservation(df: DataFrame, background: dict[str, float], *, half: int = 3, weight: float = 0.5, **how) -> DataFrame:
    """Divergence of each column from the background (bits), times the share of rows without a gap, mixed with the mean of its neighbours. A column without letters of the background has 0."""
    d = _grid(df, background, **how).withColumn("p", F.col("k") / F.nullif("n", F.lit(0))).withColumn("m", (F.col("p") + F.col("q")) / 2)
    t = lambda x: F.when(x > 0, x * F.log2(x / F.col("m"))).otherwise(0.0)
    g = d.groupBy("col", "rows", "gaps", "n").agg((F.sum(t(F.col("p")) + t(F.col("q"))) / 2).alias("_j")).select("col", F.when(F.col("n") > 0, F.col("_j") * (1 - F.col("gaps") / F.col("rows"))).otherwise(0.0).alias("jsd"))
    w = Window.orderBy("col")  # one row per column
    s = lambda a, b: F.coalesce(F.sum("jsd").over(w.rowsBetween(a, b)), F.lit(0.0))
    n = lambda a, b: F.count("jsd").over(w.rowsBetween(a, b))
    around = (s(-half, -1) + s(1, half)) / F.nullif(n(-half, -1) + n(1, half), F.lit(0))
    return g.withColumn("smoothed", weight * F.col("jsd") + (1 - weight) * F.coalesce(around, F.col("jsd")))


def pssm(df: DataFrame, background: dict[str, float], *, pseudo: float = 1.0, **how) -> DataFrame:
    """(col, residue, log_odds) in bits, the pseudocount spread over the background."""
    d = _grid(df, background, **how)
    return d.select("col", "residue", F.log2((F.col("k") + pseudo * F.col("q")) / (F.col("n") + pseudo) / F.col("q")).alias("log_odds"))


def score_site(sites: DataFrame, matrix: DataFrame, *, key: str = "id", seq: str = "seq") -> DataFrame:
    """Sum of a site's log-odds."""
    return columns(sites, key=key, seq=seq).join(matrix, ["col", "residue"]).groupBy(key).agg(F.sum("log_odds").alias("score"))


def substitution_counts(df: DataFrame, **how) -> DataFrame:
    """Unordered pairs of different residues over all columns, n_a * n_b each, with ti / tv / other for bases."""
    c = columns(df, **how).where("residue <> '-'").groupBy("col", "residue").agg(F.count(F.lit(1)).alias("k"))
    a, b = (c.select("col", F.col("residue").alias(x), F.col("k").alias(f"_{x}")) for x in ("first", "second"))
    g = a.join(b, "col").where("first < second").groupBy("first", "second").agg(F.sum(F.col("_first") * F.col("_second")).alias("n"))
    p = F.concat("first", "second")
    return g.withColumn("kind", F.when(p.isin("AG", "CT"), "ti").when(p.rlike("^[ACGT]{2}$"), "tv").otherwise("other"))


def pair_counts(df: DataFrame, *, key: str = "id", seq: str = "seq") -> DataFrame:
    """Per pair of rows: columns with residues in both, identical ones, and either sequence's residues. Pairs are the result: give it the rows to compare."""
    d = df.select(F.col(key).alias("k"), F.split(F.translate(F.upper(seq), ".", "-"), "").alias("s"))
    n = F.size(F.filter("s", lambda x: (x != "-") & (x != "")))
    d = d.withColumn("n", n)
    a, b = (d.select(F.col("k").alias(f"id_{x}"), F.col("s").alias(f"s{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    j = a.join(b, F.col("id_a") < F.col("id_b"))
    z = F.zip_with("sa", "sb", lambda x, y: F.when((x != "-") & (y != "-") & (x != "") & (y != ""), F.when(x == y, 2).otherwise(1)).otherwise(0))
    j = j.withColumn("_z", z)
    either = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: ((x != "-") & (x != "")) | ((y != "-") & (y != ""))), lambda v: v))
    return j.select("id_a", "id_b", "n_a", "n_b", F.size(F.filter("_z", lambda v: v > 0)).alias("both"), F.size(F.filter("_z", lambda v: v == 2)).alias("same"), either.alias("either"))


def pairwise_identity(df: DataFrame, **how) -> DataFrame:
    """Identity of pairs over four denominators: all columns with a residue (pid1), columns with both (pid2), the shorter sequence (pid3), the mean length (pid4); 0 / 0 is null."""
    c = pair_counts(df, **how)
    d = lambda x: F.col("same") / F.nullif(x, F.lit(0))
    return c.select("id_a", "id_b", "same", d(F.col("either")).alias("pid1"), d(F.col("both")).alias("pid2"), d(F.least("n_a", "n_b")).alias("pid3"), d((F.col("n_a") + F.col("n_b")) / 2).alias("pid4"))


def kimura_distance(df: DataFrame, **how) -> DataFrame:
    """-ln(1 - p - 0.2 p^2) over columns with both residues; infinite at p of 0.85 or more, null without columns."""
    c = pair_counts(df, **how).withColumn("p", 1 - F.col("same") / F.nullif("both", F.lit(0)))
    p = F.col("p")
    return c.select("id_a", "id_b", "p", F.when(p >= 0.85, float("inf")).when(p.isNotNull(), -F.log(F.when(p < 0.85, 1 - p - 0.2 * p * p))).alias("distance"))


def sequence_weights(df: DataFrame, *, key: str = "id", seq: str = "seq") -> DataFrame:
    """Henikoff weights: 1 / (kinds * rows with the residue) over columns without gaps, scaled to sum 1."""
    c = columns(df, key=key, seq=seq)
    full = c.groupBy("col").agg(F.count_if(F.col("residue") == "-").alias("_g"), F.count_distinct("residue").alias("_k")).where("_g = 0")
    r = c.groupBy("col", "residue").agg(F.count(F.lit(1)).alias("_n"))
    w = c.join(full, "col").join(r, ["col", "residue"]).groupBy(key).agg(F.sum(1 / (F.col("_k") * F.col("_n"))).alias("_w"))
    return w.select(key, (F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def neff(df: DataFrame, *, identity: float = 0.62, key: str = "id", seq: str = "seq") -> DataFrame:
    """Effective number of sequences: sum of 1 / (1 + neighbours at the identity over common columns)."""
    near = pairwise_identity(df, key=key, seq=seq).where(F.col("pid2") >= identity)
    k = near.select(F.col("id_a").alias(key)).unionByName(near.select(F.col("id_b").alias(key))).groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    return df.select(key).join(k, key, "left").agg(F.sum(1 / (1 + F.coalesce("_k", F.lit(0)))).alias("neff"), F.count(F.lit(1)).alias("rows"))


def apc_applicable(df: DataFrame, *, identity: float = 0.62, columns_over: int = 100, rows_over: float = 1.0, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row: alignment width, neff over it, and whether both are large enough for the product correction of ``mutual_information_apc``; else its mi is the column to read."""
    width = df.agg(F.max(F.length(seq)).alias("width"))
    per = F.col("neff") / F.col("width")
    return neff(df, identity=identity, key=key, seq=seq).crossJoin(width).select("width", per.alias("neff_per_column"), ((F.col("width") > columns_over) & (per > rows_over)).alias("ok"))  # one row each


#: Columns times letters of a block whose joint counts a task holds.
JOINT_CELLS = 4096


def _joint(batches, spans, codes):
    """(i, j, ri, rj, k): how often two columns of two blocks hold two letters in the rows of a task, i < j."""
    alphabet, total = np.array(codes, np.int64), None

    def one_hot(seqs: list[str], lo: int, hi: int) -> np.ndarray:
        text = "".join([s[lo:hi].ljust(hi - lo, "-") for s in seqs])
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(seqs), hi - lo)
        at = np.minimum(np.searchsorted(alphabet, x), len(alphabet) - 1)
        row, col = np.nonzero(alphabet[at] == x)
        m = np.zeros((len(seqs), (hi - lo) * len(alphabet)), np.float32)
        m[row, col * len(alphabet) + at[row, col]] = 1
        return m

    for b in batches:
        seqs = [s for s in b.column(0).to_pylist() if s]
        for k in range(0, len(seqs), 1024):
            x = one_hot(seqs[k : k + 1024], *spans[0])
            y = x if spans[0] == spans[1] else one_hot(seqs[k : k + 1024], *spans[1])
            c = (x.T @ y).astype(np.int64)
            total = c if total is None else total + c
    if total is None:
        return
    u, v = np.nonzero(total)
    n, chars = len(alphabet), np.array([chr(c) for c in codes])
    i, j = spans[0][0] + u // n, spans[1][0] + v // n
    keep = np.flatnonzero(i < j)
    for k in range(0, len(keep), 100_000):
        t = keep[k : k + 100_000]
        cols = [pa.array(i[t], pa.int32()), pa.array(j[t], pa.int32()), pa.array(chars[u[t] % n].tolist()), pa.array(chars[v[t] % n].tolist()), pa.array(total[u[t], v[t]], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "ri", "rj", "k"])


def joint_counts(df: DataFrame, *, seq: str = "seq", cells: int = JOINT_CELLS) -> DataFrame:
    """(i, j, ri, rj, k): rows with residue ri in column i and rj in column j, for all i < j and residues that occur together.

    Tasks multiply blocks of one-hot rows, so a task sends the counts of its
    column pairs once, not a row for each pair of columns of each sequence.
    Blocks of columns are as wide as ``cells`` allows; each pair of blocks is a
    pass over the rows.
    """
    d = df.select(F.translate(F.upper(seq), ".", "-").alias("s"))
    found = d.select(F.explode(F.array_distinct(F.split("s", ""))).alias("c")).distinct().where("c not in ('', '-')")
    codes = sorted(ord(r[0]) for r in found.collect())
    width = d.agg(F.max(F.length("s"))).first()[0] or 0
    out = df.sparkSession.createDataFrame([], "i int, j int, ri string, rj string, k long")
    step = max(1, cells // max(1, len(codes)))
    blocks = [(a, min(width, a + step)) for a in range(0, width, step)] if codes else []
    for x, one in enumerate(blocks):
        for other in blocks[x:]:
            out = out.unionByName(d.mapInArrow(partial(_joint, spans=(one, other), codes=codes), "i int, j int, ri string, rj string, k long"))
    return out.groupBy("i", "j", "ri", "rj").agg(F.sum("k").alias("k"))


def mutual_information_apc(df: DataFrame, *, least_rows: int = 20, seq: str = "seq", cells: int = JOINT_CELLS) -> DataFrame:
    """Mutual information (bits) of column pairs over rows with both residues, less the product of the columns' means over the overall mean."""
    s = Scratch(df.sparkSession, "mutual")
    p = joint_counts(df, seq=seq, cells=cells)
    w = lambda *cols: Window.partitionBy("i", "j", *cols)
    p = p.withColumn("n", F.sum("k").over(w())).withColumn("ki", F.sum("k").over(w("ri"))).withColumn("kj", F.sum("k").over(w("rj"))).where(F.col("n") >= least_rows)
    mi = s.saved(p.groupBy("i", "j", "n").agg(F.sum(F.col("k") / F.col("n") * F.log2(F.col("k") * F.col("n") / (F.col("ki") * F.col("kj")))).alias("mi")), "pairs", stays=True)
    one = mi.select(F.col("i").alias("c"), "mi").unionByName(mi.select(F.col("j").alias("c"), "mi")).groupBy("c").agg(F.avg("mi").alias("m"))
    x = mi.join(one.select(F.col("c").alias("i"), F.col("m").alias("mi_i")), "i").join(one.select(F.col("c").alias("j"), F.col("m").alias("mi_j")), "j").crossJoin(mi.agg(F.avg("mi").alias("_all")))  # one row
    return x.select("i", "j", "n", "mi", (F.col("mi") - F.col("mi_i") * F.col("mi_j") / F.nullif("_all", F.lit(0.0))).alias("mi_apc"))


def letters(seq: str | Column) -> Column:
    """The residues of an aligned row as an array, as ``columns`` gives them."""
    return F.filter(F.split(F.translate(F.upper(seq), ".", "-"), ""), lambda x: x != "")


def position_map(df: DataFrame, *, key: str = "id", seq: str = "seq") -> DataFrame:
    """(id, col, residue_index): index of the residue in its own sequence, -1 at gaps. Each row is read alone, without a shuffle."""
    d = df.select(key, letters(seq).alias("_s"))
    at = lambda want: F.filter(F.transform("_s", lambda x, i: F.when(want(x), i)), lambda i: i.isNotNull())
    place = lambda c, k: F.struct(c.alias("col"), k.alias("residue_index"))
    both = F.concat(F.transform(at(lambda x: x != "-"), lambda c, k: place(c, k)), F.transform(at(lambda x: x == "-"), lambda c: place(c, F.lit(-1))))
    return d.select(key, F.inline(both))


def mask_columns(df: DataFrame, *, max_gap: float = 0.5, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows without the columns whose gap share reaches the limit. One row with the column states, as long as the alignment is wide, goes to all rows."""
    share = columns(df, key=key, seq=seq).groupBy("col").agg((F.avg((F.col("residue") == "-").cast("double")) < max_gap).alias("_ok"))
    mask = share.agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "_ok"))), lambda x: x["_ok"]).alias("_mask"))
    kept = F.array_join(F.filter(letters(seq), lambda x, i: F.get("_mask", i)), "")
    return df.crossJoin(F.broadcast(mask)).select(key, F.coalesce(kept, F.lit("")).alias(seq))  # one row


def codons(seq: str | Column) -> Column:
    """Whole codons of a sequence in order."""
    return F.regexp_extract_all(F.upper(seq), F.lit(r"[\s\S]{3}"), F.lit(0))


#: Published genetic codes: codons that differ from the standard one, and start codons. Fixed values.
GENETIC_CODES: dict[int, tuple[dict[str, str], tuple[str, ...]]] = {
    1: ({}, ("TTG", "CTG", "ATG")),
    2: ({"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, ("ATT", "ATC", "ATA", "ATG", "GTG")),
    4: ({"TGA": "W"}, ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    11: ({}, ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
}


def genetic_code(table: int) -> tuple[dict[str, str], list[str], list[str]]:
    """Amino acids by codon, start codons and stop codons of a numbered code."""
    if table not in GENETIC_CODES:
        raise ValueError(f"unknown genetic code {table}: known are {sorted(GENETIC_CODES)}")
    other, starts = GENETIC_CODES[table]
    code = CODONS | other
    return code, list(starts), [k for k, v in code.items() if v == "*"]


def validate_cds(df: DataFrame, *, seq: str = "seq", table: int = 1, policy: str = "strict", require_start: bool = True, require_terminal_stop: bool = True, allow_internal_stops: bool = False) -> DataFrame:
    """Adds what a coding sequence is admitted with, or why it is refused.

    codons: those admitted, in order. discarded: (offset, segment, reason) of
    triplets with letters other than ACGT and of a remainder of one or two
    bases, which ``policy='permissive'`` leaves out and 'strict' refuses.
    start_ok, stop_ok, internal_stops (numbers of admitted codons from 0).
    refused: the first reason, null where ``accepted``. Null counts as empty;
    case doesn't matter.
    """
    if policy not in ("strict", "permissive"):
        raise ValueError("policy must be 'strict' or 'permissive'")
    _, starts, stops = genetic_code(table)
    d = df.withColumn("_raw", F.coalesce(F.upper(seq), F.lit(""))).withColumn("_all", codons(F.col("_raw")))
    pure = lambda c: c.isin(list(CODONS))
    plain = F.col("_raw").rlike("^[ACGT]*$")  # one look at the whole sequence spares one at each codon
    part = lambda at, text, why: F.struct(at.cast("int").alias("offset"), text.alias("segment"), F.lit(why).alias("reason"))
    odd = F.filter(F.transform("_all", lambda c, i: part(i * 3, c, "letters other than ACGT")), lambda x: ~pure(x.segment))
    rest = F.length("_raw") % 3
    tail = F.when(rest > 0, F.array(part(F.length("_raw") - rest, F.right("_raw", rest), "rest of one or two bases"))).otherwise(F.slice(odd, 1, 0))
    d = d.withColumn("codons", F.when(plain, F.col("_all")).otherwise(F.filter("_all", pure))).withColumn("discarded", F.concat(odd, tail))
    last = F.size("codons") - 1
    d = d.withColumn("start_ok", F.coalesce(F.get("codons", F.lit(0)).isin(starts), F.lit(False))).withColumn("stop_ok", F.coalesce(F.get("codons", last).isin(stops), F.lit(False)))
    at = F.transform("codons", lambda c, i: F.when(c.isin(stops) & (i < last), i))
    d = d.withColumn("internal_stops", F.filter(at, lambda i: i.isNotNull()))
    strict = F.lit(policy == "strict")
    why = (
        F.when(F.col("_raw") == "", "empty")
        .when(F.col("_raw").rlike(r"\s"), "white space")
        .when(strict & (rest > 0), "length is not divisible by three")
        .when(strict & (F.size(odd) > 0), "invalid codon")
        .when(F.size("codons") == 0, "no complete codons")
        .when(F.lit(require_start) & ~F.col("start_ok"), "no start codon")
        .when(F.lit(require_terminal_stop) & ~F.col("stop_ok"), "no stop codon")
        .when(F.lit(not allow_internal_stops) & (F.size("internal_stops") > 0), "internal stop")
    )
    return d.withColumn("refused", why).withColumn("accepted", F.col("refused").isNull()).drop("_raw", "_all")


def codon_usage(df: DataFrame, *, seq: str = "seq", by: list[str] | None = None, **validation) -> DataFrame:
    """Counts and frequencies of the admitted codons of the sequences that ``validate_cds`` accepts with these options; refused ones count for nothing."""
    by = by or []
    d = df.select(*by, F.col(seq).alias("_seq"))
    if validation.get("policy") == "permissive" and not validation.get("require_start", True) and not validation.get("require_terminal_stop", True) and validation.get("allow_internal_stops"):
        #: Nothing is asked of a sequence as a whole but that it has no white space, so its codons are looked at one by one.
        one = F.transform(F.array("_seq"), lambda x: F.when(~x.rlike(r"\s"), codons(x)))
        c = d.select(*by, F.explode(F.get(one, F.lit(0))).alias("codon")).where(F.col("codon").isin(list(CODONS)))
    else:
        c = validate_cds(d, seq="_seq", **validation).where("accepted").select(*by, F.explode("codons").alias("codon"))
    g = c.groupBy(*by, "codon").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))


def rscu(usage: DataFrame, *, rare: float = 0.5) -> DataFrame:
    """Relative synonymous usage: n over the amino acid's mean per codon; codons that don't occur have 0. Stops are left out."""
    code = usage.sparkSession.createDataFrame([(k, v) for k, v in CODONS.items() if v != "*"], "codon string, amino_acid string")
    d = code.join(usage, "codon", "left").fillna(0, ["n"])
    w = Window.partitionBy("amino_acid")
    r = F.col("n") * F.count(F.lit(1)).over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    return d.select("codon", "amino_acid", "n", r.alias("rscu")).withColumn("rare", F.col("rscu") < rare)


def find_pam_sites(df: DataFrame, *, key: str = "id", seq: str = "seq", guide: int = 20, least_gc: int = 6, most_gc: int = 14) -> DataFrame:
    """Guides of ACGT before NGG on both strands (overlaps included), with ``least_gc`` to ``most_gc`` G or C and no run of four T.

    id, strand, start (of guide and PAM together, from the left of the given
    strand), n (length of the sequence), guide, pam, gc (share).
    """
    more, tile = guide + 2, 1000

    def strand(text: Column, name: str) -> DataFrame:
        #: Tiles with the beginning of the next one, so that the work grows with the length.
        tiles = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{tile}}}"), F.lit(0))
        d = df.select(key, F.length(text).cast("long").alias("n"), tiles.alias("_t"))
        d = d.select(key, "n", F.posexplode(F.transform("_t", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("_t", i + 1), F.lit(more)), F.lit(""))))).alias("_k", "_s"))
        d = d.where(F.length("_s") > more).withColumn("i", F.explode(F.sequence(F.lit(0), F.length("_s") - more - 1)))
        d = d.withColumn("guide", F.substr(F.col("_s"), F.col("i") + 1, F.lit(guide))).withColumn("pam", F.substr(F.col("_s"), F.col("i") + guide + 1, F.lit(3))).withColumn("_at", F.col("_k") * tile + F.col("i"))
        start = F.col("_at") if name == "+" else F.col("n") - F.col("_at") - guide - 3
        return d.where(F.col("pam").rlike("^[ACGT]GG$") & F.col("guide").rlike("^[ACGT]+$") & (F.col("i") < tile)).select(key, F.lit(name).alias("strand"), start.cast("long").alias("start"), "n", "guide", "pam")

    s = F.upper(seq)
    both = strand(s, "+").unionByName(strand(F.translate(F.reverse(s), "ACGT", "TGCA"), "-"))
    gc = F.length("guide") - F.length(F.translate("guide", "GC", ""))
    return both.where(gc.between(least_gc, most_gc) & ~F.col("guide").contains("TTTT")).withColumn("gc", gc / guide)


def within_cds(sites: DataFrame, *, start: str = "start", length: str = "n", low: float = 0.05, high: float = 0.65) -> DataFrame:
    """Guides that start within a share of the coding sequence, ends included."""
    return sites.where((F.col(start) >= low * F.col(length)) & (F.col(start) <= high * F.col(length)))


def spaced_top_k(df: DataFrame, *, gene: str = "gene", start: str = "start", score: str = "score", k: int = 4, spacing: int = 5) -> DataFrame:
    """Up to k guides per gene, best first (ties by start), none closer than the spacing to a better one.

    ``k`` rounds take the best of what is left of every gene and drop what is
    too near to it, so a gene of any size is aggregated like others.
    """
    s = Scratch(df.sparkSession, "spaced")
    name = lambda c: F.col(f"`{c}`")
    row = F.struct(*[name(c) for c in df.columns])
    #: The best first: rising order of (minus score, start, rest), nulls last.
    rank = F.struct(name(score).isNull().alias("n"), (-name(score)).alias("s"), name(start).alias("a"), F.xxhash64(*[name(c) for c in df.columns]).alias("h"))
    left, out = s.saved(df.select(name(gene).alias("_g"), name(start).alias("_at"), rank.alias("_r"), row.alias("_row")), "left"), None
    for _ in range(k):
        best = s.saved(left.groupBy("_g").agg(F.min_by(F.struct("_at", "_row"), "_r").alias("_b")).select("_g", F.col("_b._at").alias("_taken"), F.col("_b._row").alias("_best")), "best", stays=True)
        out = best if out is None else out.unionByName(best)
        left = s.saved(left.join(best.drop("_best"), "_g").where(F.abs(F.col("_at") - F.col("_taken")) >= spacing).drop("_taken"), "left")
        if left.isEmpty():
            break
    s.close()
    return (out.select("_best.*") if out is not None else df.limit(0))


def transcript_to_genome(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """Genomic blocks of transcript-relative sites (site, transcript, t_start, t_stop) over exons (transcript, contig, strand, start, stop): site, contig, strand, blocks, covered (false: some bases lie outside), or no row for a missing transcript."""
    w = Window.partitionBy("transcript").orderBy(F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("stop")))
    e = exons.withColumn("_n", F.col("stop") - F.col("start")).withColumn("_z", F.sum("_n").over(w)).withColumn("_a", F.col("_z") - F.col("_n"))
    j = sites.join(e, "transcript").where((F.col("t_start") < F.col("_z")) & (F.col("t_stop") > F.col("_a")))
    a, z = F.greatest(F.col("t_start"), F.col("_a")) - F.col("_a"), F.least(F.col("t_stop"), F.col("_z")) - F.col("_a")
    plus = F.col("strand") == "+"
    b = F.struct(F.when(plus, F.col("start") + a).otherwise(F.col("stop") - z).alias("start"), F.when(plus, F.col("start") + z).otherwise(F.col("stop") - a).alias("stop"))
    g = j.groupBy("site", "transcript", "contig", "strand", "t_start", "t_stop").agg(F.array_sort(F.collect_list(b)).alias("blocks"), F.sum(z - a).alias("_c"))
    return g.select("site", "transcript", "contig", "strand", "blocks", (F.col("_c") == F.col("t_stop") - F.col("t_start")).alias("covered"))


def _each_with_each(a: DataFrame, b: DataFrame, group: int) -> DataFrame:
    """Every row of blocks ``a`` with every one of ``b``: a task holds at most about ``group`` rows of b and reads a's one by one, so nothing is written once more for each pair."""
    na, nb = max(1, a.count()), max(1, b.count())
    return a.repartition(min(na, 256)).hint("shuffle_replicate_nl").crossJoin(b.repartition(-(-nb // group)))


def _ones(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    m = np.zeros((rows, columns), np.float32)
    m[row, column] = 1
    return m


def _block_hits(batches, threshold, own):
    """Pairs at or above the threshold of rows (x, ids, n, s) by (y, ...): counts of shared bits as products of 0/1 matrices, 4,096 bits at a time."""
    for batch in batches:
        x, ids_a, n_a, s_a, y, ids_b, n_b, s_b = batch.columns
        for k in range(batch.num_rows):
            na, nb = (c[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (n_a, n_b))
            code = pc.dictionary_encode(pa.concat_arrays([s_a[k].values, s_b[k].values]), null_encoding="encode")
            cut, code = len(s_a[k].values), code.indices.to_numpy()
            kinds = int(code.max()) + 1 if len(code) else 0
            both = (np.bincount(code[:cut], minlength=kinds) > 0) & (np.bincount(code[cut:], minlength=kinds) > 0)
            number = np.cumsum(both) - 1
            ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
            ka, kb = both[code[:cut]], both[code[cut:]]
            ra, ca, rb, cb = ra[ka], number[code[:cut][ka]], rb[kb], number[code[cut:][kb]]
            shared = np.zeros((len(na), len(nb)), np.float32)
            for lo in range(0, int(both.sum()), 4096):
                wide = min(4096, int(both.sum()) - lo)
                ia, ib = ((c >= lo) & (c < lo + wide) for c in (ca, cb))
                shared += _ones(ra[ia], ca[ia] - lo, len(na), wide) @ _ones(rb[ib], cb[ib] - lo, len(nb), wide).T
            #: s / (a + b - s) >= t where s >= t / (1 + t) (a + b); a little below that in single precision, then exactly.
            least = threshold / (1 + threshold) * (1 - 1e-5)
            i, j = np.nonzero(shared >= (least * na - 1e-3).astype(np.float32)[:, None] + (least * nb).astype(np.float32)[None])
            n = np.rint(shared[i, j]).astype(np.int32)
            likeness = n / (na[i] + nb[j] - n)
            hit = (n > 0) & (likeness >= threshold)
            i, j, n, likeness = i[hit], j[hit], n[hit], likeness[hit]
            u, v = ids_a[k].values.take(pa.array(i)), ids_b[k].values.take(pa.array(j))
            if own:
                up = pc.less(u, v)
                turn = pc.greater(u, v) if x[k].as_py() != y[k].as_py() else pa.array(np.zeros(len(i), bool))
                u, v = pc.if_else(turn, v, u), pc.if_else(turn, u, v)
                keep = pc.or_(up, turn)
                u, v, n, likeness = (c.filter(keep) for c in (u, v, pa.array(n), pa.array(likeness)))
            yield pa.RecordBatch.from_arrays([u, v, pa.array(n), pa.array(likeness)], names=["id_a", "id_b", "shared", "similarity"])


def _tanimoto_by_blocks(s: Scratch, da: DataFrame, db: DataFrame, threshold: float, own: bool, block: int) -> DataFrame:
    def packed(d: DataFrame) -> DataFrame:
        size = d.agg(F.count(F.lit(1)), F.sum("n")).first()
        many = max(1, -(-size[0] // block), -(-(size[1] or 0) // 2_000_000))
        g = d.where("id is not null").groupBy(F.pmod(F.xxhash64("id", "s"), F.lit(many)).alias("x")).agg(F.collect_list(F.struct("id", "n", "s")).alias("r"))  # of bounded blocks
        return s.saved(g.select("x", F.col("r.id").alias("ids"), F.col("r.n").alias("n"), F.flatten("r.s").alias("s")), "blocks", stays=True)

    a = packed(da)
    b = (a if own else packed(db)).toDF("y", "ids_b", "n_b", "s_b")
    c = _each_with_each(a, b, 8)
    ka, kb = (d.schema["id"].dataType.simpleString() for d in (da, db))
    return (c.where("x <= y") if own else c).mapInArrow(partial(_block_hits, threshold=threshold, own=own), f"id_a {ka}, id_b {kb}, shared int, similarity double")


def tanimoto_pairs(a: DataFrame, b: DataFrame, *, threshold: float, key: str = "id", bits: str = "bits", own: bool = False, by_blocks: bool | None = None, block: int = 2048) -> DataFrame:
    """Pairs (id_a, id_b, shared, similarity) of bit sets at or above the threshold; ``own``: pairs within one table, each once.

    Sets are joined on the bits of a prefix, rarest bits first: sets that reach
    the threshold share a bit of their first n - ceil(t n) + 1. Sizes, and what
    can follow and precede the shared bit in both, bound the rest before pairs
    are made distinct; the similarity is computed from the arrays. Sets and
    prefixes are written once; within one table both sides read the same.

    Where the prefixes would join to more rows than a 32nd of all pairs (few
    bits, low thresholds), all pairs are compared instead, block by block of at
    most about ``block`` sets: bounded memory, and no row for a pair below the
    threshold. ``by_blocks`` fixes the choice; both give the same rows.
    """
    s = Scratch(a.sparkSession, "tanimoto")

    def sets(t: DataFrame) -> DataFrame:
        return s.saved(t.select(F.col(key).alias("id"), F.array_distinct(bits).alias("s")).withColumn("n", F.size("s")).where("n > 0"), "sets", stays=True)

    da = sets(a)
    db = da if own else sets(b)
    both = da.select(F.explode("s").alias("bit")) if own else da.select(F.explode("s").alias("bit")).unionByName(db.select(F.explode("s").alias("bit")))
    rank = s.saved(both.groupBy("bit").agg(F.count(F.lit(1)).alias("_df")), "ranks")

    def prefixes(d: DataFrame) -> DataFrame:
        e = d.select("id", "n", F.xxhash64("s").alias("mark"), F.explode("s").alias("bit")).join(rank, "bit")  # the mark tells unlike sets of one id apart
        e = e.withColumn("r", F.dense_rank().over(Window.partitionBy("id", "mark", "n").orderBy("_df", "bit")))
        return s.saved(e.where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("bit", "id", "n", "r"), "prefixes", stays=True)

    pa_ = prefixes(da)
    pb = pa_ if own else prefixes(db)
    if by_blocks is None:
        held = [p.groupBy("bit").agg(F.count(F.lit(1)).cast("double").alias(f"_{k}")) for k, p in enumerate((pa_, pb))]
        by_blocks = 32 * (held[0].join(held[1], "bit").agg(F.sum(F.col("_0") * F.col("_1"))).first()[0] or 0.0) > float(da.count()) * db.count()
    s.close()
    if by_blocks:
        return _tanimoto_by_blocks(s, da, db, threshold, own, block)
    named = lambda d, x: d.select(*[F.col(c).alias(c if c == "bit" else f"{c}_{x}") for c in d.columns])
    na, nb, t = F.col("n_a"), F.col("n_b"), F.lit(threshold)
    reach = F.least("r_a", "r_b") + F.least(na - F.col("r_a"), nb - F.col("r_b"))
    c = named(pa_, "a").join(named(pb, "b"), "bit").where((na >= t * nb - 1e-9) & (nb >= t * na - 1e-9) & (reach >= t / (1 + t) * (na + nb) - 1e-9))
    if own:
        c = c.where("id_a < id_b")
    c = c.select("id_a", "id_b").distinct().join(named(da, "a"), "id_a").join(named(db, "b"), "id_b")
    c = c.withColumn("shared", F.size(F.array_intersect("s_a", "s_b"))).withColumn("similarity", F.col("shared") / (na + nb - F.col("shared")))
    return c.where(F.col("similarity") >= threshold).select("id_a", "id_b", "shared", "similarity")


def tanimoto_search(query: DataFrame, library: DataFrame, *, threshold: float = 0.7, **how) -> DataFrame:
    """Library hits of each query at or above the threshold, best first."""
    h = tanimoto_pairs(query, library, threshold=threshold, **how)
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.col("similarity").desc(), "id_b")))


def similarity_pairs(library: DataFrame, *, threshold: float = 0.7, **how) -> DataFrame:
    """All pairs within a library at or above the threshold, each once."""
    return tanimoto_pairs(library, library, threshold=threshold, own=True, **how)


def _butina_in_rounds(s: Scratch, near: DataFrame, ids: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """(id, cluster): a free id before all its free neighbours in the order is a centre, whose neighbours are free no more; each of them goes to its first centre in the order."""
    free, centres = ids, None
    left = s.saved(near.join(ids.select("id", F.col("rank").alias("own")), "id").join(ids.select(F.col("id").alias("o"), "rank"), "o"), "open")
    for _ in range(most_rounds):
        if free.isEmpty():
            break
        beaten = left.where("rank < own").select("id").distinct()
        now = s.saved(free.join(beaten, "id", "left_anti"), "centres")
        centres = now if centres is None else centres.unionByName(now)
        gone = s.saved(left.join(now.select(F.col("id").alias("o")), "o", "left_semi").select("id").unionByName(now.select("id")).distinct(), "gone")
        free = s.saved(free.join(gone, "id", "left_anti"), "free")
        later = s.saved(left.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("o")), "o", "left_anti"), "open")  # links between free ids only
        s.drop(left)
        left = later
    else:
        raise RuntimeError("the clusters did not end")
    if centres is None:
        return ids.select("id", F.col("id").alias("cluster"))
    first = near.join(centres.select(F.col("id").alias("o"), "rank"), "o").groupBy("id").agg(F.min("rank").alias("c")).select("id", F.col("c.id").alias("cluster"))
    own = centres.select("id", F.col("id").alias("cluster"))
    return s.saved(own.unionByName(first.join(own, "id", "left_anti")), "members", stays=True)


def butina_clusters(pairs: DataFrame, ids: DataFrame, components: DataFrame, *, key: str = "id", task_links: int = 500_000) -> DataFrame:
    """Cluster (its centre) of every id: the largest neighbourhood first (ties by id), its members removed.

    Components (id, component) of the pair graph never compete: one of at most
    ``task_links`` links is a task, larger ones go in rounds of joins with the
    same result.
    """
    s = Scratch(ids.sparkSession, "butina")
    both = s.saved(pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("o")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("o"))), "pairs", stays=True)
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    x = ids.select(F.col(key).alias("id")).join(degree, "id", "left").join(components.select(F.col(key).alias("id"), "component"), "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("component", "id").alias("component"))
    x = s.saved(x, "ids", stays=True)
    many = s.saved(x.groupBy("component").agg(F.sum("k").alias("links")).where(F.col("links") > task_links).select("component"), "large", stays=True)
    kind = ids.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {r["id"]: set(r["near"]) if r["near"] is not None else set() for r in pdf.to_dict("records")}
        free, out = set(near), []
        for i in sorted(near, key=lambda k: (-len(near[k]), k)):
            if i in free:
                members = ({i} | near[i]) & free
                out += [(m, i) for m in members]
                free -= members
        return pd.DataFrame(out, columns=["id", "cluster"])

    few = x.join(many, "component", "left_anti")
    lists = both.join(few.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list("o").alias("near"))  # of bounded components
    out = few.join(lists, "id", "left").select("id", "component", "near").groupBy("component").applyInPandas(one, f"id {kind}, cluster {kind}")
    if not many.isEmpty():
        own = s.saved(x.join(many, "component", "left_semi").select("id", F.struct((-F.col("k")).alias("k"), "id").alias("rank")), "own")
        out = out.unionByName(_butina_in_rounds(s, both, own))
    s.close()
    return out.withColumnRenamed("id", key)


def dedupe_replicates(df: DataFrame, *, compound: str = "compound", value: str = "value", most_range: float = 1.0, policy: str = "flag") -> DataFrame:
    """Per compound: n, mean, sd, range and whether replicates disagree; policy 'drop' leaves those out."""
    g = df.groupBy(compound).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))
    g = g.withColumn("disagree", F.col("range") > most_range)
    return g.where("not disagree") if policy == "drop" else g


def series_detect(df: DataFrame, *, group: str = "scaffold", least: int = 3) -> DataFrame:
    """Groups of at least ``least`` rows."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _nearest(batches, k):
    """The k nearest of the reference rows that follow each other with one query block (x, keys, v), by distance, then label: (q, label, d).

    A product in single precision leaves what may be nearer than the k-th so
    far; distances of those are in double precision.
    """
    block, names, rank = None, {}, np.zeros(0, int)

    def done():
        at = np.flatnonzero(np.isfinite(best))
        order = list(names)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(pa.array(at // k)), pa.array([order[c] for c in code[at]], pa.string()), pa.array(best[at])], names=["q", "label", "d"])

    for batch in batches:
        x, q_keys, q_v, _, labels, m_v = batch.columns
        for r in range(batch.num_rows):
            if x[r].as_py() != block:
                if block is not None:
                    yield done()
                block, keys = x[r].as_py(), q_keys[r].as_py()
                q = q_v[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
                best, code, own = np.full(len(keys) * k, np.inf), np.zeros(len(keys) * k, int), (q * q).sum(axis=1)
            some = labels[r].as_py()
            m = m_v[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
            before = len(names)
            here = np.array([names.setdefault(name, len(names)) for name in some], int)
            if len(names) > before:  # null before all others, as in Spark
                rank = np.empty(len(names), int)
                rank[[names[name] for name in sorted(names, key=lambda name: (name is not None, name or ""))]] = np.arange(len(names))
            far = (m * m).sum(axis=1)
            rest = q.astype(np.float32) @ (-2 * m.T).astype(np.float32)
            rest += far.astype(np.float32)
            slack = 1e-6 * (16 + q.shape[1]) * (own + far.max())
            last = best.reshape(-1, k)[:, -1] ** 2 - own
            if len(some) >= k:
                fresh = ~np.isfinite(last)
                if fresh.any():
                    last[fresh] = np.partition(rest[fresh], k - 1, axis=1)[:, k - 1] + slack[fresh]
            i, j = np.nonzero(rest <= (last + slack).astype(np.float32)[:, None])
            d = np.concatenate([np.sqrt(((q[i[t : t + 100_000]] - m[j[t : t + 100_000]]) ** 2).sum(axis=1)) for t in range(0, len(i), 100_000)] or [np.zeros(0)])
            if not np.isfinite(d).all() or not np.isfinite(rest).all():
                raise ValueError("vectors hold values that are not finite")
            touched = np.unique(i)
            kept = (touched[:, None] * k + np.arange(k)).ravel()
            who, dist, what = np.concatenate([np.repeat(touched, k), i]), np.concatenate([best[kept], d]), np.concatenate([code[kept], here[j]])
            order = np.lexsort((rank[what], dist, who))
            who, dist, what = who[order], dist[order], what[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            first = place < k
            best[who[first] * k + place[first]], code[who[first] * k + place[first]] = dist[first], what[first]
    if block is not None:
        yield done()


def knn_label_transfer(reference: DataFrame, query: DataFrame, *, k: int = 15, gate: float = 0.99, key: str = "id", vector: str = "embedding", label: str = "label", block: int = 2048) -> DataFrame:
    """Label of most of the k nearest reference vectors, its vote share and the mean distance; Unknown above the gate (a quantile of the reference's own mean distances, itself included).

    Both are cut into blocks of bounded size and written once. A task takes a
    block of queries through the reference blocks it holds and keeps the k best
    of each query (by distance, then label), so few rows are shuffled; a window
    merges them.
    """
    s = Scratch(reference.sparkSession, "neighbours")

    def packed(t: DataFrame, name: str, own: Column, names: list[str]) -> DataFrame:
        many = max(1, -(-t.count() // block))
        g = t.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias(names[0])).agg(F.collect_list(F.struct(own.alias("o"), F.col(vector).alias("v"))).alias("r"))  # of bounded blocks
        return s.saved(g.select(names[0], F.col("r.o").alias(names[1]), F.flatten("r.v").alias(names[2])), name, stays=True)

    ref = packed(reference, "reference", F.col(label).cast("string"), ["y", "labels", "m"])

    def means(t: DataFrame, name: str) -> DataFrame:
        """The k nearest of each row, as (q, label, d)."""
        c = _each_with_each(packed(t, name, F.col(key).cast("string"), ["x", "keys", "v"]), ref, 64)
        c = c.mapInArrow(partial(_nearest, k=k), "q string, label string, d double")
        w = Window.partitionBy("q").orderBy("d", "label")
        return s.saved(c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), f"{name}_near", stays=True)

    limit = quantiles(means(reference, "own").groupBy("q").agg(F.avg("d").alias("m")), "m", [gate])[0]
    n = means(query, "queries")
    v = n.groupBy("q", "label").agg(F.count(F.lit(1)).alias("votes")).groupBy("q").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("_b"), F.sum("votes").alias("_n"))
    out = v.join(n.groupBy("q").agg(F.avg("d").alias("distance")), "q")
    return out.select(F.col("q").alias(key), F.when(F.col("distance") > limit, "Unknown").otherwise(F.col("_b.label")).alias("label"), (-F.col("_b.v") / F.col("_n")).alias("vote_share"), "distance")


def hypergeom_enrichment(hits: DataFrame, universe: DataFrame, sets: DataFrame, *, least: int = 10, most: int = 500) -> DataFrame:
    """Over-representation per set: members in the universe, hits in it, p and BH; hits and sets are cut to the universe first."""
    u = universe.select("gene").distinct()
    h = hits.select("gene").distinct().join(u, "gene", "left_semi")
    s = sets.select("set", "gene").distinct().join(u, "gene", "left_semi")
    n = u.agg(F.count(F.lit(1)).alias("total")).crossJoin(h.agg(F.count(F.lit(1)).alias("drawn")))  # one row each
    g = s.join(h.withColumn("_h", F.lit(1)), "gene", "left").groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.count("_h").alias("k")).where(F.col("size").between(least, most)).crossJoin(n)  # one row
    return adjust_p(g.withColumn("p", tails.hypergeom_p("k", "total", "size", "drawn")))


def gsea_running_sum(ranking: DataFrame, sets: DataFrame, *, least: int = 10, most: int = 500, weight: float = 1.0) -> DataFrame:
    """Enrichment score of each set over a ranking (gene, score): the largest deviation of the running sum, and the genes before it (leading edge size).

    Only a set's own genes are joined: between two of them the sum falls
    evenly, so its extremes lie at members.
    """
    d = ranking.where("score is not null").groupBy("gene").agg(F.max("score").alias("score"))
    r = ranked(d.withColumn("_n", -F.col("score")), "_n", tie_break=["gene"], out="r")
    total = d.agg(F.count(F.lit(1)).alias("total"))
    m = sets.select("set", "gene").distinct().join(r, "gene").withColumn("_w", F.pow(F.abs("score"), weight))
    w = Window.partitionBy("set").orderBy("r")
    m = m.withColumn("_k", F.row_number().over(w)).withColumn("_c", F.sum("_w").over(w)).withColumn("_s", F.sum("_w").over(Window.partitionBy("set"))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("set"))).crossJoin(total)  # one row
    m = m.where(F.col("size").between(least, most))
    plain = F.col("_s") > 0  # a set of scores 0 counts its genes alike
    m = m.withColumn("_c", F.when(plain, F.col("_c")).otherwise(F.col("_k"))).withColumn("_w", F.when(plain, F.col("_w")).otherwise(1.0)).withColumn("_s", F.when(plain, F.col("_s")).otherwise(F.col("size")))
    miss = F.col("total") - F.col("size")
    after = F.col("_c") / F.col("_s") - (F.col("r") - F.col("_k")) / F.nullif(miss, F.lit(0))
    before = (F.col("_c") - F.col("_w")) / F.col("_s") - (F.col("r") - F.col("_k")) / F.nullif(miss, F.lit(0))
    m = m.withColumn("_hi", after).withColumn("_lo", before)
    g = m.groupBy("set", "size").agg(F.max(F.struct("_hi", "_k")).alias("_up"), F.min(F.struct("_lo", "_k")).alias("_down"))
    up = F.abs("_up._hi") >= F.abs("_down._lo")
    return g.select("set", "size", F.when(up, F.col("_up._hi")).otherwise(F.col("_down._lo")).alias("es"), F.when(up, F.col("_up._k")).otherwise(F.col("size") - F.col("_down._k") + 1).alias("leading_edge"))
