"""Gene-set enrichment of a ranking with a permutation null: normalised scores, p and q.

The null of a set depends on its size alone: the scores of random sets of as
many genes of the ranking. Draw number b orders all genes by the hash of
(seed, b, gene) and its random set of size k is the first k of them, so draws
need no state, can be repeated anywhere, and are shared by all sets of a size.
A gene whose hash lies above a bound that no set can reach is left out where it
is read, so what is shuffled is draws times the largest set, whatever the
number of genes. Each draw is scored at all sizes in one task; of these scores
only counts and sums per set leave the join by size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.sequences import gsea_running_sum
from strandloom.operators.stats import adjust_p, ranked
from strandloom.scratch import Scratch


def running_extreme(r: np.ndarray, w: np.ndarray, total: int) -> float:
    """The largest deviation of the running sum of a set with ranks ``r`` (from 1) and weights ``w`` among ``total`` genes."""
    k = len(r)
    order = np.argsort(r, kind="stable")
    r, w = r[order], w[order]
    c = np.cumsum(w)
    c, w = (c / c[-1], w / c[-1]) if c[-1] > 0 else (np.arange(1, k + 1) / k, np.full(k, 1 / k))
    missed = (r - np.arange(1, k + 1)) / max(1, total - k)
    high, low = (c - missed).max(), (c - w - missed).min()
    return float(high if abs(high) >= abs(low) else low)


def _drawn(rows: pd.DataFrame, sizes: list[int], total: int) -> pd.DataFrame:
    """Scores of one draw's random sets, one of each size."""
    rows = rows.sort_values(["h", "gene"])
    if len(rows) < min(sizes[-1], total):
        raise RuntimeError("a draw has fewer genes than its largest set")
    r, w = rows["r"].to_numpy(np.int64), rows["w"].to_numpy(np.float64)
    return pd.DataFrame({"draw": int(rows["draw"].iloc[0]), "size": sizes, "null_es": [running_extreme(r[:k], w[:k], total) for k in sizes]})


def null_scores(ranks: DataFrame, sizes: list[int], total: int, *, draws: int, seed: int = 0) -> DataFrame:
    """draw, size, null_es of ``draws`` random sets of each size of a ranking (gene, r, w). ``sizes`` are those of the tested sets, a bounded range.

    Hashes are taken in where they are at most a bound that leaves the largest
    set with twelve standard deviations to spare; too few are an error, not a
    smaller set.
    """
    most = sizes[-1]
    bound = int(min(1.0, (most + 12 * most**0.5 + 50) / total) * 16**8)
    d = ranks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("gene").cast("string")).cast("binary")))
    if bound < 16**8:
        d = d.where(F.col("h") < f"{bound:08x}")
    d = d.select("draw", "h", F.col("gene").cast("string").alias("gene"), "r", "w")
    return d.groupBy("draw").applyInPandas(partial(_drawn, sizes=sizes, total=total), "draw int, size long, null_es double")


def gsea(ranking: DataFrame, sets: DataFrame, *, least: int = 10, most: int = 500, weight: float = 1.0, draws: int = 1000, seed: int = 0) -> DataFrame:
    """set, size, es, leading_edge, nes, p and q of each set of ``least`` to ``most`` genes of the ranking (gene, score).

    nes is the score over the mean of the null scores of its sign. p counts the
    null scores of its sign that are as extreme, plus one in both counts, and q
    is BH over the sets. The least p is 1 / (draws of that sign + 1); more
    draws resolve smaller ones. nes is null where no draw has the sign. Genes
    without score are left out, repeated genes count with their highest score,
    and a set's genes that aren't ranked don't count. No sets give no rows.
    """
    s = Scratch(ranking.sparkSession, "gsea")
    found = s.saved(gsea_running_sum(ranking, sets, least=least, most=most, weight=weight), "scores", stays=True)
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())
    d = ranking.where("score is not null").groupBy("gene").agg(F.max("score").alias("score"))
    ranks = ranked(d.withColumn("_n", -F.col("score")), "_n", tie_break=["gene"], out="r").select("gene", "r", F.pow(F.abs("score"), weight).alias("w"))
    if sizes:
        ranks = s.saved(ranks, "ranks")
        null = s.saved(null_scores(ranks, sizes, ranks.count(), draws=draws, seed=seed), "null", stays=True)
        s.close()
    else:
        null = ranking.sparkSession.createDataFrame([], "draw int, size long, null_es double")
    x = F.col("null_es")
    mean = null.groupBy("size").agg(F.avg(F.when(x >= 0, x)).alias("up"), F.avg(F.when(x <= 0, x)).alias("down"), F.count_if(x >= 0).alias("n_up"), F.count_if(x <= 0).alias("n_down"))
    tail = found.select("set", "size", "es").join(null, "size").groupBy("set").agg(F.count_if(x >= F.col("es")).alias("above"), F.count_if(x <= F.col("es")).alias("below"))
    j = found.join(F.broadcast(mean), "size").join(tail, "set")  # a row per size between least and most
    es = F.col("es")
    j = j.withColumn("nes", es / F.nullif(F.when(es > 0, F.col("up")).otherwise(-F.col("down")), F.lit(0.0)))
    j = j.withColumn("p", F.least((F.col("above") + 1) / (F.col("n_up") + 1), (F.col("below") + 1) / (F.col("n_down") + 1)))
    return adjust_p(j).select("set", "size", "es", "leading_edge", "nes", "p", "q")
