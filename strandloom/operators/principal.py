"""Principal components of the samples of a long (feature, sample, value) table, for any number of samples.

The samples' matrix of products is never made. A block of vectors over the
samples is multiplied by it with two joins and sums (samples to features and
back), made orthogonal to those before it, and added to a basis; the products
of basis and block give a small matrix, whose eigenvectors combine the basis
into the components (block Lanczos with full orthogonalisation). Basis vectors
stay with the samples' rows; only matrices of the basis' size, a few hundred
numbers wide, come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strandloom.scratch import Scratch


def _cross(t: DataFrame, a: str, b: str) -> np.ndarray:
    """The sum over rows of the outer products of two array columns."""
    shape = t.select(F.size(a), F.size(b)).first()

    def sums(batches):
        c = None
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[a].to_list()).T @ np.stack(pdf[b].to_list())
                c = m if c is None else c + m
        if c is not None:
            yield pd.DataFrame({"i": range(len(c)), "row": list(c)})

    p = t.select(*dict.fromkeys((a, b))).mapInPandas(sums, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    out = np.zeros(shape)
    for r in p.collect():
        out[r.i, r.j] = r.c
    return out


def _added(x: DataFrame, key: str, v: DataFrame, on: str, width: int) -> DataFrame:
    """Per ``key``: the sum over its cells of x times the vector of ``on``."""
    j = x.join(v, on)
    return j.groupBy(key).agg(F.array(*[F.sum(F.col("x") * F.get("w", F.lit(i))) for i in range(width)]).alias("w"))


def leading_components(x: DataFrame, *, components: int = 5, block: int = 8, most_blocks: int = 60, tolerance: float = 1e-9, seed: int = 1) -> DataFrame:
    """sample, pc, score, explained of cells (feature, sample, x), features centred, missing cells 0.

    Ends when what the products leave outside the basis is below ``tolerance``
    of the largest eigenvalue for every component asked for, or when nothing is
    left; ``most_blocks`` without that is an error. A component's sign makes its
    largest score positive.
    """
    s = Scratch(x.sparkSession, "components")
    x = s.saved(x.select("feature", "sample", "x"), "cells")
    n = x.select("sample").distinct().count()
    total, spread = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0, x.groupBy("feature").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    trace = total - spread / max(1, n)
    width = min(block, n)
    start = [F.hash("sample", F.lit(seed + i)).cast("double") / float(1 << 31) for i in range(width)]
    fresh, dim, t = s.saved(x.select("sample").distinct().select("sample", F.array(*start).alias("z")), "start"), 0, np.zeros((0, 0))
    basis = fresh.select("sample", F.slice("z", 1, 0).alias("b"))
    values, vectors, last = np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))

    def turned(b: DataFrame, matrix: np.ndarray, source: str, out: str) -> DataFrame:
        """Rows with ``out``: their vector ``source`` times a small matrix."""

        def times(batches):
            for pdf in batches:
                if len(pdf):
                    pdf[out] = list(np.stack(pdf[source].to_list()) @ matrix)
                    yield pdf
                else:
                    yield pdf.assign(**{out: []})

        return b.mapInPandas(times, StructType([*b.schema.fields, StructField(out, ArrayType(DoubleType()))]))

    for _ in range(most_blocks):
        mean = np.array([r[0] for r in fresh.select(F.posexplode("z").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.first("i").alias("k")).orderBy("i").select("m").collect()])
        d = fresh.withColumn("z", F.transform("z", lambda v, i: v - F.get(F.array(*[F.lit(float(m)) for m in mean]), i))).join(basis, "sample")
        d = s.saved(d, "centred")
        for _twice in range(2 if dim else 0):  # once more for what rounding leaves
            h = _cross(d, "b", "z")
            d = s.saved(turned(d, h, "b", "p").withColumn("z", F.zip_with("z", "p", lambda a, c: a - c)).drop("p"), "orthogonal")
        size, axes = np.linalg.eigh(_cross(d, "z", "z"))
        if dim:
            #: what the last block's product had outside the basis, for the components found so far
            outside = np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", vectors[-len(last):, :].T, axes @ np.diag(np.clip(size, 0, None)) @ axes.T, vectors[-len(last):, :].T)))
            if (outside[: min(components, len(outside))] <= tolerance * max(values[0], 1e-300)).all() and len(values) >= min(components, n - 1):
                break
        keep = size > max(1e-18 * max(values[0], 1e-300) ** 2, 1e-13 * size.max()) if dim else size > 1e-9 * size.max()
        if not keep.any() or dim + keep.sum() > max(1, n - 1) + block:
            break
        q = axes[:, keep] / np.sqrt(size[keep])
        d = s.saved(turned(d, q, "z", "w").select("sample", F.concat("b", "w").alias("b"), "w"), "basis")
        k = int(keep.sum())
        there = s.saved(_added(x, "feature", d.select("sample", "w"), "sample", k), "features")
        fresh = s.saved(_added(x, "sample", there, "feature", k).withColumnRenamed("w", "z"), "product")
        basis, dim = d.select("sample", "b"), dim + k
        c = _cross(basis.join(fresh, "sample"), "b", "z")
        grown = np.zeros((dim, dim))
        grown[: len(t), : len(t)] = t
        grown[:, dim - k :] = c
        grown[dim - k :, :] = c.T
        t, last = (grown + grown.T) / 2, np.eye(k)
        values, vectors = np.linalg.eigh(t)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    else:
        raise RuntimeError("the components did not settle")
    k = min(components, len(values))
    scored = s.saved(turned(basis, vectors[:, :k] * np.sqrt(values[:k]), "b", "score").select("sample", F.posexplode("score").alias("pc", "score")), "scores", stays=True)
    s.close()
    top = scored.groupBy("pc").agg(F.max_by("score", F.struct(F.abs("score"), "sample")).alias("_t"))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:k]]) if k else F.array().cast("array<double>")
    return scored.join(F.broadcast(top), "pc").select("sample", (F.col("pc") + 1).alias("pc"), (F.col("score") * F.when(F.col("_t") < 0, -1.0).otherwise(1.0)).alias("score"), F.get(share, F.col("pc")).alias("explained"))
