"""Held-out checks of two-class models: whole batches left out, and whole patients per fold.

No model is fitted twice over the rows. What a fit needs are sums, and those
without a fold are the sums of all rows less the fold's own, or the moments of
the other folds merged; so one aggregate over the rows gives every fold's fit,
however many folds there are, and one more pass scores each row by the model
that never saw its fold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.stats import binned_auc, joined_ties
from strandloom.scratch import Scratch

#: Rows of a table of folds that are broadcast after counting them.
BROADCAST_FOLDS = 100_000

#: Twice the relative rounding error of one operation on doubles.
ROUNDING = 2.0**-52


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _solved(m: pd.Series, k: int, ridge: float) -> pd.Series:
    """Intercept and weights from (n, sum y, sums x, sums xy, sums xx); empty where all labels are equal."""
    out = []
    for v in m:
        v = np.asarray(v, float)
        n, y = v[0], v[1]
        if n < 2 or y <= 0 or y >= n:
            out.append([])
            continue
        mean, cross = v[2 : 2 + k] / n, v[2 + k : 2 + 2 * k] - v[2 : 2 + k] * y / n
        spread = np.zeros((k, k))
        for value, (i, j) in zip(v[2 + 2 * k :], _pairs(k)):
            spread[i, j] = spread[j, i] = value - n * mean[i] * mean[j]
        spread += ridge * np.diag(np.diag(spread))
        w = np.linalg.lstsq(spread, cross, rcond=1e-12)[0]
        out.append([y / n - float(w @ mean), *map(float, w)])
    return pd.Series(out)


def held_out_scores(df: DataFrame, *, features: list[str], label: str = "label", fold: str = "fold", ridge: float = 0.0) -> DataFrame:
    """Rows with ``held_out``, the least-squares discriminant score of a model fitted on all other folds (null where those hold one class).

    Its direction is that of the linear discriminant, and its value estimates
    the chance of label 1, so scores of different folds can be pooled. ``ridge``
    adds that share of each feature's spread to it. Rows with a null label, fold
    or feature are left out. Features are a list of columns; the sums are their
    products by pairs, per fold, and each fold's small system is solved in tasks.
    """
    s, k = Scratch(df.sparkSession, "held_out"), len(features)
    x = [F.col(c).cast("double") for c in features]
    d = s.saved(df.where(" and ".join(f"`{c}` is not null" for c in (label, fold, *features))), "rows", stays=True)
    mid = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    z = [c - F.lit(m or 0.0) for c, m in zip(x, mid)]  # sums of squares of centred values keep their digits
    y = F.col(label).cast("double")
    sums = [F.count(F.lit(1)).cast("double"), F.sum(y), *map(F.sum, z), *[F.sum(c * y) for c in z], *[F.sum(z[i] * z[j]) for i, j in _pairs(k)]]
    own = s.saved(d.groupBy(fold).agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]), "sums")
    total = own.agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(sums))])

    def solved(sums: pd.Series) -> pd.Series:
        return _solved(sums, k, ridge)

    solve = F.pandas_udf(solved, "array<double>")
    fit = own.crossJoin(F.broadcast(total))  # one row
    fit = s.saved(fit.select(F.col(fold).alias("_fold"), solve(F.array(*[F.col(f"t{i}") - F.col(f"s{i}") for i in range(len(sums))])).alias("_w")), "fits", stays=True)
    small = F.broadcast(fit) if fit.count() <= BROADCAST_FOLDS else fit
    s.close()
    score = sum((F.get("_w", F.lit(i + 1)) * c for i, c in enumerate(z)), F.get("_w", F.lit(0)))
    return d.join(small, F.col(fold) == F.col("_fold")).withColumn("held_out", F.when(F.size("_w") > 0, score)).drop("_fold", "_w")


def leave_one_batch_out(df: DataFrame, *, features: list[str], label: str = "label", batch: str = "batch", ridge: float = 0.0) -> DataFrame:
    """held_out_batch, n, auc, note, pooled_auc: each batch ranked by a model that never saw it.

    A batch of one class has no area, but its rows enter the pooled one. A batch
    without which the others hold one class is skipped and says so; its rows
    enter nothing. The pooled area also ranks rows across batches: it still
    rewards a shift between batches that follows their share of cases.
    """
    s = Scratch(df.sparkSession, "batches")
    d = s.saved(held_out_scores(df, features=features, label=label, fold=batch, ridge=ridge).select(F.col(batch).alias("held_out_batch"), F.col(label).cast("int").alias("label"), "held_out"), "scores", stays=True)
    size = d.groupBy("held_out_batch").agg(F.count(F.lit(1)).alias("n"), F.count("held_out").alias("scored"))
    auc = binned_auc(d, score="held_out", by=["held_out_batch"]).select("held_out_batch", F.col("roc_auc").alias("auc"))
    pooled = binned_auc(d, score="held_out").select(F.col("roc_auc").alias("pooled_auc"))
    note = F.when(F.col("scored") == 0, "skipped: training batches hold one class").when(F.col("auc").isNull(), "AUC undefined: one class in this batch").otherwise("")
    out = size.join(auc, "held_out_batch", "left").withColumn("note", note).drop("scored")
    return out.join(F.broadcast(pooled), F.lit(True), "left")  # one row


def fold_of(unit: str, folds: int, seed: int) -> Column:
    """The fold of a whole unit, by the MD5 of seed and unit."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _moments(v: Column, k: int) -> list[Column]:
    """Count, mean and sum of squares about the mean of one class in a fold; exact where all values are equal."""
    n, same = F.count(v).cast("double"), F.min(v) == F.max(v)
    m, q = F.when(same, F.min(v)).otherwise(F.avg(v)), F.when(same, F.lit(0.0)).otherwise(F.var_pop(v) * n)
    return [n.alias(f"n{k}"), F.coalesce(m, F.lit(0.0)).alias(f"m{k}"), F.coalesce(q, F.lit(0.0)).alias(f"q{k}")]


def _merged(a: Column, b: Column, k: int) -> list[Column]:
    """The moments of two disjoint sets of rows together."""
    n, off = a[f"n{k}"] + b[f"n{k}"], b[f"m{k}"] - a[f"m{k}"]
    share = b[f"n{k}"] / F.greatest(n, F.lit(1.0))
    return [n.alias(f"n{k}"), (a[f"m{k}"] + off * share).alias(f"m{k}"), (a[f"q{k}"] + b[f"q{k}"] + off * off * a[f"n{k}"] * share).alias(f"q{k}")]


def grouped_cv_auc(df: DataFrame, *, unit: str = "patient", label: str = "label", feature: str = "feature", value: str = "x", sample: str = "sample", folds: int = 5, top: int = 20, seed: int = 1) -> DataFrame:
    """AUC per fold of held-out units, features chosen inside the fold by Welch's t on the other folds; the score is the mean of the chosen features, signed by their difference.

    Scores or t that differ by no more than their rounding errors are ties, and
    features that tie go by name; a difference of means within its error has
    sign 0. Features without spread in either class, or with values that are
    not finite, are not tested; rows with a null unit, label or value are left
    out. A fold trains on the merged moments of the others: no sums of squares
    are subtracted, so values far from zero or outliers of the fold cost no digits.
    """
    s = Scratch(df.sparkSession, "grouped_cv")
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull() & F.col(label).isNotNull() & F.col(unit).isNotNull())
    d = s.saved(d.select(F.col(sample).alias("sample"), F.col(label).cast("int").alias("label"), F.col(feature).alias("feature"), v.alias("v"), fold_of(unit, folds, seed).alias("fold")), "rows")
    sides = {1: F.col("label") == 1, 0: F.col("label") != 1}
    own = d.groupBy("feature", "fold").agg(*[c for k, side in sides.items() for c in _moments(F.when(side, F.col("v")), k)])
    parts = own.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("fold", *[f"{c}{k}" for k in sides for c in "nmq"]))).alias("parts"))  # a struct per fold
    none = F.struct(*[F.lit(0.0).alias(f"{c}{k}") for k in sides for c in "nmq"])
    without = lambda f: F.aggregate(F.filter("parts", lambda x: x.fold != f), none, lambda a, b: F.struct(*[c for k in sides for c in _merged(a, b, k)]))
    each = parts.select("feature", F.explode(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.struct(f.alias("fold"), without(f).alias("rest")))).alias("x")).select("feature", "x.fold", "x.rest.*")
    n, m, q = ({k: F.col(f"{c}{k}") for k in sides} for c in "nmq")
    se = F.sqrt(sum(q[k] / F.nullif(n[k] - 1, F.lit(0)) / F.nullif(n[k], F.lit(0)) for k in sides))
    size = sum(F.sqrt(q[k] / n[k] + m[k] * m[k]) for k in sides)
    t = each.where("n1 >= 2 and n0 >= 2").withColumn("se", se).where((F.col("se") > 0) & (F.col("se") < math.inf)).withColumn("t", (m[1] - m[0]) / F.col("se"))
    t = t.select("fold", "feature", "t", F.abs("t").alias("far"), ((n[1] + n[0]) * ROUNDING * (size / F.col("se") + F.abs("t"))).alias("error"))
    t = t.select("fold", "feature", F.when(F.col("far") > F.col("error"), F.signum("t")).otherwise(F.lit(0.0)).alias("sign"), "far", "error")
    best = joined_ties(t, "far", "error", by=["fold"]).withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("far").desc(), "feature"))).where(F.col("r") <= top).drop("far", "r")
    x = d.join(F.broadcast(best), ["fold", "feature"])  # folds x top rows
    scored = x.groupBy("fold", "sample", "label").agg(F.avg(F.col("v") * F.col("sign")).alias("score"), ((F.count(F.lit(1)) + 2) * ROUNDING * F.avg(F.abs("v"))).alias("error"))
    out = binned_auc(scored, by=["fold"], error="error")
    s.close()
    return out
