"""The statistical core: running sums over one long order, p-value adjustment, two-group tests, areas under curves.

A family of tests can be as long as the data. Sums in its order are made in
two passes: the rows are written once, bucketed by quantiles of the ordering
value (as many buckets as the rows need), each bucket is summed, the bucket
totals give each bucket's start, and a window runs inside a bucket. Ties share
a bucket, so results equal those of one window; a value that very many rows
have (a p of 1.0) therefore is one task, and above ``BUCKETS`` times
``BUCKET_ROWS`` rows (819 million) buckets grow instead of becoming more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.scratch import Scratch

#: Rows of a bucket, and buckets at most; the cut points are the only thing that comes to the driver.
BUCKET_ROWS, BUCKETS = 200_000, 4_096


def _written(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession, "ordered").saved(df, "rows", stays=True)


def _number(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below a value, by halving an array of them; nulls lie above none."""
    if not cuts:
        return F.lit(0)
    held, at = F.array(*[F.lit(float(x)) for x in cuts]), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        up = (s.lo < s.hi) & F.coalesce(F.get(held, mid) < value, F.lit(False))
        return F.struct(F.when(up, mid + 1).otherwise(s.lo).alias("lo"), F.when(up, s.hi).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, at, halved, lambda s: s.lo)


def bucketed(df: DataFrame, order: str, out: str = "_b") -> DataFrame:
    """Adds a bucket number that rises with ``order``; nulls get bucket 0. ``df`` is read twice: give it a written table."""
    n = min(BUCKETS, -(-df.count() // BUCKET_ROWS))
    cuts = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).first()[0] or [] if n > 1 else []
    cuts = sorted(set(cuts))
    return df.withColumn(out, _number(F.col(order).cast("double"), cuts))


def ranked(df: DataFrame, order: str, *, by: list[str] | None = None, ties: str = "order", out: str = "rank", tie_break: list[str] | None = None) -> DataFrame:
    """Adds the 1-based rank by ``order`` (average rank of ties with ``ties='average'``), within ``by`` or over all rows."""
    by = by or []
    if by:
        w = Window.partitionBy(*by).orderBy(order, *(tie_break or []))
        first = F.row_number().over(w) if ties == "order" else F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / 2
        return df.withColumn(out, first)
    b = bucketed(_written(df), order)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    b = b.join(F.broadcast(start), "_b")
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(order, *(tie_break or []))) if ties == "order" else F.rank().over(Window.partitionBy("_b").orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy("_b", order)) - 1) / 2
    return b.withColumn(out, inner + F.col("_start")).drop("_b", "_start")


#: Values that may come to the driver at once, and the accuracy of the estimates that narrow a search.
FEW_VALUES, ACCURACY = 20_000, 10_000


def order_statistics(df: DataFrame, column: str, ranks: Callable[[int], list[int]], *, few: int = FEW_VALUES, accuracy: int = ACCURACY) -> tuple[int, dict[int, float]]:
    """How many values a column has, and those of the 0-based ``ranks`` (a function of that number) in rising order. Nulls don't count.

    A rank's search begins with the whole range of values. An approximate
    percentile, whose error in ranks is known, gives a lower and an upper
    candidate; exact counts below, at and above them tell where the rank lies:
    at a candidate (however many ties it has), or between them, or, should the
    estimate be off, beyond. Each pass leaves less than a thousandth of the
    values; the last few come to the driver. So no task holds more than a
    summary, and the answer is exact. The column is written once and read per pass.
    """
    s = Scratch(df.sparkSession, "order")
    d = s.saved(df.select(F.col(column).cast("double").alias("x")).where("x is not null"), "values")
    n = d.count()
    x, found = F.col("x"), {}
    #: rank: (values below the open interval, values in it, its ends or None)
    todo = {r: (0, n, None, None) for r in sorted(set(ranks(n))) if 0 <= r < n}

    def inside(lo, hi):
        return (F.lit(True) if lo is None else x > F.lit(lo)) & (F.lit(True) if hi is None else x < F.lit(hi))

    while todo:
        small = {k: v for k, v in todo.items() if v[1] <= few}
        spans = sorted({v[2:] for v in small.values()}, key=str)
        for lo, hi in spans:
            got = sorted((r[0] for r in d.where(inside(lo, hi)).collect()), key=lambda v: (math.isnan(v), v))
            found |= {k: got[k - v[0]] for k, v in small.items() if v[2:] == (lo, hi)}
        todo = {k: v for k, v in todo.items() if k not in small}
        if not todo:
            break
        ask = []
        for k, (below, held, lo, hi) in todo.items():
            slack = 2 * held // accuracy + 1
            shares = [max(0.0, (k - below - slack) / held), min(1.0, (k - below + 1 + slack) / held)]
            ask.append(F.percentile_approx(F.when(inside(lo, hi), x), shares, accuracy))
        guesses = dict(zip(todo, d.agg(*[a.alias(f"g{i}") for i, a in enumerate(ask)]).first()))
        sums = []
        for i, (k, (_, _, lo, hi)) in enumerate(todo.items()):
            a, z = guesses[k]
            apart = a != z and not math.isnan(a)  # NaN comes last and equals itself, as Spark has it
            where = {"under": x < F.lit(a), "low": x == F.lit(a), "mid": (x > F.lit(a)) & (x < F.lit(z)), "high": (x == F.lit(z)) & F.lit(apart)}
            sums += [F.count_if(inside(lo, hi) & c).alias(f"{name}{i}") for name, c in where.items()]
        counts = d.agg(*sums).first()
        left = {}
        for i, (k, (below, held, lo, hi)) in enumerate(todo.items()):
            a, z = guesses[k]
            at = k - below
            under, low, mid, high = (counts[f"{c}{i}"] for c in ("under", "low", "mid", "high"))
            if at < under:
                left[k] = (below, under, lo, a)
            elif at < under + low:
                found[k] = a
            elif at < under + low + mid:
                left[k] = (below + under + low, mid, a, z)
            elif at < under + low + mid + high:
                found[k] = z
            else:
                gone = under + low + mid + high
                left[k] = (below + gone, held - gone, z, hi)
        todo = left
    s.close()
    return n, found


def quantiles(df: DataFrame, column: str, shares: list[float], **how) -> list[float | None]:
    """Exact quantiles of a whole column with linear interpolation, as ``percentile`` gives them; null where there are no values."""

    def ranks(n: int) -> list[int]:
        return [r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))]

    n, v = order_statistics(df, column, ranks, **how)
    out = []
    for q in shares if n else []:
        at = q * (n - 1)
        lo, hi = math.floor(at), math.ceil(at)
        out.append(v[lo] if v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi])
    return out or [None] * len(shares)


def _by(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


def _summed(b: DataFrame, order: str, sums: dict[str, Column], descending: bool, by: list[str] | None = None) -> DataFrame:
    by = by or []
    totals = b.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    w = Window.partitionBy(*by).orderBy(_by("_b", descending))  # one row per bucket
    starts = totals.select(*by, "_b", *[(F.sum(f"_t_{k}").over(w) - F.col(f"_t_{k}")).alias(f"_s_{k}") for k in sums])
    inner = Window.partitionBy(*by, "_b").orderBy(_by(order, descending)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.join(starts if by else F.broadcast(starts), [*by, "_b"]).withColumns({k: F.sum(c).over(inner) + F.col(f"_s_{k}") for k, c in sums.items()})
    return b.drop(*[f"_s_{k}" for k in sums])


def running(df: DataFrame, order: str, sums: dict[str, Column], *, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Adds running sums of ``sums`` over all rows, or within ``by``, by ``order``; rows of equal order value share the sum up to their last. A large group is spread over the buckets of the whole order."""
    return _summed(bucketed(_written(df), order), order, sums, descending, by).drop("_b")


def joined_ties(df: DataFrame, value: str, error: str, *, by: list[str] | None = None) -> DataFrame:
    """``value`` replaced by the least of its chain of ties, over all rows or within ``by``; ``error`` is dropped.

    A value and the next one are ties if they differ by no more than their
    rounding errors together, which ``error`` bounds: sums that are equal as
    numbers differ in their last digits by the order of their terms.
    """
    by, reach = by or [], F.struct(value, error)
    b = bucketed(_written(df.withColumn(error, F.when(F.col(error) < math.inf, F.col(error)).otherwise(F.lit(0.0)))), value)
    inner, outer = Window.partitionBy(*by, "_b").orderBy(value, error), Window.partitionBy(*by).orderBy("_b")  # outer: one row per bucket
    last = b.groupBy(*by, "_b").agg(F.max(reach).alias("_last")).select(*by, "_b", F.lag("_last").over(outer).alias("_before"))
    b = b.join(last if by else F.broadcast(last), [*by, "_b"])
    before = F.coalesce(F.lag(reach).over(inner), F.col("_before"))
    apart = F.coalesce(F.col(value) - before[value] > F.col(error) + before[error], F.lit(True))
    b = b.withColumn("_first", F.when(apart, F.col(value))).drop("_before")
    starts = b.groupBy(*by, "_b").agg(F.max("_first").alias("_s")).select(*by, "_b", F.max("_s").over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    b = b.join(starts if by else F.broadcast(starts), [*by, "_b"])
    first = F.max("_first").over(Window.partitionBy(*by, "_b").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))  # of equal values one is marked
    return b.withColumn(value, F.coalesce(first, F.col("_start"))).drop("_b", "_first", "_start", error)


def running_least(df: DataFrame, order: str, sums: dict[str, Column], value: Column, *, out: str, value_out: str = "_v", descending: bool = False, back: bool = True) -> DataFrame:
    """Adds running sums, a value of them, and the least such value from the far end of the order back to each row (``back=False``: from the near end)."""
    b = _summed(bucketed(_written(df), order), order, sums, descending).withColumn(value_out, value)
    way = descending != back  # the direction of the minimum
    w = Window.orderBy(_by("_b", way)).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    before = b.groupBy("_b").agg(F.min(value_out).alias("_m")).select("_b", F.min("_m").over(w).alias("_before"))
    inner = Window.partitionBy("_b").orderBy(_by(order, way)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return b.join(F.broadcast(before), "_b").withColumn(out, F.least(F.min(value_out).over(inner), F.col("_before"))).drop("_b", "_before")


def adjust_p(df: DataFrame, *, p: str = "p", by: list[str] | None = None, method: str = "bh", out: str = "q") -> DataFrame:
    """Adjusted p-values (bh, by, bonferroni, holm). Null p stays null and doesn't count."""
    by = by or []
    if method not in ("bh", "by", "bonferroni", "holm"):
        raise ValueError(method)
    if not by:
        df = _written(df)
    tested, rest = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    m = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    if method == "by":  # the harmonic sum, once per family
        exact = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(1000)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
        n = F.col("_m").cast("double")
        m = m.withColumn("_c", F.when(F.col("_m") <= 1000, exact).otherwise(F.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n * n)))
    t = tested.join(m, by) if by else tested.crossJoin(F.broadcast(m))  # one row without by
    factor = F.col("_m") * F.col("_c") if method == "by" else F.col("_m")
    if method == "bonferroni":
        return t.withColumn(out, F.least(F.lit(1.0), F.col(p) * factor)).drop("_m").unionByName(rest)
    one = F.lit(1.0)
    if by:
        up, full = Window.partitionBy(*by).orderBy(p), Window.partitionBy(*by).orderBy(F.col(p).desc())
        if method == "holm":
            t = t.withColumn("_v", F.least(one, (F.col("_m") - F.rank().over(up) + 1) * F.col(p))).withColumn(out, F.max("_v").over(up))
        else:
            r = F.count(F.lit(1)).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            t = t.withColumn("_v", F.least(one, F.col(p) * factor / r)).withColumn(out, F.min("_v").over(full))
    elif method == "holm":
        same = F.count(F.lit(1)).over(Window.partitionBy("_b", p))
        t = running_least(t, p, {"_r": F.lit(1)}, -F.least(one, (F.col("_m") - (F.col("_r") - same + 1) + 1) * F.col(p)), out=out, back=False).withColumn(out, -F.col(out))
    else:
        t = running_least(t, p, {"_r": F.lit(1)}, F.least(one, F.col(p) * factor / F.col("_r")), out=out)
    return t.drop("_m", "_c", "_r", "_v").unionByName(rest)


def rank_sums(df: DataFrame, *, feature: str = "feature", value: str = "value", group: str = "is_case") -> DataFrame:
    """Per feature: n1, n2, u and the sum of t^3 - t over ties. ``group`` is boolean; null values are left out."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = d.groupBy(feature, value).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(group)).alias("t1"))
    before = Window.partitionBy(feature).orderBy(value)
    r = counts.withColumn("avg_rank", F.sum("t").over(before) - F.col("t") + (F.col("t") + 1) / 2)
    g = r.groupBy(feature).agg(F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("t1") * F.col("avg_rank")).alias("w"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return g.withColumn("u", F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2).drop("w")


def rank_sum_test(df: DataFrame, *, feature: str = "feature", value: str = "value", group: str = "is_case", continuity: bool = False) -> DataFrame:
    """Two-group rank test per feature: n1, n2, u, z (tie-corrected), p. ``group`` is boolean; null values are left out."""
    g = rank_sums(df, feature=feature, value=value, group=group)
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0)))
    off = F.col("u") - F.col("n1") * F.col("n2") / 2
    if continuity:
        off = F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5)
    z = F.when(var > 0, off / F.sqrt(var))
    return g.select(feature, "n1", "n2", "u", z.alias("z")).withColumn("p", tails.norm_two_sided("z"))


def welch_test(df: DataFrame, *, feature: str = "feature", value: str = "value", group: str = "is_case", least: int = 2) -> DataFrame:
    """Unequal-variance t per feature: n1, n2, diff, t, df, p, status; features that can't be tested stay with a reason."""
    g, v = F.col(group), F.col(value)
    a = df.groupBy(feature).agg(*[f(F.when(c, v)).alias(f"{k}{i}") for i, c in ((1, g), (2, ~g)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    se2 = e1 + e2
    few = (F.col("n1") < least) | (F.col("n2") < least)
    ok = ~few & (se2 > 0)
    df_ = se2 * se2 / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    out = a.select(feature, "n1", "n2", (F.col("m1") - F.col("m2")).alias("diff"), F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(se2)).alias("t"), F.when(ok, df_).alias("df"), F.when(few, "too few").when(~F.coalesce(se2 > 0, F.lit(False)), "no variance").otherwise("tested").alias("status"))
    return out.withColumn("p", tails.t_p("t", "df"))


def paired_t(df: DataFrame, *, feature: str = "feature", pair: str = "donor", value: str = "value", group: str = "is_case") -> DataFrame:
    """Paired t per feature over pairs that have both values: n, mean_diff, t, df, p."""
    both = df.groupBy(feature, pair).agg(F.avg(F.when(F.col(group), F.col(value))).alias("a"), F.avg(F.when(~F.col(group), F.col(value))).alias("b")).where("a is not null and b is not null")
    g = both.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"))
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    return g.select(feature, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df")).withColumn("p", tails.t_p("t", F.col("df").cast("double")))


def binned_auc(df: DataFrame, *, score: str = "score", label: str = "label", by: list[str] | None = None, error: str | None = None) -> DataFrame:
    """ROC area by ranks and PR area by trapezoids over distinct scores, per group: n, positives, roc_auc, pr_auc. One class alone gives null. Scores within the bounds of their rounding errors, column ``error``, are ties."""
    by = by or []
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    sums = [F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("fp")]
    g = d.groupBy(*by, score).agg(*sums, *([F.max(error).alias(error)] if error else []))
    if error:
        g = joined_ties(g, score, error, by=by).groupBy(*by, score).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    c = running(g, score, {"ctp": F.col("tp"), "cfp": F.col("fp")}, by=by, descending=True)
    total = g.groupBy(*by).agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))
    c = c.join(total, by) if by else c.crossJoin(F.broadcast(total))
    r1, p1 = F.col("ctp") / F.nullif("pos", F.lit(0)), F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    before_tp, before_all = F.col("ctp") - F.col("tp"), F.col("ctp") + F.col("cfp") - F.col("tp") - F.col("fp")
    p0 = F.when(before_all > 0, before_tp / before_all).otherwise(F.lit(1.0))
    pr = (r1 - before_tp / F.nullif("pos", F.lit(0))) * (p1 + p0) / 2
    roc = F.col("fp") * (F.col("ctp") - F.col("tp") / 2)
    out = c.groupBy(*by, "pos", "neg").agg(F.sum(roc).alias("_roc"), F.sum(pr).alias("_pr"))
    one = (F.col("pos") == 0) | (F.col("neg") == 0)
    return out.select(*by, (F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("positives"), F.when(~one, F.col("_roc") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(~one, F.col("_pr")).alias("pr_auc"))


def calibration_table(df: DataFrame, *, label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per quantile bin of p; bins are open on the right, the last is closed."""
    edges = [x for x in quantiles(df, p, [k / bins for k in range(1, bins)]) if x is not None]
    at = sum(((F.col(p) >= F.lit(x)).cast("int") for x in edges), F.lit(0))
    return df.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def survival_curve(df: DataFrame, *, time: str = "time", event: str = "event", by: list[str] | None = None) -> DataFrame:
    """Kaplan-Meier steps: time, at_risk, events, survival. Rows are few after the count by time."""
    by = by or []
    t = df.groupBy(*by, time).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(*by).orderBy(F.col(time).desc())
    t = t.withColumn("at_risk", F.sum("n").over(w))
    up = Window.partitionBy(*by).orderBy(time)
    q = 1 - F.col("events") / F.col("at_risk")
    gone = F.max((q <= 0).cast("int")).over(up)
    s = F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(q > 0, F.log(q)).otherwise(F.lit(0.0))).over(up)))
    return t.select(*by, time, "at_risk", "events", s.alias("survival"))


def cumulative_incidence(df: DataFrame, *, time: str = "time", cause: str = "cause", of: int = 1) -> DataFrame:
    """Aalen-Johansen incidence of one cause beside competing ones (0: censored): time, at_risk, incidence."""
    t = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(cause) != 0).alias("any"), F.count_if(F.col(cause) == of).alias("own"))
    t = t.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.col(time).desc())))
    w = Window.orderBy(time)
    q = 1 - F.col("any") / F.col("at_risk")
    t = t.withColumn("_l", F.sum(F.when(q > 0, F.log(q)).otherwise(F.lit(-1e9))).over(w))
    before = F.exp(F.coalesce(F.lag("_l").over(w), F.lit(0.0)))
    return t.withColumn("_step", before * F.col("own") / F.col("at_risk")).select(time, "at_risk", F.sum("_step").over(w).alias("incidence"))


def stouffer_meta(df: DataFrame, *, feature: str = "gene", unit: str = "animal", p: str = "p", least: float = 1e-10, alpha: float = 0.05, consistent: float = 0.5) -> DataFrame:
    """One-sided p combined per feature over units: meta_z, meta_p, n, n at nominal alpha, BH, and hit or review.

    A hit passes BH and is nominal in at least ``consistent`` of all units;
    features that pass BH alone are for review.
    """
    n_units = df.select(unit).distinct().count()
    z = df.withColumn("_z", -tails.norm_quantile(F.greatest(F.col(p), F.lit(least))))
    g = z.groupBy(feature).agg((F.sum("_z") / F.sqrt(F.count("_z"))).alias("meta_z"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(p) < alpha).alias("n_nominal"))
    q = adjust_p(g.withColumn("meta_p", tails.norm_upper("meta_z")), p="meta_p")
    steady = F.col("n_nominal") >= consistent * n_units
    return q.withColumn("call", F.when(~(F.col("q") < alpha), "none").when(steady, "hit").otherwise("review"))


def balance_check(df: DataFrame, *, a: str, b: str) -> DataFrame:
    """Counts of all pairs of levels and a verdict: a zero cell is confounded, a spread above 1 within ``b`` is imbalanced."""
    cells = df.select(a).distinct().crossJoin(df.select(b).distinct()).join(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), [a, b], "left").fillna(0, ["n"])  # levels of two design factors
    w = Window.partitionBy(b)
    return cells.withColumn("verdict", F.when(F.min("n").over(w) == 0, "confounded").when(F.max("n").over(w) - F.min("n").over(w) > 1, "imbalanced").otherwise("balanced"))


def block_randomize(df: DataFrame, *, unit: str, block: str, arms: list[str], seed: int = 1) -> DataFrame:
    """A balanced arm per unit within its block, in the order of a seeded hash: unit, block, run_order, arm."""
    w = Window.partitionBy(block).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string")), 256), unit)
    r = df.select(unit, block).distinct().withColumn("run_order", F.row_number().over(w))
    return r.withColumn("arm", F.element_at(F.array(*map(F.lit, arms)), (F.pmod(F.col("run_order") - 1, F.lit(len(arms))) + 1).cast("int")))


def unit_aggregate(df: DataFrame, *, unit: list[str], value: str) -> DataFrame:
    """One mean and count per experimental unit."""
    return df.groupBy(*unit).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
