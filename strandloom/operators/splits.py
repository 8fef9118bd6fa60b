"""Training and test rows that share no group.

Which side a group goes to depends on the sizes of the groups alone, so the
choice is made over the histogram of sizes: for all groups of one size at once,
in closed form. Which groups of a size go there follows the order of a hash,
whose ranks are counted in buckets; no task ranks all groups of a size, and
nothing but the histogram comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.scratch import Scratch


def deal_sizes(histogram: dict[int, int], train: int, test: int) -> dict[int, int]:
    """How many groups of each size go to train, of a histogram {size: groups}.

    Groups go by falling size to train while its share of ``train`` rows isn't
    above the test side's of ``test``, else to test. With d = (rows in train) *
    test - (rows in test) * train that is: at d <= 0 to train, which adds size *
    test, else to test, which takes size * train away. Once d is in (-size *
    train, size * test] it stays there, and as the window is as long as both
    steps together, only one number of steps up ends in it. Single rows then
    move to close the gap to ``train`` rows, as far as there are any.
    """
    d, have, out = 0, 0, {}
    for size, groups in sorted(histogram.items(), reverse=True):
        up, down, left, k = size * test, size * train, groups, 0
        if d > up:
            gone = min(left, -(-(d - up) // down))
            d, left = d - gone * down, left - gone
        elif d <= -down:
            k = min(left, -(d + down) // up + 1)
            d, left = d + k * up, left - k
        if left:
            #: the one number of steps up that ends in the window
            steps = min(left, max(0, (up - d + left * down) // (up + down)))
            d, k = d + steps * up - (left - steps) * down, k + steps
        out[size] = k
        have += k * size
    if 1 in out:
        out[1] += max(-out[1], min(train - have, histogram[1] - out[1]))
    return out


def group_aware_split(df: DataFrame, *, group: str = "scaffold", test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole groups to train or test, so that the sides' shares are met as ``deal_sizes`` says. Rows without a group are one group.

    Fewer than two groups, a side without rows, or a test side of single-row
    groups only, where there are larger ones, are errors.
    """
    s = Scratch(df.sparkSession, "split")
    g = s.saved(df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size")), "sizes", stays=True)
    histogram = {r[0]: r[1] for r in g.groupBy("_size").count().collect()}
    total = sum(k * n for k, n in histogram.items())
    train = int(total * (1 - test))
    if sum(histogram.values()) < 2:
        raise ValueError("at least two groups are needed")
    if not train or train == total:
        raise ValueError("one side would have no rows")
    dealt = deal_sizes(histogram, train, total - train)
    if max(histogram) > 1 and not any(histogram[k] > n for k, n in dealt.items() if k > 1):
        raise ValueError("the test side would hold groups of one row only")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_group").cast("string"), F.lit(""))).cast("binary"))
    g = g.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy("_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 buckets a size at most
    counts = g.groupBy("_size", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    k = df.sparkSession.createDataFrame(sorted(dealt.items()), "_size long, _train long")
    r = g.join(counts, ["_size", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_size", "_b").orderBy("_h", "_group")))
    r = r.join(k, "_size").select("_group", F.when(F.col("_r") <= F.col("_train"), "train").otherwise("test").alias("split"))
    return df.join(r, df[group].eqNullSafe(r["_group"])).select(*[df[c] for c in df.columns], "split")


def split_diagnostics(split: DataFrame, *, group: str = "scaffold") -> DataFrame:
    """One row of a split table: rows, share of train, groups on both sides, and the share of each side's rows that are their group's only one."""
    g = split.groupBy(group).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    one = lambda own, other: F.sum(F.when((F.col(own) == 1) & (F.col(other) == 0), 1).otherwise(0)) / F.nullif(F.sum(own), F.lit(0))
    both = F.count_if((F.col("a") > 0) & (F.col("b") > 0))
    return g.agg(F.sum(F.col("a") + F.col("b")).alias("rows"), (F.sum("a") / F.sum(F.col("a") + F.col("b"))).alias("train_share"), both.alias("shared_groups"), one("a", "b").alias("train_single_share"), one("b", "a").alias("test_single_share"))
