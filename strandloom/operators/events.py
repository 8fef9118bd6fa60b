"""Splicing events and the tests over them, and validation across groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators.stats import adjust_p


def filter_events(df: DataFrame, *, event: str = "event", psi: str = "psi", samples: int, share: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows of events with values in at least ``share`` of the samples and a mean strictly inside (low, high)."""
    g = df.groupBy(event).agg(F.count(psi).alias("_n"), F.avg(psi).alias("_m"))
    keep = g.where((F.col("_n") >= share * samples) & (F.col("_m") > low) & (F.col("_m") < high)).select(event)
    return df.join(keep, event, "left_semi")


def replicate_cell_stats(df: DataFrame, *, psi: str = "psi", included: str = "ijc", skipped: str = "sjc") -> DataFrame:
    """Adds the mean of a comma list of PSI (NA dropped) and the least total of two comma lists of read counts; without values they are null."""
    numbers = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    v = numbers(psi)
    reads = F.zip_with(F.split(included, ","), F.split(skipped, ","), lambda a, b: a.try_cast("double") + b.try_cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))
    return df.withColumn("mean_psi", mean).withColumn("min_reads", F.array_min(F.filter(reads, lambda x: x.isNotNull())))


def event_priority(df: DataFrame, *, fdr: str = "fdr", difference: str = "difference", length: str = "length", event: str = "event", top: int = 50) -> DataFrame:
    """The events of greatest -log10(FDR) * abs(difference), with whether their length keeps the reading frame."""
    score = -F.log10(F.greatest(F.col(fdr), F.lit(1e-300))) * F.abs(difference)
    return df.withColumn("priority", score).withColumn("in_frame", F.col(length) % 3 == 0).orderBy(F.col("priority").desc(), event).limit(top)


def chisq_to_q(df: DataFrame, *, chisq: str = "chisq", converged: str | None = None) -> DataFrame:
    """p of a chi-square of one degree and its BH value over the whole run; a row that didn't converge is an error."""
    if converged and not df.where(~F.coalesce(F.col(converged), F.lit(False))).isEmpty():
        raise ValueError("rows that did not converge")
    return adjust_p(df.withColumn("p", tails.chisq1_p(F.col(chisq).cast("double"))))
