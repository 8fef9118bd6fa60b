"""Bounded samples of labelled documents, for the two trained classifiers.

Null ids, null labels and labels other than 0 and 1 teach nothing; an id with
both labels counts as 1. Repeated rows of an id count once, and unlike texts of
one id are rows of their own under the same bound. Null and empty texts are
kept (they have no words); long texts are whole; columns other than id and text
are ignored; without labels or documents the sample is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.scratch import Scratch


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label_col: str, per_class: dict[int, int], fold=None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, y, weight, text) of the ``per_class`` ids of each class with the least hash.

    Labels are taken where ``fold`` holds (a condition on the id). The ids
    drawn are at most the sum of ``per_class``, so they are broadcast to the
    scan of the texts and only the texts drawn are shuffled. ``weight``
    restores the share of the classes. ``bounded`` bounds the rows.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    own = (own.where(fold) if fold is not None else own).groupBy("doc_id").agg(F.max("y").alias("y"))
    size = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    drawn = None
    for y, most in per_class.items():
        n = size.get(y, 0)
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        part = part.withColumn("weight", F.lit(n / max(1, min(n, most))))
        drawn = part if drawn is None else drawn.unionByName(part)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    j = d.join(F.broadcast(drawn), "doc_id").withColumn("_h", F.xxhash64("text"))
    return j.dropDuplicates(["doc_id", "_h"]).select("doc_id", "y", "weight", "text")


def bounded(s: Scratch, features: DataFrame, per_class: dict[int, int], seed: int = 0) -> DataFrame:
    """At most ``per_class`` rows of each class of (doc_id, y, ...) in one partition, whatever repeats of an id came along."""
    f, out = s.saved(features, "features"), None
    for y, most in per_class.items():
        part = f.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", F.xxhash64("idx")).limit(most)
        out = part if out is None else out.unionByName(part)
    return out.coalesce(1)
