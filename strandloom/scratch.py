"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Where neither is set, a local session (tests) gets a temporary folder; a
    cluster has no folder that all can read, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN or not os.path.isdir(_OWN["root"]):
        _OWN["root"] = tempfile.mkdtemp(prefix="spark-")
    return _OWN["root"]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path and all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The tables of one run of an operator.

    A table that is written and read back ends the lineage there: a lost
    executor costs no recomputation, and plans don't grow with rounds. ``close``
    removes the tables that the result doesn't read; those saved with ``stays``
    are left for as long as the result is in use.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def saved(self, df: DataFrame, name: str, *, stays: bool = False) -> DataFrame:
        path = f"{self.root}/{'out' if stays else 'tmp'}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((got, path))
        return got

    def drop(self, df: DataFrame) -> None:
        """Removes one table of this run before its end."""
        for got, path in self.paths:
            if got is df:
                remove(self.spark, path)

    def clear(self, *kept: DataFrame) -> None:
        """Removes the tables of this run so far but ``kept`` and those that stay."""
        left = []
        for df, path in self.paths:
            if "/tmp/" in path.removeprefix(self.root) and not any(df is k for k in kept):
                remove(self.spark, path)
            else:
                left.append((df, path))
        self.paths = left

    def close(self) -> None:
        remove(self.spark, f"{self.root}/tmp")
