"""Shared binary files and small Arrow helpers of the operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.scratch import shared_root

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that the caller keeps."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker holds a few long texts at a time.

    The setting stays lowered in the caller's session: results are lazy, and
    are computed after an operator returns.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 256:
        spark.conf.set(key, "256")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of a key written as text, modulo ``modulus``: the fold of a row (null keys: fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def hash_share(column: str, seed: int = 0):
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for b in batches:
        if b.num_rows:
            yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}


_CUT = re.compile(r"\s")


def segments(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces cut after white space where there is any, so that memory stays bounded."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end > at and not text[end - 1].isspace():
            end -= 1
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's URI (file, hdfs, viewfs, s3, gs, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file under another name and moves it into place."""
    store, path = open_fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
