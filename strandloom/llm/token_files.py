"""Operator 1: token-id files with a shared Zstandard dictionary.

A shard file is, in order: an 8-byte magic, the width of an id in bytes, the
SHA-256 of the dictionary, one Zstandard frame per document, the index
(``INDEX`` records), and a trailer of index offset and document count. A
single document is read with three small reads: trailer, index, frame.

Documents are dealt by range of doc_id and hash of the text, so shards in order
of (part, seq) hold the documents in ascending doc_id order (null ids first,
ties by that hash), and rows that share an id are split like others. Null and
empty texts hold the end id alone. Repeated rows are kept; long texts are
whole. Other columns of the input are ignored; an empty table gives no files.

The dictionary is trained on a bounded sample (``sample_rows`` documents by
hash of doc_id, ``sample_ids`` ids of each); it only affects size, never
content.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import get_file, hash_share, open_fs, put_file, rows, scratch, tune
from strandloom.llm.words import encoder
from strandloom.scratch import Scratch

MAGIC = b"STRTOK01"
INDEX = np.dtype([("valid", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")])
HEAD = len(MAGIC) + 1 + 32
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long"


def encode_all(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, little-endian unsigned 32-bit ids with the end id) of (doc_id, text) batches."""
    encode, end = encoder(path), struct.pack("<I", end_id)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            yield doc_id, encode(text.as_py()) + end


def _sample(batches, path, end_id, most):
    for b in batches:
        out = [ids[: 4 * most] for _, ids in encode_all([b], path, end_id)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary, or no bytes where there are too few samples for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _narrow(ids: bytes, width: int) -> bytes:
    x = np.frombuffer(ids, "<u4")
    if width < 4 and len(x) and int(x.max()) >> (8 * width):
        raise ValueError(f"id {int(x.max())} doesn't fit {width} bytes")
    return x.astype(f"<u{width}").tobytes()


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class _Shard:
    def __init__(self, width: int, digest: bytes):
        self.parts, self.size, self.index, self.n_tokens = [MAGIC, bytes([width]), digest], HEAD, [], 0

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.index.append((doc_id is not None, doc_id or 0, self.size, len(frame), n))
        self.parts.append(frame)
        self.size += len(frame)
        self.n_tokens += n

    def bytes(self) -> bytes:
        return b"".join([*self.parts, np.array(self.index, INDEX).tobytes(), struct.pack("<QQ", self.size, len(self.index))])


def _write(batches, path, end_id, folder, dictionary, width, shard_bytes, level):
    import zstandard
    from pyspark import TaskContext

    task = TaskContext.get()
    data, digest = dictionary.value, hashlib.sha256(dictionary.value).digest()
    press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True, write_dict_id=False)
    done, shard, seq = [], _Shard(width, digest), 0

    def close():
        nonlocal shard, seq
        if shard.index:
            put_file(uri := f"{folder}/part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.tok", shard.bytes())
            done.append((task.partitionId(), seq, uri, len(shard.index), shard.n_tokens))
            shard, seq = _Shard(width, digest), seq + 1

    for doc_id, ids in encode_all(batches, path, end_id):
        shard.add(doc_id, press.compress(_narrow(ids, width)), len(ids) // 4)
        if shard.size >= shard_bytes:
            close()
    close()
    if done:
        cols = list(zip(*done))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["part", "seq", "path", "n_docs", "n_tokens"])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, dictionary_bytes: int = 65_536, sample_rows: int = 1_000, sample_ids: int = 4_096, shard_bytes: int = 32 << 20, width: int = 2, level: int = 3) -> tuple[DataFrame, str]:
    """Writes the files; returns the manifest (a row per shard) and the folder with the dictionary.

    ``width`` 2 holds ids below 65,536, else pass 4; a larger id is an error. A failed or repeated task
    leaves a file that the manifest doesn't name; readers go by the manifest.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = folder or scratch(spark, "tokens")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    share = sample_rows / max(1, d.count())
    some = d.where(hash_share("doc_id", 11) < share).limit(2 * sample_rows)
    samples = [_narrow(r[0], width) for r in some.mapInArrow(partial(_sample, path=tokenizer, end_id=end_id, most=sample_ids), "ids binary").collect()]
    data = train_dictionary(samples, dictionary_bytes)
    put_file(f"{folder}/dictionary-{hashlib.sha256(data).hexdigest()}.zdict", data)
    job = partial(_write, path=tokenizer, end_id=end_id, folder=folder, dictionary=spark.sparkContext.broadcast(data), width=width, shard_bytes=shard_bytes, level=level)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return Scratch(spark, "tokens").saved(dealt.mapInArrow(job, MANIFEST), "manifest", stays=True), folder


def parse(blob: bytes, dictionary: bytes) -> Iterator[tuple[int | None, bytes, int]]:
    """(doc_id, ids as unsigned 32-bit, frame size) of a shard in order."""
    import zstandard

    if blob[: len(MAGIC)] != MAGIC or blob[len(MAGIC) + 1 : HEAD] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    width, press = blob[len(MAGIC)], zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    at, n = struct.unpack("<QQ", blob[-16:])
    for valid, doc_id, offset, size, _ in np.frombuffer(blob, INDEX, count=n, offset=at).tolist():
        got = press.decompress(blob[offset : offset + size])
        yield (doc_id if valid else None), np.frombuffer(got, f"<u{width}").astype("<u4").tobytes(), size


def read_document(uri: str, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard: reads the trailer, the index and its frame only."""
    import zstandard

    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        end = f.size()
        at, n = struct.unpack("<QQ", f.read_at(16, end - 16))
        index = np.frombuffer(f.read_at(end - 16 - at, at), INDEX, count=n)
        hit = np.nonzero((index["doc_id"] == doc_id) & (index["valid"] == 1))[0]
        if not len(hit):
            return None
        x = index[hit[0]]
        width = f.read_at(1, len(MAGIC))[0]
        frame = f.read_at(int(x["size"]), int(x["offset"]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame), f"<u{width}").astype("<u4")


def _read(batches, dictionary):
    for b in rows(batches):
        for at, path in zip(b["base"], b["path"]):
            out = []
            for doc_id, ids, size in parse(get_file(path), dictionary.value):
                out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), size))
                at += len(ids) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in READ.split(", ")])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32, frame_bytes."""
    spark = manifest.sparkSession
    store, path = open_fs(folder)
    from pyarrow import fs

    name = next(x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".zdict"))
    data = get_file(f"{folder}/{name}")
    #: One row per shard file, not per document.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).repartition(max(1, min(manifest.count(), 10_000)))
    return shards.mapInArrow(partial(_read, dictionary=spark.sparkContext.broadcast(data)), READ)
