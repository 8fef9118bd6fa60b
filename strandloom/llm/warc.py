"""Operator 7: WARC archives with a Zstandard dictionary in a leading skippable frame.

Each ``.warc.zst`` file begins with a skippable frame (magic 0x184D2A5D) that
holds the dictionary; every record after it is one Zstandard frame made with
that dictionary, so a record is read on its own. The dictionary is trained on
a bounded sample of records (``sample_rows``, ``sample_bytes`` of each).

Of records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is a response; the others are revisits without payload that
refer to it. Groups of equal payloads are found by (digest, least page_id)
alone, with partial aggregation; pages go through one join on the digest whose
large keys Spark can split.

Null html is an empty payload; a null url is written as an empty target. Null
page_ids are never the smallest unless a group has no other; then its records
are all responses. Rows that repeat the smallest page_id are all responses.
Other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import hash_share, open_fs, put_file, rows, scratch, tune
from strandloom.llm.token_files import train_dictionary
from strandloom.scratch import Scratch

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    target = "".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _sample(batches, most, date):
    for b in rows(batches):
        out = []
        for i, url, html in zip(b["page_id"], b["url"], b["html"]):
            p = _bytes_of(html)
            out.append(record(i, url, p, hashlib.sha256(p).hexdigest(), len(p), None, date)[:most])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])


def _write(batches, folder, dictionary, date, file_bytes, level):
    import zstandard
    from pyspark import TaskContext

    task, data = TaskContext.get(), dictionary.value
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_content_size=True)
    start = struct.pack("<II", SKIPPABLE, len(data)) + data
    parts, size, n, done = [start], len(start), 0, []

    def close():
        nonlocal parts, size, n
        if n:
            put_file(uri := f"{folder}/pages-{task.partitionId():06d}-{len(done):05d}-{task.taskAttemptId()}.warc.zst", b"".join(parts))
            done.append((uri, n, size))
        parts, size, n = [start], len(start), 0

    for b in batches:
        ids, urls, digests, refers = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
        sizes, html = b.column(b.schema.get_field_index("payload_bytes")).to_pylist(), b.column(b.schema.get_field_index("html"))
        for i, url, digest, k, refer, h in zip(ids, urls, digests, sizes, refers, html):
            frame = press.compress(record(i, url, b"" if refer is not None else _bytes_of(h.as_py()), digest, k, refer, date))
            parts.append(frame)
            size, n = size + len(frame), n + 1
            if size >= file_bytes:
                close()
    close()
    if done:
        cols = list(zip(*done))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "n_records", "bytes"])


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, refers_to (null: a response)."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    large = p.where(F.col("payload_bytes") >= least).select("digest", "page_id")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    #: Written first, so that the join has two plain inputs and Spark can split a digest that many pages share.
    groups = Scratch(pages.sparkSession, "warc").saved(groups.select("digest", "first_id"), "groups", stays=True)
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    j = p.join(groups, "digest", "left")
    return j.select("page_id", "url", F.when(~other, F.col("html")).alias("html"), "digest", "payload_bytes", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least: int = 100, dictionary_bytes: int = 65_536, sample_rows: int = 800, sample_bytes: int = 16_384, file_bytes: int = 32 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; returns their manifest (a row per file). Files of failed attempts aren't in it."""
    spark = pages.sparkSession
    tune(spark)
    folder = folder or scratch(spark, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    share = sample_rows / max(1, p.count())
    some = p.where(hash_share("page_id", 7) < share).limit(2 * sample_rows)
    data = train_dictionary([r[0] for r in some.mapInArrow(partial(_sample, most=sample_bytes, date=date), "r binary").collect()], dictionary_bytes)
    job = partial(_write, folder=folder, dictionary=spark.sparkContext.broadcast(data), date=date, file_bytes=file_bytes, level=level)
    return Scratch(spark, "warc").saved(with_revisits(p, least).mapInArrow(job, MANIFEST), "manifest", stays=True)


def records(uri: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    store, path = open_fs(uri)
    with store.open_input_stream(path, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError("no leading dictionary frame")
        data = f.read(n)
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        held = f.read(chunk)
        while held:
            one, out = press.decompressobj(), []
            while not one.eof:
                if not held:
                    raise EOFError(uri)
                out.append(one.decompress(held))
                held = one.unused_data if one.eof else f.read(chunk)
            yield b"".join(out)
            held = held or f.read(chunk)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, record type, refers_to); a response's are those of its body."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "revisit":
        size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        return _number(fields["WARC-Record-ID"]), size, digest, kind, _number(fields["WARC-Refers-To"])
    own = hashlib.sha256(payload).hexdigest()
    if own != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return _number(fields["WARC-Record-ID"]), len(payload), own, kind, None


def _read(batches, size=1024):
    names, kinds = [x.split()[0] for x in READ.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in rows(batches):
        for path in b["path"]:
            out = []
            for r in records(path):
                out.append(parse(r))
                if len(out) == size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(_read, READ)
