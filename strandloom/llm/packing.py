"""Operator 4: shortest-pack-first packing over the length histogram.

1. Each document is tokenised and cut into pieces of ``length`` tokens and a
   rest; a task notes for each piece how many pieces of that length it had
   before (its local rank).
2. Counts by (length, task) give each task's first rank of a length, and the
   histogram, which has at most ``length`` rows, goes to the driver.
3. There, lengths are placed longest first, each time into the open patterns
   with the most room (the shortest packs), a whole group of equal packs at
   once; where none has room, new packs are opened holding as many pieces of
   that length as fit.
4. A pattern is a list of runs (length, first rank, packs, copies, offset);
   a piece finds its run by its length and rank. A pack holds at most
   sqrt(2 * length) different lengths and there are at most 2 * length
   patterns, so the broadcast runs are bounded by the sequence length alone
   (30 MB at 4,096), whatever the input.

Null or empty texts are one piece with the end id; repeated rows are kept and
packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import tune
from strandloom.llm.token_files import encode_all
from strandloom.scratch import Scratch

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"


def _pieces(batches, path, end_id, most, keep):
    from pyspark import TaskContext

    part, seen, names = TaskContext.get().partitionId(), {}, [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 6, *([pa.binary()] if keep else [])]
    for b in batches:
        out = []
        for doc_id, ids in encode_all([b], path, end_id):
            n = len(ids) // 4
            for at in range(0, n, most):
                cut = ids[4 * at : 4 * (at + most)]
                k = len(cut) // 4
                rank = seen.get(k, 0)
                seen[k] = rank + 1
                out.append((part, doc_id, at, k, zlib.crc32(cut), n, rank, *([cut] if keep else [])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names + ["ids"] * keep)


def shortest_pack_first(histogram: dict[int, int], most: int) -> np.ndarray:
    """Runs (length, first rank, packs, copies, first sequence, offset), sorted, for counts by length."""
    open_packs: list[tuple[int, int, int]] = []  # (-room, number, packs); runs of each by number
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # number: (length, rank, copies, offset) for all its packs
    count: dict[int, int] = {}
    number = 0

    def push(room: int, k: int) -> None:
        if room > 0:
            heapq.heappush(open_packs, (-room, k))

    def add(k: int, length: int, rank: int, copies: int, offset: int) -> None:
        runs[k].append((length, rank, copies, offset))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, k = heapq.heappop(open_packs)
                room, n = -room, count[k]
                if n > left:  # the rest of the group stays as it is
                    number += 1
                    runs[number], count[number] = [(a, r + left * c, c, o) for a, r, c, o in runs[k]], n - left
                    push(room, number)
                    count[k] = n = left
                #: As many copies at once as keep these packs the shortest.
                nxt = -open_packs[0][0] if open_packs else 0
                copies = max(1, min(left // n, room // length, (room - max(nxt, 0)) // length or 1))
                add(k, length, rank, copies, most - room)
                rank, left = rank + n * copies, left - n * copies
                push(room - copies * length, k)
                continue
            copies = min(most // length, left)
            n = left // copies
            number += 1
            runs[number], count[number] = [], n
            add(number, length, rank, copies, 0)
            rank, left = rank + n * copies, left - n * copies
            push(most - copies * length, number)
    out, first = [], 0
    for k in sorted(runs):
        out += [(length, rank, count[k], copies, first, offset) for length, rank, copies, offset in runs[k]]
        first += count[k]
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _place(batches, runs):
    r = runs.value
    for b in batches:
        if not b.num_rows:
            continue
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        lo, hi = np.searchsorted(r[:, 0], length), np.searchsorted(r[:, 0], length, "right")
        #: Runs of a length follow each other by rank: the last that begins at or before the rank.
        key = r[:, 0] * (1 << 44) + r[:, 1]
        at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
        assert ((at >= lo) & (at < hi)).all()
        x = r[at]
        #: Ranks of a run go pack by pack: ``copies`` in each.
        pack, nth = np.divmod(rank - x[:, 1], x[:, 3])
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(x[:, 4] + pack), pa.array(x[:, 5] + nth * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if kept)."""
    spark = docs.sparkSession
    tune(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = Scratch(spark, "packing")
    p = s.saved(d.mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, most=length, keep=keep_ids), PIECES + (", ids binary" if keep_ids else "")), "pieces", stays=True)
    per_task = s.saved(p.groupBy("length", "part").count(), "lengths", stays=True)
    histogram = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("count")).collect()}
    runs = spark.sparkContext.broadcast(shortest_pack_first(histogram, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    ranked = p.join(base, ["length", "part"]).select(*own, (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(partial(_place, runs=runs), PIECES.split(", ", 1)[1].rpartition(",")[0] + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences (``pack(..., keep_ids=True)``): sequence_id, n_tokens, ids; a group holds one sequence at most."""
    g = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return g.select("sequence_id", "n_tokens", F.expr("aggregate(x, cast('' as binary), (a, e) -> a || e.ids)").alias("ids"))
