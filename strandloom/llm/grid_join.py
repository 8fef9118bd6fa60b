"""Operator 6: embedding near-duplicates by an epsilon grid order join.

Vectors of one label and dimension with cosine c or more lie, scaled to length
one, within eps = sqrt(2 - 2c) of each other. They are projected on leading
principal directions (fitted on a bounded sample; any directions give right
results), sorted by the cells of a grid of width eps on them, and cut into
intervals of the sequence. Boxes of intervals form a tree; pairs of nodes are
descended from the roots with Spark joins, and those whose boxes are more than
eps apart are dropped with all below them. The pairs of intervals that remain
are dealt by blocks of ``RUN`` successive intervals, so that an interval's
vectors go once to each block it meets; a task halves the pairs further by the
same rule down to ``LEAF`` vectors and then compares in double precision.

Equal vectors of one label are one representative with a count, so copies are
never expanded into pairs. A task returns, for its pair of intervals, the
number of links of each representative and a spanning forest of its links,
not the links: rows grow with vectors times neighbouring intervals, while
``n_links`` stays exact and components lose nothing.

A vector with null label, null, without components, zero, or with a null or
non-finite component, and a row with null id, link with nothing. Labels are
compared as they are, whatever their type. Repeated rows
are vectors of their own, each with its links; rows of one id are one node of
the components. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import hash_share, tune
from strandloom.llm.components import forest
from strandloom.operators.components import connected_components
from strandloom.scratch import Scratch

AXES = 8
#: Numbers and vectors in an interval at most; intervals in a block.
INTERVAL_NUMBERS, INTERVAL, RUN = 65_536, 1024, 8
LEAF = 128
FAN = 16
UNITS = "vec_id long, label {label}, dim int, h1 long, h2 long, vector binary"
SEQUENCE = "interval long, label {label}, dim int, ids binary, marks binary, counts binary, vectors binary, lo array<double>, hi array<double>"


def unit(rows: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Vectors of one dimension, as stored, scaled to length one in double precision."""
    x = np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(float)
    #: Scaled first, so that the squares of very large or small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ready(batches, kind, label_type):
    """The vectors that can link, with a digest; -0.0 is 0.0."""
    for b in batches:
        out = []
        for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i is None or label is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, kind) + np.zeros(1, kind)
            if not np.isfinite(x).all() or not x.any():
                continue
            raw = x.tobytes()
            out.append((i, label, len(x), *struct.unpack("<qq", hashlib.blake2b(raw, digest_size=16).digest()), raw))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), label_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in UNITS.split(", ")])


def principal(x: np.ndarray, axes: int) -> np.ndarray:
    """Leading principal directions (rows) of a sample of vectors of one dimension."""
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:axes]


def _axes(dim: int, directions: dict[int, np.ndarray], axes: int) -> np.ndarray:
    return directions[dim] if dim in directions else np.eye(dim)[:axes]


def _cells(batches, directions, eps, axes, kind):
    d = directions.value
    for b in batches:
        dims, raw = np.array(b.column(1).to_pylist(), int), b.column(5).to_pylist()
        cells: list = [None] * len(raw)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim).tolist()
            p = unit([raw[k] for k in at], kind, dim) @ _axes(dim, d, axes).T
            for k, c in zip(at, np.floor(p / eps).astype(int).tolist()):
                cells[k] = c
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*b.schema.names, "cell"])


def _box(x: np.ndarray, axes: np.ndarray):
    p = x @ axes.T
    return p.min(axis=0), p.max(axis=0)


def _intervals(batches, directions, axes, kind, label_type):
    from pyspark import TaskContext

    part, seq, d = TaskContext.get().partitionId(), 0, directions.value
    held, key = [], None

    def close():
        nonlocal seq
        ids, counts, marks, raw = zip(*held)
        lo, hi = _box(unit(list(raw), kind, key[1]), _axes(key[1], d, axes))
        pad = [0.0] * (axes - len(lo))
        row = [(part << 33) + seq, *key, *(np.array(x, "<i8").tobytes() for x in (ids, marks, counts)), b"".join(raw), [*lo.tolist(), *pad], [*hi.tolist(), *pad]]
        seq += 1
        kinds = [pa.int64(), label_type, pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in SEQUENCE.split(", ")])

    for b in batches:
        for label, dim, *row in zip(*(b.column(k).to_pylist() for k in range(6))):
            if held and ((label, dim) != key or len(held) >= max(LEAF, min(INTERVAL, INTERVAL_NUMBERS // dim))):
                yield close()
                held = []
            key = (label, dim)
            held.append(row)
    if held:
        yield close()


def _apart(a, b, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > eps * eps + 1e-9


def _join(x, y, at, same, axes, cosine, eps, found):
    """Recursive join of two runs of vectors: appends (row in x, row in y) of links."""
    (xl, xh), (yl, yh) = at
    if _apart(_box(x[xl:xh], axes), _box(y[yl:yh], axes), eps):
        return
    if xh - xl > LEAF or yh - yl > LEAF:
        xs = [(xl, xh)] if xh - xl <= LEAF else [(xl, (xl + xh) // 2), ((xl + xh) // 2, xh)]
        ys = [(yl, yh)] if yh - yl <= LEAF else [(yl, (yl + yh) // 2), ((yl + yh) // 2, yh)]
        for p in xs:
            for q in ys:
                if not same or p[0] <= q[0]:
                    _join(x, y, (p, q), same, axes, cosine, eps, found)
        return
    hit = x[xl:xh] @ y[yl:yh].T >= cosine
    i, j = np.nonzero(hit)
    i, j = i + xl, j + yl
    if same:
        i, j = i[i < j], j[i < j]
    if len(i):
        found.append((i, j))


def _met(x, y, same, axes, cosine, eps):
    """(rep, mark, links, root) of the links between two intervals (unit vectors, ids, marks, counts)."""
    found: list = []
    _join(x[0], y[0], ((0, len(x[0])), (0, len(y[0]))), same, axes, cosine, eps, found)
    if not found:
        return None
    i, j = (np.concatenate(k) for k in zip(*found))
    _, ids, marks, counts = x
    if not same:
        j = j + len(ids)
        ids, marks, counts = (np.r_[a, b] for a, b in zip(x[1:], y[1:]))
    links = np.bincount(i, counts[j], minlength=len(ids)) + np.bincount(j, counts[i], minlength=len(ids))
    at = np.flatnonzero(links)
    node, root = forest(i, j, len(ids))
    up = np.arange(len(ids))
    up[node] = root
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(marks[at]), pa.array(links[at].astype(np.int64)), pa.array(ids[up[at]])], names=["rep", "mark", "links", "root"])


def _blocks(batches, directions, axes, cosine, eps, kind):
    """Rows (x, y, interval, dim, partners, ids, marks, counts, vectors) of one (x, y) follow each other and are joined together."""
    d = directions.value
    key, held = None, {}

    def joined():
        for a, (dim, partners, own) in held.items():
            for b in sorted(partners):
                got = _met(own, held[b][2], a == b, _axes(dim, d, axes), cosine, eps)
                if got is not None:
                    yield got

    for batch in batches:
        for x, y, interval, dim, partners, ids, marks, counts, raw in zip(*(batch.column(k).to_pylist() for k in range(9))):
            if (x, y) != key:
                yield from joined()
                key, held = (x, y), {}
            held[interval] = (dim, partners, (unit([raw], kind, dim), *(np.frombuffer(v, "<i8") for v in (ids, marks, counts))))
    yield from joined()


def _tree_pairs(s: Scratch, leaves: DataFrame, eps: float) -> DataFrame:
    """(a, b) pairs of intervals whose boxes are within eps, found from the roots of the tree of boxes downwards."""
    w = Window.partitionBy("label", "dim").orderBy("interval")
    box = [F.col("lo")[k].alias(f"lo{k}") for k in range(AXES)] + [F.col("hi")[k].alias(f"hi{k}") for k in range(AXES)]
    #: One row per interval of INTERVAL vectors, not per vector.
    n = s.saved(leaves.select("interval", "label", "dim", (F.row_number().over(w) - 1).alias("node"), *box), "boxes")
    depth, top = 0, n.agg(F.max("node")).first()[0] or 0
    while top >= FAN ** (depth + 1):
        depth += 1

    def level(k: int) -> DataFrame:
        g = F.floor(F.col("node") / F.lit(FAN**k)).cast("long")
        return n.groupBy("label", "dim", g.alias("at")).agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(AXES)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(AXES)], F.min("interval").alias("interval"))

    def near(a: str, b: str):
        gaps = [F.greatest(F.lit(0.0), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}"), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}")) for i in range(AXES)]
        return sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps + 1e-9

    def met(a: DataFrame, b: DataFrame, on) -> DataFrame:
        return a.alias("a").join(b.alias("b"), on).where((F.col("a.at") <= F.col("b.at")) & near("a", "b"))

    root = level(depth)
    key = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
    pairs = met(root, root, key)
    for k in range(depth - 1, -1, -1):
        kids = level(k).withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        p = s.saved(pairs.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.at").alias("pa"), F.col("b.at").alias("pb")), "pairs")
        left = p.alias("p").join(kids.alias("k"), (F.col("p.label") == F.col("k.label")) & (F.col("p.dim") == F.col("k.dim")) & (F.col("p.pa") == F.col("k.up"))).select("k.*", "p.pb")
        pairs = met(left, kids, key & (F.col("a.pb") == F.col("b.up")))
    return pairs.select(F.col("a.interval").alias("a"), F.col("b.interval").alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", axes: int = AXES, sample_rows: int = 4_096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    tune(spark)
    s = Scratch(spark, "grid_join")
    eps = float(np.sqrt(2 - 2 * cosine))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kind = "<f4" if v.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    own_type = v.schema["label"].dataType
    label, label_type = own_type.simpleString(), to_arrow_type(own_type)
    units = s.saved(v.mapInArrow(partial(_ready, kind=kind, label_type=label_type), UNITS.format(label=label)), "units", stays=True)
    same = ["label", "dim", "h1", "h2"]
    groups = units.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    #: Written first, so that the joins have plain inputs and Spark can split a vector that many rows share.
    groups = s.saved(groups, "groups", stays=True)
    first = units.join(groups, same).where("vec_id = rep").dropDuplicates(same)
    lone = units.join(groups, same, "left_anti").withColumn("rep", F.col("vec_id")).withColumn("n", F.lit(1).cast("long"))
    reps = s.saved(lone.unionByName(first).select("label", "dim", "rep", "n", "h1", "vector"), "reps")
    share = sample_rows / max(1, reps.count())
    by_dim: dict[int, list[bytes]] = {}
    for dim, u in reps.where(hash_share("rep", 6) < share).select("dim", "vector").limit(2 * sample_rows).collect():
        by_dim.setdefault(dim, []).append(bytes(u))
    directions = spark.sparkContext.broadcast({dim: principal(unit(x, kind, dim), axes) for dim, x in by_dim.items() if len(x) > axes})
    celled = reps.mapInArrow(partial(_cells, directions=directions, eps=eps, axes=axes, kind=kind), f"label {label}, dim int, rep long, n long, h1 long, vector binary, cell array<long>")
    order = ["label", "dim", "cell", "rep"]
    leaves = s.saved(celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_intervals, directions=directions, axes=axes, kind=kind, label_type=label_type), SEQUENCE.format(label=label)), "intervals")
    p = s.saved(_tree_pairs(s, leaves.select("interval", "label", "dim", "lo", "hi"), eps), "interval_pairs")
    run = lambda c: F.floor(F.col(c) / F.lit(RUN)).cast("long")
    each = p.select(run("a").alias("x"), run("b").alias("y"), "a", "b")
    each = each.select("x", "y", F.col("a").alias("interval"), F.col("b").alias("partner")).unionByName(each.select("x", "y", F.col("b").alias("interval"), F.lit(None).cast("long").alias("partner")))
    met = each.groupBy("x", "y", "interval").agg(F.collect_list("partner").alias("partners"))  # RUN partners at most
    j = met.join(leaves, "interval").select("x", "y", "interval", "dim", "partners", "ids", "marks", "counts", "vectors")
    j = j.repartition("x", "y").sortWithinPartitions("x", "y", "interval")
    found = s.saved(j.mapInArrow(partial(_blocks, directions=directions, axes=axes, cosine=cosine, eps=eps, kind=kind), "rep long, mark long, links long, root long"), "links", stays=True)
    comp = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    s.close()
    own = units.select("vec_id", *same).join(groups, same, "left").select("vec_id", F.col("h1").alias("mark"), F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
    links = found.groupBy("rep", "mark").agg(F.sum("links").alias("links"))
    out = own.join(links, ["rep", "mark"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.unionByName(_unlinked(v)).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _unlinked(v: DataFrame) -> DataFrame:
    """The rows that link with nothing; the same rule as ``_ready``."""
    x = F.col("embedding")
    big = F.array_max(F.transform(x, lambda e: F.abs(e.cast("double"))))
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    out = F.col("vec_id").isNull() | F.col("label").isNull() | x.isNull() | (F.size(x) == 0) | odd | (big == 0)
    return v.where(F.coalesce(out, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
