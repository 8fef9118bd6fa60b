"""Connected components of pairs of any ordered type, by local forests and alternating stars.

Every edge is kept as (child, parent) with child > parent. In a round, tasks of
at most ``EDGES`` edges each replace theirs by a spanning forest of stars, then
each child moves to the least neighbour of its parent (large star), and the
parents of a child are tied to the least of them (small star). The stars are a
grouped minimum and a join, so a node with very many edges is aggregated in
part before the shuffle and its join can be split; long chains halve about
every round. It ends when one task held all edges, or when each child has one
parent and no parent is a child: the edges are then stars around the least node
of each component. Every round is written to the shared folder; nothing is
collected.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.scratch import Scratch

#: Edges that a task joins at once.
EDGES = 1_000_000


def _stars(up: dict):
    """Batches of (child, least node) of a union-find table."""
    u, v = [], []
    for x in up:
        r = x
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
    for x, r in up.items():
        if x != r:
            u.append(x)
            v.append(r)
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _forest(batches, most):
    """Star edges of the components within each ``most`` edges of a task."""
    up: dict = {}
    n = 0

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
        n += b.num_rows
        if n >= most:
            yield from _stars(up)
            up.clear()
            n = 0
    yield from _stars(up)


def _is_stars(e: DataFrame) -> bool:
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("child")), F.struct(F.col("v").alias("n"), F.lit(0).alias("child")))).alias("x"))
    g = ends.groupBy("x.n").agg(F.sum("x.child").alias("parents"), F.min("x.child").alias("least"))
    return g.where("parents > 1 or (parents = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, *, most_rounds: int = 100, edges_per_task: int | None = None) -> DataFrame:
    """(u, v) pairs to (node, component): the least node that each node reaches.

    Null ends, loops and repeated pairs are ignored; nodes without an edge to
    another node don't appear. More than ``most_rounds`` rounds are an error.
    """
    s, most = Scratch(edges.sparkSession, "components"), edges_per_task or EDGES
    spec = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in "uv")
    e = s.saved(edges.select("u", "v").dropna().where("u <> v"), "edges")
    for _ in range(most_rounds):
        tasks = -(-e.count() // most)
        local = s.saved(e.coalesce(max(1, tasks)).mapInArrow(partial(_forest, most=most), spec), "forest")
        s.drop(e)
        if tasks <= 1 or _is_stars(local):
            out = local.unionByName(local.select(F.col("v").alias("u"), "v").distinct())
            out = s.saved(out.select(F.col("u").alias("node"), F.col("v").alias("component")), "components", stays=True)
            s.close()
            return out
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = s.saved(local.join(near, "v").select("u", F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("_far"))
        ties = large.join(least.where("m <> _far").select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = s.saved(least.select("u", F.col("m").alias("v")).unionByName(ties).distinct(), "edges")
        s.drop(local)
        s.drop(large)
    raise RuntimeError("components did not end")


def components(pairs: DataFrame, nodes: DataFrame, *, a: str = "id_a", b: str = "id_b", key: str = "id", most_rounds: int = 100, edges_per_task: int | None = None) -> DataFrame:
    """(key, component): the least node that each of ``nodes`` reaches over the pairs, itself included."""
    found = connected_components(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")), most_rounds=most_rounds, edges_per_task=edges_per_task)
    return nodes.select(F.col(key).alias("node")).distinct().join(found, "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("component"))
