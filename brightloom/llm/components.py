"""Connected components of a graph given as edges, by contraction.

Each partition of edges first becomes a spanning forest of itself, so a hub or a clique is no longer than its nodes.
Then, in rounds, every node hooks to the neighbour with the least scrambled id and edges move to the hooks, until no
edge joins two different nodes. Scrambling makes long chains shrink geometrically. Each round is written to the shared
folder. Hubs are split by the join's skew handling: both sides of each join are freshly read tables.

Defined results: loops and repeated edges are allowed; null ends are dropped; without edges the result is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, saved


def _forest(batches):
    """Spanning forest of the edges in one partition, in flushes of bounded size."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (up := parent.get(top, top)) != top:
            top = up
        while v != top:
            parent[v], v = top, parent.get(v, v)
        return top

    def flush():
        nodes = list(parent)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(v) for v in nodes], pa.int64())], names=["a", "b"])
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
        if len(parent) > 500_000:
            yield flush()
    if parent:
        yield flush()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that edges reach, for every node with an edge to another."""
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    edge = saved(pairs.mapInArrow(_forest, "a long, b long").where("a != b").distinct(), "forest")
    # what follows has at most as many rows, so small graphs make few small files
    n = files_for(2 * edge.count())
    ends = edge.select("a").union(edge.select("b")).distinct()
    where = saved(ends.select(F.col("a").alias("node"), F.col("a").alias("at")).coalesce(n), "nodes")
    while not edge.isEmpty():
        both = edge.select("a", "b").union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # xxhash64 of a long is a bijection of the scrambled order's key only up to ties, which the id itself breaks
        least = both.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("low"))
        up = F.when(F.struct(F.xxhash64("low"), F.col("low")) < F.struct(F.xxhash64("a"), F.col("a")), F.col("low")).otherwise(F.col("a"))
        hook = saved(least.select(F.col("a").alias("v"), up.alias("to")).coalesce(n), "hooks")
        at_b = hook.select(F.col("v").alias("w"), F.col("to").alias("to_b"))
        moved = edge.join(hook, edge["a"] == hook["v"]).join(at_b, F.col("b") == F.col("w"))
        new_edge = saved(moved.select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).where("a != b").distinct().coalesce(n), "edges")
        new_where = saved(where.join(hook, where["at"] == hook["v"], "left").select("node", F.coalesce("to", "at").alias("at")).coalesce(n), "nodes")
        discard(edge, where, hook)
        edge, where = new_edge, new_where
    # a root may be far from the smallest member
    name = saved(where.groupBy("at").agg(F.min("node").alias("component")).coalesce(n), "names")
    return where.join(name, "at").select("node", "component")
