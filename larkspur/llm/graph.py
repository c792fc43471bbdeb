"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from larkspur.llm.store import cut, drop
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _contract(batches):
    """Replaces the edges of one Arrow batch by a forest with the same components."""
    for batch in batches:
        u, v = (np.asarray(batch.column(i)) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def _stars(batches):
    """(node, component) of all nodes on the edges of all batches."""
    held = [[np.asarray(batch.column(i)) for i in (0, 1)] for batch in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, in_task: int = 0) -> DataFrame:
    """(node, component) for each node on an edge between different nodes: component is the smallest node reachable.

    Large-star and small-star steps alternate until each component is a star around its smallest node. Each step
    is a partial minimum by node and a join on the node, so a node with very many edges is never held in one task.
    Edges with a null end and loops are ignored; repeated edges do no harm. Up to in_task edges, with those inside a batch
    reduced to a forest, one task takes all.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = ends.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long").distinct())
    if in_task and e.count() <= in_task:
        return e.coalesce(1).mapInArrow(_stars, "node long, component long")
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).withColumn("m", F.least("k", "m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        drop(e)
        drop(large)
        e = nxt
        n = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        if n["n"] == n["d"] and e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
