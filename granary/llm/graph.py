"""Connected components of an edge table that no single machine holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, materialize, small_batches

#: Edges that one task joins by itself, at most (16 bytes each); more go through rounds of joins.
ONE_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint edges -> (node, root) for every node of an edge; root is the smallest node of its component.

    Up to ONE_TASK edges one task of an executor joins them all; the result is the same. Beyond, alternating large-star and small-star rounds (Kiveris et al., 2014). A round is aggregates and equi-joins; its result
    is a written table, so an executor that is lost costs one round at most. Loops and repeated edges are harmless; an
    empty table gives an empty table.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    if edges.count() <= ONE_TASK:
        small_batches(edges.sparkSession)
        return materialize(edges.coalesce(1).mapInArrow(_join_all, "node long, root long"), "components")
    size = _state(edges)
    while size[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges, before = materialize(small.distinct(), "edges"), edges
        discard(before)
        now = _state(edges)
        if now == size:
            break
        size = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _join_all(batches):
    """All edges of a small table -> (node, root). Each round hooks every root to a smaller one beside it and shortens the ways to the roots."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not sum(len(u) for u, _ in parts):
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        p, q = root[u], root[v]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(u, v, 7))")).first()
    return tuple(row)
