"""Connected components of an edge table: alternating large-star and small-star rounds, and a walk through the last edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import discard, materialise
from ledgerkit.llm.words import forget

#: Edges that a task holds at a time; as many at the end are walked through in one task.
WALK = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes of these edges in order, the smallest node that each reaches by them)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _contracted(most: int, roots: bool):
    """Edges of a task, ``most`` at a time -> a star for each component among them; with ``roots`` its centre is a row too."""

    def out(held):
        node, least = stars(*(np.concatenate(x) for x in zip(*held)))
        if not roots:
            leaf = node != least
            node, least = node[leaf], least[leaf]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"] if roots else ["u", "v"])

    def run(batches):
        forget()
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                u, v = (np.asarray(c.slice(at, most)) for c in batch.columns)
                if held and n + len(u) > most:
                    yield out(held)
                    held, n = [], 0
                held.append((u, v))
                n += len(u)
        if held:
            yield out(held)

    return run


def connected_components(edges: DataFrame, walk: int = WALK) -> DataFrame:
    """``edges`` (u, v) of longs -> (node, component): the smallest node that each node reaches.

    Up to ``walk`` edges are walked through in one task, without a shuffle. More are contracted in their tasks, ``walk``
    at a time, before each round. Every round is two aggregations and two joins over the edges. Nodes' edges are combined map-side
    before each shuffle, so the centre of a large star is no hot group of the aggregation; the join
    back on it is one that adaptive execution splits. The rounds needed grow with the logarithm of
    the longest chain. Empty edges give an empty result; loops and repeated edges change nothing.
    """
    current = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), "cc-edges")
    state = (current.count(), None)
    while state[0] > walk:
        near = materialise(current.mapInArrow(_contracted(max(walk, 1), False), "u long, v long").distinct(), "cc-near")
        both = near.select("u", "v").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Large star: every larger neighbour, and the node itself, is tied to the node's smallest neighbour.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        # Small star: smaller neighbours, and the node, are tied to the smallest of them.
        large = materialise(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = materialise(small, "cc-edges")
        discard(current, near, large)
        current, before, state = after, state, _state(after)
        if state == before:
            break
    if state[0] <= walk:
        return current.coalesce(1).mapInArrow(_contracted(max(walk, 1), True), "node long, component long")
    nodes = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
