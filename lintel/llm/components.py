"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .shared import drop, if_small, settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components of some edges; the root is the smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        for side in (left, right):
            np.minimum.at(after, label[side], low)
            np.minimum.at(after, side, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each batch as a forest: cliques and repeated edges shrink before anything is shuffled."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = forest(*(np.asarray(batch.column(i)) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return each

    return map_batches(edges, "a long, b long", make)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots themselves; the root is the smallest node it reaches.

    Each round hangs the larger neighbours of a node, then its smaller ones and itself, under their smallest, and is
    written to the shared folder; the number of rounds grows with the logarithm of the nodes. No edges give no rows.
    """
    oriented = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = settle(oriented(_contracted(edges.select("a", "b"))).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written apart, so that the join with a centre of many edges can be broadcast, or split by partition
        lowest = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "edges-low")
        large = both.join(if_small(lowest), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "edges-large")
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "edges-low")
        small = large.join(if_small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        was, now = now, settle(small.where("a <> b").distinct(), "edges")
        drop(was, lowest, large, least)
