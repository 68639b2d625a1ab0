"""Connected components of an edge table.

Every round contracts the edges of each partition where they lie, in slices of
SLICE edges, to links to the smallest node of a slice's components, and then
takes a large-star and a small-star step over all partitions. The same rounds
run at every size; they end when the links are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import few, materialize

#: Edges that a task holds at a time (16 bytes each).
SLICE = 1 << 20


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and v of links to the smallest node of each component of a slice of the edges (u, v)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        nodes, label = settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
        inner = nodes != label
        return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(label[inner])], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= SLICE:
            yield made()
            held = []
    if held:
        yield made()


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of every node of edges (a, b); nodes without edges are not listed.

    A large-star step links every larger neighbour of a node to the smallest
    node around it, a small-star step the smaller ones; both keep components.
    The number of rounds grows with the logarithm of the longest path at most.
    Edges are made distinct in each round and written to the shared folder. The
    joins are on edges made distinct and can be split where one node has very
    many neighbours. No step has more than twice the rows of edges.
    """
    most = 2 * edges.count()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        now = materialize(few(now, most).mapInArrow(_contracted, "u long, v long"), "contracted")
        tops = now.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("most"))
        inner = now.select(F.col("v").alias("u")).distinct().withColumn("inner", F.lit(True))
        if not tops.join(inner, "u", "left").where("v <> most OR inner").take(1):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star", most)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small.select("e.u", "e.v").where("u <> v").distinct()
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
