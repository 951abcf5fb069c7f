"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import cut, drop


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges, and the least node each reaches through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def spanning(batches: Iterator[pa.RecordBatch], rows: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect what a partition's edges connect: one a node at most, whatever the number of edges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def contract() -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = _roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return nodes[nodes != roots], roots[nodes != roots]

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n > rows:
            held = [contract()]
            n, rows = len(held[0][0]), max(rows, 2 * len(held[0][0]))
    if n:
        a, b = contract()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the least node of its component.

    Large-star joins each node's larger neighbours to its least neighbour, small-star the smaller ones, until nothing changes; the rounds grow with the logarithm of the largest component. Each round is a table in the shared folder. No edges, no rows; loops and repeated edges are harmless; null ends are dropped.
    """
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").mapInArrow(spanning, "a long, b long"), "edges")
    last = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: the lesser neighbours of a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now, before = cut(small, "edges"), now
        drop(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(now.select("b", "b").distinct())
