"""Connected components of an edge table by alternating star contractions, in tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Edges that a task holds before it shrinks them to a forest.
HELD = 500_000
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches over the edges (a, b): label passing with pointer jumps."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, as one edge for each node that is not a root; worked off in bounded steps."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def shrunk() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = nodes != root
        return nodes[keep], root[keep]

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held.append((a, b))
        size += len(a)
        if size > HELD:
            held = [shrunk()]
            size = 0
    if held:
        a, b = shrunk()
        if not len(a):
            return
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIR)


#: So many edges are contracted by one task (16 bytes each); more go through rounds of star contractions.
TASK_EDGES = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long) that is not the smallest of its component.

    Each partition first shrinks to a spanning forest.  While more than TASK_EDGES edges
    are left, large-star and small-star steps run, until the edges stay the same; what
    one task can hold is finished by one task.  Sums and minima are combined before the
    shuffle, and joins may be split by Spark, so a hub of any degree does no harm.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").mapInArrow(forest, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    mark: tuple = ()
    while (size := now.count()) > TASK_EDGES:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mid, mid_path = written(large, "edges")
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new, new_path = written(small, "edges")
        removed(spark, mid_path)
        removed(spark, path)
        now, path, before, mark = new, new_path, mark, tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before:
            break
    if size <= TASK_EDGES:
        done, _ = written(now.coalesce(1).mapInArrow(forest, "a long, b long"), "components")
        removed(spark, path)
        now = done
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
