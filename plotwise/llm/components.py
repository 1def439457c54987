"""Connected components of an edge table: contraction within tasks, then alternating stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.shared import saved

#: Edges that one task contracts at most (two 64-bit ids each).
TASK_EDGES = 1 << 18


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reachable) of the same components: minimum labels spread along edges, and each round jumps to the label's label."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:  # stars take no more room than their nodes, so a task's memory follows its nodes
        u, v = contract(np.concatenate((u, batch.column("u").to_numpy())), np.concatenate((v, batch.column("v").to_numpy())))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _star_round(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every neighbour that is larger is tied to a node's least neighbour, then every smaller one. Least neighbours are aggregated before they are joined."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the least node reachable.

    Edges are dealt to tasks of a bounded number, and each contracts what it has to stars.  Where several tasks were needed, alternating stars
    go on, each round written to the shared folder, until nothing moves: a number of rounds logarithmic in the size of a component."""
    edges = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "edges")
    tasks = -(-edges.count() // task_edges) or 1
    edges = saved(edges.repartition(tasks).mapInArrow(_contract_task, "u long, v long"), "edges")
    before = None
    while tasks > 1:
        edges = saved(_star_round(edges), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
