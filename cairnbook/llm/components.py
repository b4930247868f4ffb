"""Connected components of an edge table.

Cases: a table without edges names no component; an edge from a node to itself, or given twice, changes nothing; nodes are never null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.shared import returned, stored, trimmed

PER_TASK = 500_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each node that is not the smallest of its component, and that smallest node."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def _contracted(edges: DataFrame, tasks: int, name: str) -> DataFrame:
    """The edges of each task as stars; components stay the same, at most one edge per node and task is left."""

    def run(batches):
        parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in trimmed(batches)]
        if parts:
            a, b = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            del parts, a, b
            returned()

    return stored(edges.coalesce(tasks).mapInArrow(run, "a long, b long"), name)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges between longs, root the smallest node it reaches.

    Tasks of about PER_TASK edges first contract what they hold.  If that took more than one task, large-star and
    small-star steps follow in turn, with such contractions between: each keeps the components, gives every node
    at most one smaller neighbour in the end, and never gathers a node's neighbours in one row (minima are
    aggregated, then joined back, so that a node of many neighbours can be split by the join).
    """
    now = stored(_ordered(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))), name)
    tasks = max(1, -(-now.count() // PER_TASK))
    now = _contracted(now, tasks, name)
    while tasks > 1:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(_ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), name)
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        now = stored(_ordered(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))).distinct(), name)
        # done when the edges are stars: nobody has two smaller neighbours and no root has a smaller one
        if not now.groupBy("a").count().where("count > 1").limit(1).count() and not now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
        tasks = max(1, -(-now.count() // PER_TASK))
        now = _contracted(now, tasks, name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller node; none from a node to itself."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
