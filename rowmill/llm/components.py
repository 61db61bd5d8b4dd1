"""Connected components: in one task where the graph is small, else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.shared import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0


def reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches):
    found = list(batches)
    if found:
        table = pa.Table.from_batches(found)
        nodes, labels = reached(table["u"].to_numpy(), table["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def components(edges: DataFrame, local: int = 1_000_000) -> DataFrame:
    """``edges`` (u long, v long) -> (node, label): the smallest node reachable, for each node with an edge.

    A graph of at most ``local`` edges, which have been counted, is settled by one executor task (some 50 MB). In a
    larger one each step rewrites the edge table in the shared folder; no neighbour list is gathered,
    so a hub with any number of edges is only a key of a partial aggregate and of a skew-splittable join.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "cc")
    state = _state(e)
    if state[0] <= local:
        return e.coalesce(1).mapInArrow(_in_one_task, "node long, label long")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small, "cc")
        before, state = state, _state(e)
        if before == state:
            break
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
