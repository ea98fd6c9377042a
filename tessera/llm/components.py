"""Connected components of a distributed edge list, by rounds of contraction.

First each task replaces every batch of its edges by a spanning star forest (union-find over one batch). Then, round by
round, every node points at its least neighbour, two hops are followed, and the edges are renamed to where
their ends point; edges inside one node vanish. A round leaves at most about half of the nodes, so a few suffice.
Each round's tables are written to the shared folder: lineage stays short and a lost executor costs a retry.
Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # least label over the edges, then shortcuts, until nothing changes
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, root = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(root[keep], pa.int64())], ["a", "b"])


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """node, root for every node with an edge; root is the least node of its component.

    `edges` has two long columns; null ends and loops are left out. Materialized.
    """
    a, b = edges.columns
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    left = materialize(left.mapInArrow(_stars, "a long, b long").distinct(), label)
    found = materialize(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("root")), label)
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        point = materialize(point, label)
        hop = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
        root = materialize(point.join(hop, "p").select("a", F.col("q").alias("r")), label)
        ra, rb = root.withColumnRenamed("r", "ra"), root.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        fewer = left.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        moved = found.join(root.select(F.col("a").alias("root"), "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
        old = [left, found, point, root]
        left, found = materialize(fewer, label), materialize(moved, label)
        for t in old:
            drop_materialized(t)
    return found
