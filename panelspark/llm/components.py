"""Connected components of a table of links, by rounds of joins.

Each round connects every node's neighbours to its smallest neighbour (large star, then small star);
a chain halves its length, so rounds grow with the logarithm of the longest path. Every round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import join_counted
from panelspark.session import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component), without the trivial ones, of links held in memory."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _shrink(links: DataFrame) -> DataFrame:
    """Replace the links of each Arrow batch by a forest with the same components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())],
                                             names=["a", "b"])
    return links.mapInArrow(run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b.

    Large: each node links its larger neighbours to the smallest of its neighbours and itself.
    Small: the same for its smaller neighbours and itself. The smallest neighbour is an aggregate
    that combines before the shuffle; the links of a node with very many are then split over salts.
    """
    if large:
        arcs = links.select(F.col("b").alias("n"), F.col("a").alias("o")).union(
            links.select(F.col("a").alias("n"), F.col("b").alias("o")))
        low = stage(arcs.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m"), F.count("*").alias("_n")), "lowest")
        out = join_counted(arcs.where("o > n"), low, "n", "o").select(F.col("o").alias("a"), F.col("m").alias("b"))
    else:
        low = stage(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")), "lowest")
        out = join_counted(links, low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of the links (a, b) but roots.

    Nodes are longs; self links and repeated links are fine; no links give no rows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(_shrink(pairs.distinct()).distinct(), "links")
    size = now.count()
    while True:
        before, before_size = now, size
        now = stage(_star(stage(_star(before, large=True), "links"), large=False), "links")
        size = now.count()
        # sets of equal size are equal when one holds the other
        if size == before_size and now.join(before, ["a", "b"], "left_anti").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
