"""Connected components by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import pinned
from tollgate.operators.skew import join_keys


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges(a, b)`: equal labels for connected nodes.

    In each round every node moves to the neighbour (or stays) that has the smallest hash of this round; edges follow, loops and
    repeats go. A chain shrinks by a constant share in a round on average, whatever its order, and so does a star, so the rounds
    grow with the logarithm of the longest component. Minima are taken before the shuffle, so a hub does no harm.
    """
    edges = pinned(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    number = 0
    while not edges.isEmpty():
        number += 1
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        order = [F.struct(F.xxhash64(F.lit(number), x).alias("h"), F.col(x).alias("to")) for x in ("a", "b")]
        moves = pinned(both.groupBy("a").agg(F.least(F.min(order[1]), F.min(order[0])).alias("m"))
                       .select(F.col("a").alias("node"), F.col("m.to").alias("to")))
        if labels is None:
            labels = moves.withColumnRenamed("to", "label")
        else:
            moved = join_keys(labels, moves.withColumnsRenamed({"node": "label", "to": "next"}), "label")
            labels = pinned(moved.select("node", F.coalesce("next", "label").alias("label")))
        first = join_keys(edges, moves.withColumnsRenamed({"node": "a", "to": "x"}), "a")
        second = join_keys(first, moves.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = pinned(second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge to the smallest node of its component for every other node of the edges (a, b)."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
