"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed


def spanning_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0..n-1 with edges (a[i], b[i]): each node's smallest reachable node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` for every node of ``edges(src, dst)``: the smallest node reachable.

    Alternates large-star and small-star steps. Both are joins of the edges with one minimum per
    node, so a node with very many neighbours is a skewed join, which AQE splits, and never a
    collected group; the minima are checkpointed, since AQE splits no join with an aggregate in it. An edge with a null end, or from a node to
    itself, is left out; an empty input gives an empty result. Node ids may be of any type that
    can be ordered.
    """
    now = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), "src", "dst")
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    now = checkpointed(now)
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(following)
        now = following
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
