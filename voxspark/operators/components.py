"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the links a-b of one task: a spanning star of each component, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every linked node but the smallest of each component.

    links(a, b): long; nulls and self-links are ignored.  Alternates large-star and
    small-star steps (each a minimum per node and a join), written to the shared folder
    each round, until the links are stars around their smallest nodes: a number of
    rounds that grows with the logarithm of the size.
    """
    e = scratch.keep(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # packed files look small enough to broadcast long before their rows are
        large = both.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = scratch.keep(small.where("u != v").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
