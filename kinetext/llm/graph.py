"""Connected components of links, on Spark and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetext.llm.common import discard, materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 ... n - 1 and links a - b the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        lo = np.minimum(la, lb)
        np.minimum.at(label, la, lo)
        np.minimum.at(label, lb, lo)
        while True:  # pointer jumping
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(label[a], label[b]):
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that isn't its component's smallest node.

    Alternating large and small stars: each round links neighbours to the smallest neighbour, and about log(n) rounds leave
    stars around the smallest nodes. Minima are aggregated before the join, which may split hub nodes. Each round is
    written to the shared folder, and the one before it removed. Links of a node to itself or with a null don't count.
    """
    e = materialize(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        sign = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign == before or sign.n == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = sign
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old)
