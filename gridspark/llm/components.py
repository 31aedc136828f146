"""Connected components of a list of links, in rounds of joins that survive lost executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, release, table


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components as (a, b), at most one fewer than there are ends: each end to its smallest."""
    ends, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(ends))
    return ends[keep], ends[label[keep]]


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b: bigint); a node alone has no row.

    Rounds of large-star and small-star: each round a node's larger (then smaller) neighbours are hung on its smallest
    one. Links only move downwards, their number never grows, and rounds end when they form stars. A node with very many
    links is reduced by min(), which is combined before the shuffle, and its links are joined back where they lie."""
    links = table(links.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    k, before = 0, None
    while True:
        # Large star: for each node, hang every larger neighbour on the smallest of the node and its neighbours.
        both = links.select("u", "v").unionByName(links.selectExpr("v AS u", "u AS v"))
        low = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = join_hot(both.filter("v > u"), low, "u", "c").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, f"large-{k}")
        # Small star: hang a node and its smaller neighbours on the smallest of them.
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        hung = join_hot(large, low, "u", "c")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        old, links = links, table(small, f"small-{k}")
        release(old, large)
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, k = state, k + 1
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
