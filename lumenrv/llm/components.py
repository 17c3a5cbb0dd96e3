"""Connected components of a link table, by alternating star steps of joins and groupings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node in links(a, b).

    Each round hangs the larger neighbours of a node under its smallest neighbour, then its smaller ones; a forest of
    stars is left when nothing changes, after about log(nodes) rounds for the links met in practice. Nothing but two
    numbers a round reaches the driver; every round is written to the shared folder. Nulls and self links go.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )  # a > b
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a node goes to the smallest of the node and its neighbours
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        # small star: the smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = materialize(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def forest(m: int, left, right) -> list[tuple[int, int]]:
    """A spanning forest of the links left[i]-right[i] among m nodes: each node with its smallest, no pair twice."""
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left, right):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(m) if root(i) != i]


def smallest_reached(m: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Each linked node with the smallest that it reaches: labels sink along the links until they settle."""
    label = np.arange(m)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    return [(k, int(x)) for k, x in enumerate(label.tolist()) if x != k]
