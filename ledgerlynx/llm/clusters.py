"""Vectors as matrices, centroids from a bounded sample, and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_of


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.array(column.tolist(), dtype=np.float64)


def bounded_sample(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    """At most ``rows`` of the distinct ``vec`` values, by order of a hash."""
    order = F.xxhash64(F.lit(seed), "vec")
    return matrix(vectors.select("vec").orderBy(order).limit(rows).toPandas()["vec"])


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids of each row, nearest first."""
    gap = (centroids**2).sum(axis=1) - 2 * x @ centroids.T
    n = min(n, len(centroids))
    some = np.argpartition(gap, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(gap, some, 1), axis=1), 1)


def fit_centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means; starts are sample rows, so dense regions get more centroids."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centroids = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    for _ in range(rounds):
        own = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=k)
        some = count > 0
        centroids = np.where(some[:, None], sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the least node it reaches.

    Alternates large-star and small-star steps: every step reduces in plain groupings, the
    number of links never grows, and each round is stored, so it survives lost executors.
    """
    edges = share_of(_oriented(links.select("a", "b")), "links")
    before = None
    while True:
        # Large star: larger neighbours of a node move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Stored, so that both sides of the join are dealt for it and a hot node can be split.
        least = share_of(least.select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = share_of(_oriented(large), "large-star")
        # Small star: a node and its smaller neighbours move to the least of them.
        low = share_of(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        edges = share_of(_oriented(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller end."""
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
