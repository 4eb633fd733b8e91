"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import materialize


ONE_TASK = 2_000_000  # links that one task joins in memory, some 100 MB


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a[i], b[i])."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, as one star for each component they form."""
    rows = [x for x in batches if x.num_rows]
    if not rows:
        return
    ends = [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in rows]) for i in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    root = local_roots(a, b, len(nodes))
    far = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every end of edges.

    edges: its first two columns are longs; loops, repeats and either direction are accepted, rows with nulls are left
    out. Links are contracted by partition; what is left is joined in one task if it counts ONE_TASK links at most, else in
    rounds, with the same result. Each round is two aggregations and two shuffled joins on node ids, checkpointed, so nothing of the graph reaches the
    driver and a lost executor repeats one round at most. Empty edges give an empty result.
    """
    first, second = edges.columns[:2]
    ends = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).dropna()
    loops = ends.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    stars = materialize(ends.filter("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    before = None
    while True:  # ends: a round that changes anything lowers an end of some link; chains halve, so rounds grow with the logarithm
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        if 0 < state[0] <= ONE_TASK:
            stars = stars.coalesce(1).mapInArrow(_contract, "a long, b long")
            break
        before = state
        stars = materialize(_small_star(_large_star(stars)))
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component")).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
