"""Connected components on DataFrames: each task contracts the edges it reads, then large-star and small-star rounds over written tables alternate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, stored

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node reachable) of the edges, without the smallest nodes themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        if np.array_equal(low, label[u]) and np.array_equal(low, label[v]):
            break
        for x in (u, v, label[u], label[v]):
            np.minimum.at(label, x, low)
        while not np.array_equal(label[label], label):
            label = label[label]
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b), those that a task reads replaced by stars, CHUNK at a time: as many rows or fewer, and the same components."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([column(x, k).to_numpy(zero_copy_only=False) for x in held]) for k in "ab")
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.where("a <> b").select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a, b), a > b, has one smaller neighbour or none, and is no neighbour of larger ones if it has one."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("v").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return per.where("low + high > 1 and low > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the edges (a, b): component is the smallest id reachable.

    Edges may repeat, point either way or be loops; ids that stand only in loops, and nulls, are left out.
    Nothing is collected but whether the edges are stars yet. The minima of a round are written
    before they are joined, so that Spark can split the rows of a node with very many neighbours.
    """
    now = stored(_contracted(edges).distinct(), "cc")
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc")
        # large star: every larger neighbour is linked with the smallest one
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        # small star: the node and its smaller neighbours are linked with the smallest one
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least).distinct(), "cc")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (id, component) of some edges, with further edges (a, b) added: only those between components count."""
    one = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    between = edges.join(one("a"), "a", "left").join(one("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = stored(between.where("a <> b").distinct(), "between")
    if between.isEmpty():
        return labels
    moved = stored(components(between), "moved")
    own = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left")
    return stored(own.select("id", F.coalesce("c", "component").alias("component")).union(moved).distinct(), "labels")
