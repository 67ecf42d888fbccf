"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm.common import cut, drop, hot_keys, join_hot

#: Edges that a task ties together at once, before any shuffle.
AT_ONCE = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that is not the smallest one reachable, and that smallest node."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for end in (u, v):
            np.minimum.at(new, end, least)
            np.minimum.at(new, root[end], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components as the edges (a, b): each task's edges tied together, AT_ONCE at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tied():
            u, v = forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield tied()
                held, size = [], 0
        if held:
            yield tied()

    return edges.select("a", "b").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, node: str = "node", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b), long and not null: component is the smallest node reachable.

    Each step is an aggregate and a join on the node; the edges are written to the shared folder after each round,
    so that no round repeats an earlier one. A node with a large share of the edges (the hub of a component) is joined
    by a broadcast of its one row, so its edges stay spread. The number of rounds grows with the logarithm of the longest chain.
    """
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = cut(contracted(edges), "edges")
    state = sums(now)
    for _ in range(rounds):
        # Large star: every larger neighbour is tied to the smallest node around u.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, low.select("u", "m"), ["u"], hot_keys(low, "u", 2 * state[0])).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = join_hot(large, low.select("u", "m"), ["u"], hot_keys(low, "u", state[0])).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(tied.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now), drop(large)
        got, now = sums(new), new
        if got == state:
            break
        state = got
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias(node), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias(node), F.col("v").alias("component")).union(roots)
