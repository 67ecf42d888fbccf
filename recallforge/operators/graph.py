"""Property graph: neighbours, breadth-first traversal, expansion of hits and checks of ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (seq, id, from_id, to_id, ...) as (node, other, seq, via) in both directions; a loop once."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "seq", F.col("id").alias("via"))
    back = edges.where("from_id <> to_id").select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "seq", F.col("id").alias("via"))
    return out.unionByName(back)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Edges that touch the node, in insertion order, with the other end."""
    touching = edges.where((F.col("from_id") == node) | (F.col("to_id") == node))
    return touching.withColumn("neighbour", F.when(F.col("from_id") == node, F.col("to_id")).otherwise(F.col("from_id")))


def traverse(edges: DataFrame, seeds: list, hops: int = 2, max_nodes: int | None = 50, relation: str | None = None) -> DataFrame:
    """(node, hop, via_edge, place) in breadth-first order: each node once, seeds left out.

    A node's edge is the first that reaches it: parents in their order, then edges in insertion order. Without max_nodes a level
    has no order, which would take a global sort: place is the hop, and a node's edge the first inserted. One join and one aggregate
    for each hop; a level is cut to the room left only after it is ordered. A level is checkpointed where the session has a folder for it.
    """
    spark = edges.sparkSession
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    steps = both_ways(edges)
    kind = dict(steps.dtypes)["node"]
    keep = bool(spark.sparkContext.getCheckpointDir())
    level = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], f"node {kind}, place long")
    seen, found, base = level.select("node"), None, 0
    for hop in range(1, hops + 1):
        reached = level.join(steps, "node").select(F.col("other").alias("node"), F.struct("place", "seq", "via").alias("by")).join(seen, "node", "left_anti")
        first = reached.groupBy("node").agg(F.min("by").alias("by"))
        if max_nodes is not None:
            first = first.orderBy("by", "node").limit(max(1, max_nodes) - base)
            place = F.row_number().over(Window.orderBy("by", "node")) + base  # over the rows of the limit
        else:
            place = F.lit(hop)
        ranked = first.withColumn("place", place)
        ranked = ranked.select("node", F.lit(hop).alias("hop"), F.col("by.via").alias("via_edge"), F.col("place").cast("long").alias("place"))
        ranked = ranked.checkpoint() if keep else ranked.persist()
        size = ranked.count()
        found = ranked if found is None else found.unionByName(ranked)
        base += size
        if not size or max_nodes is not None and base >= max(1, max_nodes):
            break
        seen, level = seen.union(ranked.select("node")), ranked.select("node", "place")
    return found


def expand(hits: DataFrame, edges: DataFrame, items: DataFrame, limit: int = 8) -> DataFrame:
    """Neighbours of the hits (id, rank) that exist among items (id) and are no hits: by first hit, then edge order, with score 0."""
    near = hits.join(both_ways(edges), hits["id"] == F.col("node")).select(F.col("other").alias("id"), F.struct("rank", "seq").alias("by"))
    fresh = near.join(hits.select("id"), "id", "left_anti").join(items.select("id"), "id", "left_semi")
    first = fresh.groupBy("id").agg(F.min("by").alias("by")).orderBy("by", "id").limit(limit)
    return first.select("id", F.col("by.rank").alias("from_rank"), F.col("by.seq").alias("edge_seq"), F.lit(0.0).alias("score"))


def end_counts(edges: DataFrame, items: DataFrame) -> DataFrame:
    """edges with the number of items at either end: 0 is not found, more than 1 ambiguous."""
    sizes = items.groupBy("tenant_id", "kind", "id").agg(F.count("*").alias("n"))
    for side in ("from", "to"):
        n = sizes.select("tenant_id", F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_count"))
        edges = edges.join(n, ["tenant_id", f"{side}_kind", f"{side}_id"], "left").withColumn(f"{side}_count", F.coalesce(f"{side}_count", F.lit(0)))
    return edges
