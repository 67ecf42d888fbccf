"""Context assembly: re-ranking, blends and the token budget. Candidates are the bounded result of one retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions.text import approx_tokens

DAY_MS = 86_400_000.0


def check_weight(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0 or math.isnan(value):
        raise ValueError(f"{name} must lie between 0 and 1")


def contradiction_rank(hits: DataFrame, key: str = "id") -> DataFrame:
    """hits (rank, score, kind, confidence, contradictions) with new_rank.

    If any hit has contradictions, memories are ordered by 0.7 score + 0.3 confidence (0.5 where unknown) and all else by score; ties and
    the rest keep their order. Scores stay as they are.
    """
    some = F.max((F.size("contradictions") > 0).cast("int")).over(Window.partitionBy()) == 1
    effective = F.when(F.col("kind") == "memory", 0.7 * F.col("score") + 0.3 * F.coalesce("confidence", F.lit(0.5))).otherwise(F.col("score"))
    ordered = hits.withColumn("effective", F.when(some, effective))
    return ordered.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("effective"), "rank", key))).drop("effective")


def normalised(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores divided by their greatest, where that is above 0."""
    high = F.max(score).over(Window.partitionBy())
    return hits.withColumn(score, F.when(high > 0, F.col(score) / high).otherwise(F.col(score)))


def decay(score: Column, weight: float, now_ms: int, updated: Column, tau_days: float) -> Column:
    """score (1 - w) + w e^(-age / tau); age in days, at least 0; 0.5 for an unknown age."""
    check_weight("decay weight", weight)
    age = F.greatest(F.lit(0.0), (F.lit(float(now_ms)) - updated) / DAY_MS)
    return score * (1 - weight) + weight * F.when(updated.isNull(), 0.5).otherwise(F.exp(-age / tau_days))


def connectivity(hits: DataFrame, edges: DataFrame, weight: float, key: str = "id") -> DataFrame:
    """score (1 - w) + w min(1, linked / (n - 1)): linked counts the other hits that an edge joins to the hit; n is the number of hits."""
    check_weight("connectivity weight", weight)
    from recallforge.operators.graph import both_ways

    among = hits.select(F.col(key).alias("other"))
    near = both_ways(edges).join(hits.select(F.col(key).alias("node")), "node", "left_semi").join(among, "other", "left_semi").where("node <> other")
    linked = near.groupBy(F.col("node").alias(key)).agg(F.countDistinct("other").alias("linked"))
    n = F.count("*").over(Window.partitionBy())
    share = F.when(n > 1, F.least(F.lit(1.0), F.coalesce("linked", F.lit(0)) / (n - 1))).otherwise(0.0)
    return hits.join(linked, key, "left").withColumn("score", F.when(n > 1, F.col("score") * (1 - weight) + weight * share).otherwise(F.col("score"))).drop("linked")


def block(kind: Column, key: Column, text: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(":"), key.cast("string"), F.lit("]\n"), text)


def pack(hits: DataFrame, budget: int, group: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The hits (rank, kind, id, text) that fit into the token budget, in rank order, for each group.

    A hit that does not fit is left out and later, smaller ones are still tried, so a running sum would be wrong: an ordered fold
    over the sizes decides, and only ranks and sizes are gathered, never texts.
    """
    group = group or []
    sized = hits.withColumn("tokens", approx_tokens(block(F.col("kind"), F.col("id"), F.col("text"))))
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("rank"), F.col("tokens"))))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def fold(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x["rank"])).alias("kept"))).otherwise(acc)

    kept = sized.groupBy(*group).agg(items.alias("items")).select(*group, F.aggregate("items", empty, fold)["kept"].alias("kept"))
    kept = kept.select(*group, F.explode("kept").alias(rank))
    return sized.withColumn(rank, F.col(rank).cast("long")).join(kept, [*group, rank], "left_semi")
