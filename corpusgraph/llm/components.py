"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import kept_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (u, v: long): component is the smallest node that can be reached.

    Each round points every larger neighbour of a node to the smallest one (large star), then every smaller
    one (small star), until edges are stars. Minima are found by aggregation, so a node with very many edges is
    no large task; nothing but the rounds' counts comes to the driver.
    """
    edges = kept_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept_table(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components were not found in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
