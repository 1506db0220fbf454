"""Connected components of an edge table by alternating star contraction.

Each round re-points edges at the smallest neighbour (first for larger
neighbours, then for smaller ones); O(log^2 n) rounds end in a forest of stars.
Every round is two keyed minima and joins; no adjacency list is ever gathered
and nothing but two numbers per round reaches the driver. Minima are broadcast only
below ``broadcast_edges`` edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.scratch import by_shuffle, materialize


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least if small else by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least if small else by_shuffle(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 64, broadcast_edges: int = 100_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, one
    orderable type); component is the smallest node reachable. Self-loops and
    nulls are ignored; an empty edge table gives an empty result."""
    u, v = edges.columns[:2]
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"`{u}` <> `{v}`").distinct()
    now = materialize(now, "edges")
    digest = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    before = tuple(now.agg(*digest).first())
    if before[0]:
        for _ in range(rounds):
            small = before[0] <= broadcast_edges
            now = materialize(_small_star(_large_star(now, small), small), "edges")
            after = tuple(now.agg(*digest).first())
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
