"""Bounded traversal: frontier loops of joins, one level a round.

A level keeps one row for each node it reaches first - (hop, weight descending,
parent) decides - and drops what earlier levels reached, so work is bounded by
edges times depth whatever the number of paths. Lineage is cut by tables in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.scratch import materialize


def directed(edges: DataFrame, direction: str = "out", kinds: tuple[str, ...] = ()) -> DataFrame:
    """src, kind, dst, weight in walking direction ('out', 'in', 'both')."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = edges.select("src", "kind", "dst", "weight")
    back = edges.select(F.col("dst").alias("src"), "kind", F.col("src").alias("dst"), "weight")
    return {"out": out, "in": back, "both": out.unionByName(back).distinct()}[direction]


def bfs(starts: DataFrame, edges: DataFrame, depth: int, branching: int | None = None) -> DataFrame:
    """start, node, hop, parent, weight (of the edge that reached it), path.

    ``starts``: start. ``edges``: as from ``directed``. ``branching`` keeps that
    many edges of a node in a level (by neighbour).
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast(starts.schema["start"].dataType).alias("parent"), F.lit(1.0).alias("weight"), F.array("start").alias("path"))
    seen = frontier = materialize(seen, "bfs")
    for hop in range(1, depth + 1):
        step = frontier.select("start", F.col("node").alias("src"), "path").join(edges, "src")
        if branching is not None:
            step = step.select("*", F.row_number().over(Window.partitionBy("start", "src").orderBy("dst", "kind")).alias("_n")).where(F.col("_n") <= branching).drop("_n")
        best = F.min_by(F.struct("src", "weight", "path"), F.struct((-F.col("weight")).alias("w"), "src")).alias("b")
        reached = step.groupBy("start", "dst").agg(best).select("start", F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.col("b.src").alias("parent"), F.col("b.weight").alias("weight"), F.concat("b.path", F.array("dst")).alias("path"))
        frontier = materialize(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "bfs")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def star(starts: DataFrame, edges: DataFrame, depth: int, branching: int | None = 200, skip: tuple[str, ...] = ("FollowedBy",)) -> DataFrame:
    """start, node, hop, score = 1/(hop+1) x weight of the edge that reached it.

    ``branching`` keeps that many edges of a node in a level (by neighbour); None keeps all.
    """
    walk = edges.where(~F.col("kind").isin(*skip)) if skip else edges
    return bfs(starts, directed(walk, "both"), depth, branching).select("start", "node", "hop", S.rounded(S.proximity(F.col("hop")) * F.col("weight")).alias("score"))


def shortest_path(start: Column, goal: Column, spark_edges: DataFrame, depth: int) -> DataFrame:
    """node, from_target, score along one shortest path; both ends alone if there is none."""
    spark = spark_edges.sparkSession
    ends = spark.range(1).select(start.alias("start"), goal.alias("goal"))
    seen = bfs(ends.select("start"), directed(spark_edges, "both"), depth)
    found = ends.join(seen.select("start", F.col("node").alias("goal"), "path"), ["start", "goal"], "left")
    path = F.coalesce("path", F.array("start", "goal"))
    known = F.col("path").isNotNull()
    laid = found.select(known.alias("known"), F.size(path).alias("n"), F.posexplode(path).alias("i", "node"))
    inner = F.col("known") & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    hops = F.when(inner, F.col("n") - 1 - F.col("i")).otherwise(0).cast("bigint")
    return laid.select("node", hops.alias("from_target"), S.rounded(S.proximity(hops)).alias("score"))


def meet_in_the_middle(starts: DataFrame, goals: DataFrame, edges: DataFrame, depth: int, kinds: tuple[str, ...] = ("Caused", "FollowedBy")) -> DataFrame:
    """Paths from a start to a goal through the first level on which both walks meet.

    start, goal, path, weights, length. Simple paths only; the forward walk takes
    the larger half of the depth.
    """
    walk = directed(edges, "out", kinds)
    fwd = bfs(starts.select("start"), walk, (depth + 1) // 2)
    bwd = bfs(goals.select(F.col("goal").alias("start")), directed(edges, "in", kinds), depth // 2)
    met = fwd.select("start", "node", F.col("hop").alias("h1"), F.col("path").alias("p1")).join(bwd.select(F.col("start").alias("goal"), "node", F.col("hop").alias("h2"), F.col("path").alias("p2")), "node")
    met = met.withColumn("length", (F.col("h1") + F.col("h2")).cast("bigint")).withColumn("path", F.concat("p1", F.slice(F.reverse("p2"), F.lit(2), F.size("p2"))))
    met = met.where(F.size(F.array_distinct("path")) == F.size("path"))
    least = F.min("length").over(Window.partitionBy("start", "goal"))
    return met.select("start", "goal", "path", "length", least.alias("_least")).where(F.col("length") == F.col("_least")).drop("_least").dropDuplicates(["start", "goal", "path"])


def path_score(length: Column, weights: Column, saliences: Column) -> Column:
    return S.geometric_mean(F.transform(weights, F.abs)) * S.geometric_mean(saliences) / (1 + length)


def reason(base: DataFrame, edges: DataFrame, depth: int, kinds: tuple[str, ...], similarity: DataFrame | None = None) -> DataFrame:
    """node, score: base_sim x product of |weights| x 1/(1+hop) x (1+cos)/2, the best path's.

    ``base``: node, sim. ``similarity``: node, cos to the base centroid (1 if absent).
    """
    walk = edges.where(F.col("kind").isin(*kinds)).select(F.col("src"), "dst", F.abs("weight").alias("w"))
    now = materialize(base.select("node", F.col("sim").cast("double").alias("carried")), "reason")
    seen, found = now.select("node"), None
    for hop in range(1, depth + 1):
        step = now.join(walk, now["node"] == walk["src"]).groupBy("dst").agg(F.max(F.col("carried") * F.col("w")).alias("carried")).withColumnRenamed("dst", "node")
        now = materialize(step.join(seen, "node", "left_anti"), "reason")
        seen = seen.unionByName(now.select("node"))
        level = now.select("node", "carried", F.lit(hop).alias("hop"))
        found = level if found is None else found.unionByName(level)
    cos = F.lit(1.0)
    if similarity is not None:
        found, cos = found.join(similarity, "node", "left"), F.coalesce("cos", F.lit(1.0))
    return found.select("node", F.col("hop").cast("bigint").alias("hop"), S.rounded(F.col("carried") * S.proximity(F.col("hop")) * (1 + cos) / 2).alias("score"))


def verdict(supports: Column, contradicts: Column) -> Column:
    """(S - C) / (S + C), 0 if both are empty."""
    total = supports + contradicts
    return F.when(total == 0, 0.0).otherwise((supports - contradicts) / total)


def grounded_walk(anchor: Column, edges: DataFrame, kinds: DataFrame, hops: int = 3, beam: int = 4, fade: float = 0.9) -> DataFrame:
    """node, hop, score: a walk that keeps the ``beam`` best edges of each hop by the
    cue's cosine to the edge kind; what is further scores less.

    ``kinds``: kind, cos.
    """
    spark = edges.sparkSession
    now = spark.range(1).select(anchor.alias("node"))
    scored = edges.join(kinds, "kind").select(F.col("src").alias("node"), "dst", "cos")
    seen, found = materialize(now, "walk"), None
    now = seen
    for hop in range(1, hops + 1):
        step = now.select("node").join(scored, "node").groupBy("dst").agg(F.max("cos").alias("cos")).withColumnRenamed("dst", "node").join(seen, "node", "left_anti")
        now = materialize(step.orderBy(F.desc("cos"), F.asc("node")).limit(beam), "walk")
        seen = seen.unionByName(now.select("node"))
        level = now.select("node", F.lit(hop).cast("bigint").alias("hop"), S.rounded(F.col("cos") * fade**hop).alias("score"))
        found = level if found is None else found.unionByName(level)
    return found
