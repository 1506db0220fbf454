"""Ranked lists, their fusion and what follows it.

A ranked list is (lane, item_id, rank, score); everything here is a union, a
window or an aggregate over such rows, so a batch of cues (``by``) costs no
more plans than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: one partial top-k in each task, merged once."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, score: str, tie: str, by: tuple[str, ...] = (), k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Dense 1-based ranks by score (ties by id), above ``threshold``, at most k for each ``by``."""
    if threshold is not None:
        df = df.where(F.col(score) >= threshold)
    if not by and k is not None:
        df = top_k(df, k, F.desc(score), F.asc(tie))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))).alias("rank")
    out = df.select("*", rank.cast("bigint").alias("rank"))
    return out.where(F.col("rank") <= k) if by and k is not None else out


def adaptive_k(pool: Column) -> Column:
    return F.when(pool < 200, 15).when(pool < 2000, 30).otherwise(60)


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by.., item_id, fused, lanes: sum of w/(k + rank). Without ``k`` it follows
    the pool, the summed length of all lanes."""
    w = F.lit(1.0)
    for lane, weight in (weights or {}).items():
        w = F.when(F.col("lane") == lane, weight).otherwise(w)
    if k is None:  # lanes are bounded lists, so counting them in a window costs nothing and runs no lane twice
        lists, k_col = lists.withColumn("_k", adaptive_k(F.count("*").over(Window.partitionBy(*by)))), F.col("_k")
    else:
        k_col = F.lit(k)
    return lists.groupBy(*by, "item_id").agg(F.sum(w / (k_col + F.col("rank"))).alias("fused"), F.array_sort(F.collect_set("lane")).alias("lanes"))


def relative_scores(lists: DataFrame, how: str) -> DataFrame:
    """Adds ``part``: min-max (a flat lane counts 1) or z-score (a flat lane counts 0) within the lane."""
    lane = Window.partitionBy("lane")
    if how == "minmax":
        low, high = F.min("score").over(lane), F.max("score").over(lane)
        part = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    else:
        mean, spread = F.avg("score").over(lane), F.stddev_pop("score").over(lane)
        part = F.when(spread < 1e-12, 0.0).otherwise((F.col("score") - mean) / spread)
    return lists.select("*", part.alias("part"))


def fuse_relative(lists: DataFrame, weights: dict[str, float], how: str) -> DataFrame:
    w = F.lit(1.0)
    for lane, weight in weights.items():
        w = F.when(F.col("lane") == lane, weight).otherwise(w)
    return relative_scores(lists, how).groupBy("item_id").agg(F.sum(w * F.col("part")).alias("fused"))


def recency(fused: Column, age_seconds: Column, weight: float = 1.0, k: int = 60) -> Column:
    return fused + F.lit(weight / (k + 1)) * F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / S.RECENCY_HALF_LIFE)


def rerank_blend(df: DataFrame, fused: str, logit: str, tie: str, window: int = 50, weight: float = 0.5) -> DataFrame:
    """Within the first ``window`` items: normalised fused + weight * normalised logit; 0 below."""
    inside = top_k(df, window, F.desc(fused), F.asc(tie))
    whole = Window.partitionBy()
    unit = lambda c: F.when(F.max(c).over(whole) == F.min(c).over(whole), 1.0).otherwise((F.col(c) - F.min(c).over(whole)) / (F.max(c).over(whole) - F.min(c).over(whole)))
    blended = inside.select(F.col(tie), (unit(fused) + weight * unit(logit)).alias("blend"))
    return df.join(blended, tie, "left").withColumn("blend", F.coalesce("blend", F.lit(0.0)))


def membership_band(df: DataFrame, cosine: str, n_lanes: str, semantic_only: str, floor: float = 0.20, share: float = 0.85) -> DataFrame:
    """Keeps what is near enough to the cue and to the best, or is confirmed by other lanes."""
    best = F.max(cosine).over(Window.partitionBy())
    near = (F.col(cosine) >= floor) & (F.col(cosine) >= share * best)
    return df.select("*", near.alias("_near")).where(F.col("_near") | (F.col(n_lanes) >= 2) | ~F.col(semantic_only)).drop("_near")


def consensus(df: DataFrame, n_lanes: str, cosine: str, tie: str) -> DataFrame:
    """The one item with most lanes (two at least), if it also leads by cosine; else all."""
    whole = Window.partitionBy()
    most = F.max(n_lanes).over(whole)
    marked = df.select("*", most.alias("_most"), F.row_number().over(Window.orderBy(F.desc(cosine), F.asc(tie))).alias("_place"))
    marked = marked.withColumn("_with", F.count_if(F.col(n_lanes) == F.col("_most")).over(whole))
    alone = (F.col("_most") >= 2) & (F.col("_with") == 1) & (F.max(F.when((F.col("_place") == 1) & (F.col(n_lanes) == F.col("_most")), 1).otherwise(0)).over(whole) == 1)
    return marked.withColumn("_one", alone).where(~F.col("_one") | (F.col("_place") == 1)).drop("_most", "_place", "_with", "_one")


def autocut(df: DataFrame, score: str, tie: str, ratio: float = 0.55) -> DataFrame:
    """Cuts before the first item whose score falls to ``ratio`` of its predecessor's."""
    order = Window.orderBy(F.desc(score), F.asc(tie))
    before = F.lag(score).over(order)
    fell = F.when(before.isNotNull() & (F.col(score) <= ratio * before), 1).otherwise(0)
    marked = df.select("*", fell.alias("_fell"))
    return marked.withColumn("_cut", F.sum("_fell").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_fell", "_cut")


def mmr(df: DataFrame, by: str, item: str, score: str, text: str, window: int = 50, trade: float = 0.5) -> DataFrame:
    """Greedy diversity order within each ``by``: trade*relevance - (1-trade)*greatest
    token overlap with what is chosen, the last of equals first. Sequential by
    nature, over the first ``window`` rows; the rest follow in their order."""
    import pandas as pd

    placed = df.select("*", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))).alias("_place"))
    head, rest = placed.where(F.col("_place") <= window).select(by, item, score, text), placed.where(F.col("_place") > window)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        low, high = pdf[score].min(), pdf[score].max()
        relevance = [(s - low) / (high - low) if high > low else 1.0 for s in pdf[score]]
        sets = [{w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(w.encode()) > 2} for t in pdf[text]]
        left, chosen, overlap = list(range(len(pdf))), [], [0.0] * len(pdf)
        while left:
            best = max(left, key=lambda i: (trade * relevance[i] - (1 - trade) * overlap[i], i))
            chosen.append(best)
            left.remove(best)
            for i in left:  # only the newest choice can raise an overlap
                both = len(sets[i] & sets[best])
                union = len(sets[i]) + len(sets[best]) - both
                overlap[i] = max(overlap[i], both / union if union else 0.0)
        out = pdf.iloc[chosen][[by, item]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    done = head.groupBy(by).applyInPandas(order, f"`{by}` {kinds[by]}, `{item}` {kinds[item]}, place long")
    return done.unionByName(rest.select(by, item, F.col("_place").cast("long").alias("place")))
