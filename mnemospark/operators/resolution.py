"""Entity resolution: exact names, aliases, trigrams, token supersets, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S


def with_names(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", "entity_type", "name", S.normalize_name(F.col("name")).alias("norm"))


def trigram_candidates(surfaces: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """surface, entity_id, score: trigram Jaccard of at least ``least``.

    Prefix filtering: of a surface's n trigrams (rarest first) one among the
    first n - ceil(least*n) + 1 must be in any partner, so only those are joined
    and a trigram that all names share brings nothing together by itself.
    """
    e = with_names(entities).select("entity_id", S.trigrams(F.col("norm")).alias("grams"))
    s = surfaces.select("surface", S.trigrams(S.normalize_name(F.col("surface"))).alias("grams"))
    rare = e.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    weighed = s.select("surface", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(rare, "g", "left")
    place = F.row_number().over(Window.partitionBy("surface").orderBy(F.coalesce("df", F.lit(0)), "g"))
    probe = weighed.select("surface", "n", "g", place.alias("i")).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    pairs = probe.join(e.select("entity_id", F.explode("grams").alias("g")), "g").select("surface", "entity_id").distinct()
    scored = pairs.join(e, "entity_id").withColumnRenamed("grams", "eg").join(s, "surface")
    return scored.select("surface", "entity_id", S.rounded(S.jaccard(F.col("eg"), F.col("grams"))).alias("score")).where(F.col("score") >= least)


def resolve(surfaces: DataFrame, entities: DataFrame, least: float = 0.5) -> DataFrame:
    """surface, entity_id, score, rank: exact 1.0, trigram >= 0.5, unique token superset 0.9; the best tier counts."""
    e = with_names(entities)
    s = surfaces.select("surface", S.normalize_name(F.col("surface")).alias("norm"))
    exact = s.join(e.select("norm", "entity_id"), "norm").select("surface", "entity_id", F.lit(1.0).alias("score"))
    fuzzy = trigram_candidates(surfaces, entities, least)
    words = s.select("surface", F.array_distinct(F.split("norm", " ")).alias("w"))
    # a superset holds every word of the surface, so the rarest one finds them all
    named = e.select("entity_id", F.array_distinct(F.split("norm", " ")).alias("ew"))
    tokens = named.select("entity_id", "ew", F.explode("ew").alias("t"))
    rare = tokens.groupBy("t").agg(F.count("*").alias("df"))
    probe = words.select("surface", "w", F.explode("w").alias("t")).join(rare, "t", "left").groupBy("surface", "w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "t")).alias("least")).select("surface", "w", F.col("least.t").alias("t"))
    supersets = probe.join(tokens, "t").where((F.size("ew") > F.size("w")) & (F.size(F.array_except("w", "ew")) == 0))
    alone = supersets.select("surface", "entity_id", F.count("*").over(Window.partitionBy("surface")).alias("c")).where("c = 1").select("surface", "entity_id", F.lit(0.9).alias("score"))
    best = exact.unionByName(fuzzy).unionByName(alone).groupBy("surface", "entity_id").agg(F.max("score").alias("score"))
    return best.select("*", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("score"), "entity_id")).cast("bigint").alias("rank"))


def outcome(resolved: DataFrame, surfaces: DataFrame, accept: float = 0.85, apart: float = 0.05) -> DataFrame:
    """surface, outcome (Resolved, Ambiguous, Create), entity_id."""
    top = resolved.where("rank <= 2").groupBy("surface").agg(F.max_by("entity_id", F.struct(-F.col("rank"))).alias("first"), F.max("score").alias("s1"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    both = surfaces.select("surface").distinct().join(top, "surface", "left")
    verdict = F.when(F.col("s1").isNull() | (F.col("s1") < accept), "Create").when(F.col("s2").isNotNull() & (F.col("s1") - F.col("s2") < apart - 1e-9), "Ambiguous").otherwise("Resolved")
    out = both.select("surface", verdict.alias("outcome"), "first")
    return out.select("surface", "outcome", F.when(F.col("outcome") == "Resolved", F.col("first")).alias("entity_id"))


def review(proposals: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Merge proposals by recomputed similarity: apply, reject or keep pending."""
    c = F.col(similarity)
    return proposals.withColumn("action", F.when(c >= 0.95, "apply").when(c < 0.70, "reject").otherwise("pending"))


def merge_targets(merges: DataFrame) -> DataFrame:
    """entity_id, survivor: merged_into followed to its end, doubling the step each round."""
    from mnemospark.scratch import materialize

    now = materialize(merges.select("entity_id", F.col("merged_into").alias("survivor")), "merge")
    for _ in range(64):  # chains double their step: 2**64 links, or a cycle
        onward = now.select(F.col("entity_id").alias("survivor"), F.col("survivor").alias("next"))
        step = materialize(now.join(onward, "survivor", "left").select("entity_id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")), "merge")
        now = step.select("entity_id", "survivor")
        if not step.where("moved").take(1):
            return now
    raise ValueError("merges form a cycle")
