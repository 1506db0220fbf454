"""Changes of stored records as plans: tombstones, reversals of merges, aliases,
relation versions, moved contexts, index drift, lagging subscribers.

Each takes the stored rows and the requests and returns the new state; a sink
writes it. Requests meet rows by key, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.scratch import materialize

#: Days in which a merge may be undone.
UNMERGE_DAYS = 7


def tombstone(rows: DataFrame, requests: DataFrame, key: str, now: Column) -> DataFrame:
    """``rows`` with tombstoned_at, reason and reclaim (a retraction is left to the sweep).

    requests: key, reason. The first reason in order counts; a row that is gone already keeps its own.
    """
    asked = requests.groupBy(key).agg(F.min("reason").alias("_reason"))
    met = rows.join(asked, key, "left")
    fresh = F.col("tombstoned_at").isNull() & F.col("_reason").isNotNull()
    kept = [F.col(c) for c in rows.columns if c not in ("tombstoned_at", "reason", "reclaim")]
    return met.select(*kept, F.when(fresh, now).otherwise(F.col("tombstoned_at")).alias("tombstoned_at"), F.when(fresh, F.col("_reason")).otherwise(F.col("reason")).alias("reason"), (fresh & (F.col("_reason") == "Retracted")).alias("reclaim"))


def unmerge(entities: DataFrame, merges: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """entity_id, merged_into, outcome (reversed, expired, not_merged, kept): a merge is undone within its grace.

    entities: entity_id, merged_into. merges: entity_id, merged_at. requests: entity_id.
    """
    asked = requests.select("entity_id").distinct().withColumn("_asked", F.lit(True))
    met = entities.join(merges.groupBy("entity_id").agg(F.max("merged_at").alias("merged_at")), "entity_id", "left").join(asked, "entity_id", "left")
    in_time = F.col("merged_at") + F.expr(f"INTERVAL {UNMERGE_DAYS} DAYS") >= now
    outcome = F.when(F.col("_asked").isNull(), "kept").when(F.col("merged_into").isNull(), "not_merged").when(F.coalesce(in_time, F.lit(False)), "reversed").otherwise("expired")
    done = met.withColumn("outcome", outcome)
    return done.select("entity_id", F.when(F.col("outcome") != "reversed", F.col("merged_into")).alias("merged_into"), "outcome")


def aliases(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """entity_id, alias: the set after additions and removals; the latest change of an alias counts.

    changes: entity_id, alias, at, added (boolean).
    """
    latest = changes.groupBy("entity_id", "alias").agg(F.max_by("added", "at").alias("added"))
    return stored.distinct().join(latest, ["entity_id", "alias"], "full").where(F.coalesce("added", F.lit(True))).select("entity_id", "alias")


def relation_versions(relations: DataFrame, one: tuple[str, ...], at: str, key: str) -> DataFrame:
    """``relations`` with valid_to and superseded_by: where ``one`` admits one partner, a later one closes its predecessor."""
    order = Window.partitionBy(*one).orderBy(at, key)
    return relations.select("*", F.lead(at).over(order).alias("valid_to"), F.lead(key).over(order).alias("superseded_by"))


def move_context(memories: DataFrame, moves: DataFrame) -> DataFrame:
    """``memories`` with context replaced where a move (agent, from_context, to_context) names it."""
    moved = memories.join(moves, (memories["agent"].eqNullSafe(moves["agent"])) & (memories["context"] == moves["from_context"]), "left").select(*[memories[c] for c in memories.columns if c != "context"], F.coalesce(moves["to_context"], memories["context"]).alias("context"))
    return moved.select(*memories.columns)


def index_drift(records: DataFrame, index: DataFrame, key: str, version: str) -> DataFrame:
    """key, action: what a rebuild of an index has to add, replace or drop."""
    a, b = records.select(F.col(key), F.col(version).alias("_now")), index.select(F.col(key), F.col(version).alias("_was"))
    met = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    action = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "drop").when(~F.col("_now").eqNullSafe(F.col("_was")), "replace")
    return met.select(key, action.alias("action")).where("action IS NOT NULL")


def _later(feed: DataFrame, points: DataFrame) -> DataFrame:
    """topic, lsn, _later: for each distinct place of ``points``, the records of its topic that come after it.

    No pair of a point and a record is formed. Places are dealt out by range; each
    counts within its range and adds what later ranges of its topic hold.
    """
    asked = points.select("topic", "lsn", F.lit(0).alias("n"), F.lit(True).alias("asked"))
    marks = feed.select("topic", "lsn", F.lit(1).alias("n"), F.lit(False).alias("asked")).unionByName(asked).dropna(subset=["topic", "lsn"])
    places = marks.groupBy("topic", "lsn").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    dealt = materialize(places.repartitionByRange("topic", "lsn").withColumn("part", F.spark_partition_id()), "places")
    within = Window.partitionBy("topic", "part").orderBy(F.desc("lsn")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("topic").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("topic", "part").agg(F.sum("n").alias("n")).select("topic", "part", F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("beyond"))
    inner = dealt.select("topic", "lsn", "part", "asked", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")).where("asked")
    return inner.join(parts, ["topic", "part"]).select("topic", "lsn", (F.col("inner") + F.col("beyond")).alias("_later"))


def lagging(consumers: DataFrame, feed: DataFrame, capacity: int) -> DataFrame:
    """consumer, final_lsn, behind, state: one that lags by more than ``capacity`` records is cut off where it stands.

    consumers: consumer, topic, lsn. feed: topic, lsn.
    """
    left = feed.groupBy("topic").agg(F.max("lsn").alias("_head"))
    passed = consumers.join(_later(feed, consumers), ["topic", "lsn"])
    behind = passed.groupBy("consumer").agg(F.sum("_later").alias("behind"))
    met = consumers.join(left, "topic", "left").join(behind, "consumer", "left").withColumn("behind", F.coalesce("behind", F.lit(0)))
    over = F.col("behind") > capacity
    return met.select("consumer", F.when(over, F.col("lsn")).otherwise(F.coalesce("_head", "lsn")).alias("final_lsn"), "behind", F.when(over, "overloaded").otherwise("live").alias("state"))


def model_fingerprint(config: Column, tokenizer: Column, weights: Column, dim: Column, normalised: Column) -> Column:
    """32 hex digits that change with anything a vector depends on."""
    parts = [F.sha2(c.cast("binary"), 256) for c in (config, tokenizer, weights)]
    return F.substring(F.sha2(F.concat_ws("|", *parts, dim.cast("string"), normalised.cast("string")), 256), 1, 32)


def membership_order(structured: DataFrame, semantic: DataFrame, id_: str) -> DataFrame:
    """id, origin, cosine, rank: what both sets hold, then the structured set, then the semantic one, nearest first.

    structured: id, cosine (null if it has no vector). semantic: id, cosine.
    """
    a, b = structured.select(id_, F.col("cosine").alias("_a"), F.lit(1).alias("_s")), semantic.select(id_, F.col("cosine").alias("_b"), F.lit(1).alias("_v"))
    met = a.join(b, id_, "full")
    place = F.when(F.col("_s").isNotNull() & F.col("_v").isNotNull(), 0).when(F.col("_s").isNotNull(), 1).otherwise(2)
    named = F.get(F.array(F.lit("both"), F.lit("structured"), F.lit("semantic")), place)
    cosine = F.coalesce("_b", "_a")
    order = Window.orderBy(place, F.desc_nulls_last(cosine), F.asc(id_))
    return met.select(id_, named.alias("origin"), cosine.alias("cosine"), F.row_number().over(order).cast("bigint").alias("rank"))


def cue_anchors(cues: DataFrame, entities: DataFrame) -> DataFrame:
    """cue_id, entity_id: the entity whose canonical name is a whole span of the cue, where there is exactly one.

    cues: cue_id, spans (normalised names found in the cue). entities: entity_id, norm.
    """
    met = cues.select("cue_id", F.explode(F.array_distinct("spans")).alias("norm")).join(entities.select("entity_id", "norm"), "norm").groupBy("cue_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    return met.where("n = 1").select("cue_id", "entity_id")


def pivot_statements(nodes: DataFrame, statements: DataFrame, cap: int, *order: Column) -> DataFrame:
    """statement_id, hop, score: current statements of the entities a walk reached, at their entity's hop; ``cap`` of an entity.

    nodes: node, hop, score. statements: statement_id, subject and what ``order`` needs.
    """
    place = F.row_number().over(Window.partitionBy("subject").orderBy(*order))
    few = statements.select("*", place.alias("_n")).where(F.col("_n") <= cap)
    met = nodes.join(few, nodes["node"] == few["subject"]).select("statement_id", "hop", "score")
    return met.groupBy("statement_id").agg(F.min_by("hop", F.struct("hop", -F.col("score"))).alias("hop"), F.min_by("score", F.struct("hop", -F.col("score"))).alias("score"))


def towards_goal(neighbours: DataFrame, by: str, cosine: str, budget: int, tie: str) -> DataFrame:
    """``neighbours`` with place: those nearest to the goal first, ``budget`` of each ``by``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(cosine), F.asc(tie)))
    return neighbours.select("*", place.cast("bigint").alias("place")).where(F.col("place") <= budget)
