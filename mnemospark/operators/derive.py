"""Derived edges, maintenance and writes: what background workers compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S

GAP_SECONDS = 1800


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000)


def predecessors(timeline: DataFrame, by: tuple[str, ...] = ("agent", "context")) -> DataFrame:
    """Adds prev_id and gap (seconds) to the previous memory of the same key."""
    order = Window.partitionBy(*by).orderBy("created_at", "memory_id")
    gap = seconds_between(F.col("created_at"), F.lag("created_at").over(order))
    return timeline.select("*", F.lag("memory_id").over(order).alias("prev_id"), gap.alias("gap"))


def followed_by(timeline: DataFrame, by: tuple[str, ...] = ("agent", "context"), gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """src, dst, weight: predecessor within the gap; nearer in time weighs more."""
    near = predecessors(timeline, by).where(F.col("gap") <= gap_seconds)
    return near.select(F.col("prev_id").alias("src"), F.col("memory_id").alias("dst"), S.rounded((1 - F.col("gap") / gap_seconds) * 0.9 + 0.1).alias("weight"))


def mirrored(edges: DataFrame, most: int = 16) -> DataFrame:
    """Symmetric edges from both ends, at most ``most`` of a source, the heaviest first."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    once = both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return once.select("*", place.alias("_n")).where(F.col("_n") <= most).drop("_n")


def topical(edges: DataFrame, vectors: DataFrame, least: float = 0.4) -> DataFrame:
    """Edges whose ends are alike enough (``vectors``: memory_id, v); a missing vector counts as unlike."""
    a = vectors.select(F.col("memory_id").alias("src"), F.col("v").alias("_a"))
    b = vectors.select(F.col("memory_id").alias("dst"), F.col("v").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where(S.rounded(S.cosine(F.col("_a"), F.col("_b"))) >= least).drop("_a", "_b")


def sessions(timeline: DataFrame, by: str = "agent", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """by, session (from 1), n, started, ended."""
    order = Window.partitionBy(by).orderBy("created_at", "memory_id")
    gap = seconds_between(F.col("created_at"), F.lag("created_at").over(order))
    opened = timeline.select("*", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0).alias("_new"))
    numbered = opened.select("*", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    return numbered.groupBy(by, "session").agg(F.count("*").alias("n"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"))


def caused(effects: DataFrame, causes: DataFrame, evidence: DataFrame, min_confidence: float = 0.6, caps: tuple[int, int, int] = (5, 3, 3)) -> DataFrame:
    """src, dst, weight: memories of the statements about an effect's object cause the effect's memories.

    effects: statement_id, object_entity, confidence. causes: statement_id, subject.
    Caps: cause statements of an effect, memories of a cause, memories of an effect.
    """
    head = lambda df, by, order, n: df.select("*", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n")).where(F.col("_n") <= n).drop("_n")
    strong = effects.where(F.col("confidence") >= min_confidence)
    # one more than an effect may have: itself can be among them
    first = head(causes.select(F.col("statement_id").alias("cause"), F.col("subject").alias("object_entity")), ("object_entity",), ("cause",), caps[0] + 1)
    pairs = strong.select(F.col("statement_id").alias("effect"), "object_entity", "confidence").join(first, "object_entity")
    pairs = head(pairs.where(F.col("effect") != F.col("cause")), ("effect",), ("cause",), caps[0])
    mem = evidence.select("statement_id", "memory_id").distinct()
    of_cause = head(mem, ("statement_id",), ("memory_id",), caps[1]).select(F.col("statement_id").alias("cause"), F.col("memory_id").alias("src"))
    of_effect = head(mem, ("statement_id",), ("memory_id",), caps[2]).select(F.col("statement_id").alias("effect"), F.col("memory_id").alias("dst"))
    return pairs.join(of_cause, "cause").join(of_effect, "effect").where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("weight"))


def consolidate(memories: DataFrame, now: Column, least: int = 5) -> DataFrame:
    """context, n, summary_id, sources: episodic memories of the last day, by context."""
    fresh = memories.where((F.col("kind") == "Episodic") & (F.col("created_at") > now - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= now))
    ids = F.sort_array(F.collect_list("memory_id"))
    out = fresh.groupBy("context").agg(F.count("*").alias("n"), ids.alias("ids")).where(F.col("n") >= least)
    return out.select("context", "n", F.md5(F.array_join("ids", ",")).alias("summary_id"), F.lit(0.7).alias("salience"))


def reconcile(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """memory_id, stored, counted where the stored out-degree is wrong."""
    counted = edges.groupBy(F.col("src").alias("memory_id")).agg(F.count("*").alias("counted"))
    both = stored.join(counted, "memory_id", "full").select("memory_id", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.where("stored <> counted")


def scrub(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is gone (``nodes``: node)."""
    src = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti")
    dst = edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return src.unionByName(dst.select(*src.columns)).distinct()


def first_by_hash(memories: DataFrame, by: tuple[str, ...] = ("agent", "context")) -> DataFrame:
    """memory_id, first_id: the earliest memory with the same text in the same scope."""
    key = [*by, F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")]
    firsts = memories.select(*key, "memory_id", "created_at").groupBy(*by, "hash").agg(F.min(F.struct("created_at", "memory_id"))["memory_id"].alias("first_id"), F.count("*").alias("copies"))
    return firsts


def idempotency(requests: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """request_id, outcome of a batch of requests (request_id, hash): 'conflict' if hashes differ, else 'cached' after the first."""
    return requests.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("hashes")).select("request_id", "n", F.when(F.col("hashes") > 1, "conflict").when(F.col("n") > 1, "cached").otherwise("fresh").alias("outcome"))


def retention(snapshots: DataFrame, by: str, at: str, id_: str, now: Column, max_age_seconds: int, max_count: int) -> DataFrame:
    """The snapshots to delete: too old, or beyond the newest ``max_count``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(id_))) - 1
    marked = snapshots.select("*", place.alias("_i"))
    return marked.where((seconds_between(now, F.col(at)) >= max_age_seconds) | (F.col("_i") >= max_count)).drop("_i")


def upsert(base: DataFrame, changes: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Latest row of each key; a change marked ``deleted`` removes it."""
    both = base.withColumn("deleted", F.lit(False)).withColumn(order, F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last()))
    return both.select("*", place.alias("_n")).where("_n = 1 AND NOT deleted").drop("_n", "deleted", order)


def overlay(committed: DataFrame, pending: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Read-your-writes view of an open transaction."""
    return committed.join(removed.select(key), key, "left_anti").unionByName(pending)
