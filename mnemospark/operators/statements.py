"""Statements, their evidence and their life: supersession, contradiction,
confidence, cascades. Keys are windows; no row is visited in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S


#: Kinds of which a key has one current statement.
SINGLE_KINDS = ("Attribute", "Directive")


def supersede(statements: DataFrame, key: tuple[str, ...] = ("subject", "predicate", "kind"), stateful: tuple[str, ...] = ()) -> DataFrame:
    """Single-valued statements: each retires its predecessor of the same key.

    Adds version, chain_root, superseded_by, valid_from, valid_to (the successor's
    extraction, unless a column ``pinned_to`` holds an end) and
    record_invalidated_at. Kinds with several values stay chains of one, but for
    predicates declared ``stateful``; events are never superseded.
    """
    single = F.col("kind").isin(*SINGLE_KINDS) | ((F.col("kind") != "Event") & F.col("predicate").isin(*stateful))
    alone = F.when(~single, F.col("statement_id"))
    chain = Window.partitionBy(*key, alone).orderBy("extracted_at", "statement_id")
    after = F.lead("extracted_at").over(chain)
    return statements.select(
        "*",
        F.row_number().over(chain).cast("bigint").alias("version"),
        F.first("statement_id").over(chain).alias("chain_root"),
        F.lead("statement_id").over(chain).alias("superseded_by"),
        F.col("extracted_at").alias("valid_from"),
        (F.coalesce("pinned_to", after) if "pinned_to" in statements.columns else after).alias("valid_to"),
        after.alias("record_invalidated_at"),
    )


def history(superseded: DataFrame, member: Column) -> DataFrame:
    """All versions of the chains that hold a row for which ``member`` is true."""
    roots = superseded.where(member).select("chain_root").distinct()
    return superseded.join(roots, "chain_root", "left_semi")


def chain_heads(superseded: DataFrame) -> DataFrame:
    """Each chain's latest row, by a keyed maximum."""
    return superseded.groupBy("chain_root").agg(F.max_by("statement_id", F.struct("version")).alias("head"), F.max("version").alias("versions"))


def decide(same_key: Column, stateful: Column, similarity: Column, judge: Column | None = None) -> Column:
    """Tiers: exact key; cosine >= 0.92; 0.82 to 0.92 by a judge; else coexist."""
    middle = judge if judge is not None else F.lit("Coexist")
    return F.when(same_key & stateful, "Supersede").when(same_key, "Contradicts").when(similarity >= 0.92, "Supersede").when(similarity >= 0.82, middle).otherwise("Coexist")


def contradictions(facts: DataFrame) -> DataFrame:
    """subject, predicate, n_objects, statements: current facts that disagree."""
    return facts.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("n_objects"), F.count("*").alias("n_statements"), F.min("statement_id").alias("first_id"), F.max("statement_id").alias("last_id")).where("n_objects > 1")


def cardinality_conflicts(relations: DataFrame, side: str, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Rows of one side that hold more than one current relation of a kind."""
    return relations.groupBy(side, *by).agg(F.count("*").alias("n"), F.min("dst" if side == "src" else "src").alias("keeps")).where("n > 1")


def confidence(evidence: DataFrame, kind: Column, now: Column, by: str = "statement_id") -> DataFrame:
    """by, confidence, n_evidence: noisy-OR of decayed evidence."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)
    x = F.col("confidence") * S.evidence_decay(kind, age)
    return evidence.groupBy(by).agg(S.rounded(S.noisy_or(x)).alias("confidence"), F.count("*").alias("n_evidence"))


def sweep(stored: Column, fresh: Column, drift: float = 0.001, most: float = 0.02) -> Column:
    """The stored value moved towards the fresh one, by ``most`` at once; small drift stays."""
    return F.when(F.abs(fresh - stored) < drift, stored).otherwise(F.greatest(stored - most, F.least(stored + most, fresh)))


def forget_cascade(evidence: DataFrame, forgotten: DataFrame, threshold: float = 0.2, by: str = "statement_id") -> DataFrame:
    """by, confidence, left, tombstoned for statements that cite a forgotten memory.

    ``forgotten``: memory_id. A statement without evidence falls to 0 and is
    tombstoned where 0 is below the threshold.
    """
    marked = evidence.join(forgotten.select("memory_id", F.lit(True).alias("gone")), "memory_id", "left")
    left = F.col("gone").isNull()
    out = marked.groupBy(by).agg(S.rounded(S.noisy_or(F.when(left, F.col("confidence")))).alias("confidence"), F.count_if(left).alias("left"), F.count_if(~left).alias("lost")).where("lost > 0")
    return out.withColumn("tombstoned", (F.col("left") == 0) & (F.lit(threshold) > 0))


def evidence_of(evidence: DataFrame, memory_id: Column, by: str = "statement_id") -> DataFrame:
    """Statements that cite a memory."""
    return evidence.where(F.col("memory_id") == memory_id).select(by).distinct()


def recall_projection(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Statement hits (statement_id, rank) as memories: first evidence, best rank for each memory."""
    first = evidence.groupBy("statement_id").agg(F.min_by("memory_id", F.struct("nth", "memory_id")).alias("memory_id"))
    return hits.join(first, "statement_id").groupBy("memory_id").agg(F.min("rank").alias("rank"))


def procedural(preferences: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The k leading preferences of each agent, as one text section."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    head = preferences.select("*", place.alias("_n")).where(F.col("_n") <= k)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda s: s["line"])
    return head.groupBy(by).agg(F.array_join(lines, "\n").alias("section"), F.count("*").alias("n"))


def statement_list(statements: DataFrame, where: Column, limit: int = 1000, after_limit: Column | None = None) -> DataFrame:
    """Filtered rows by id up to ``limit``; ``after_limit`` filters the page itself, which may under-fill it."""
    page = statements.where(where).orderBy("statement_id").limit(limit)
    return page if after_limit is None else page.where(after_limit)


def enrich(hits: DataFrame, key: str, sides: dict[str, tuple[DataFrame, str, int, Column]]) -> DataFrame:
    """Adds for each side its k leading values of a key: name -> (rows with key, value column, k, order)."""
    for name, (rows, value, k, order) in sides.items():
        place = F.row_number().over(Window.partitionBy(key).orderBy(order, F.asc(value)))
        head = rows.join(hits.select(key).distinct(), key, "left_semi").select(key, value, place.alias("_n")).where(F.col("_n") <= k)
        folded = head.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))
        hits = hits.join(folded, key, "left")
    return hits


def shape_errors(statements: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule a statement breaks (null for a good one)."""
    c = F.col
    rule = (
        F.when(~c("confidence").between(0, 1), "confidence")
        .when((c("kind") == "Event") & c("event_at").isNull(), "event_without_time")
        .when((c("kind") != "Event") & c("event_at").isNotNull(), "time_without_event")
        .when(c("valid_from") > c("valid_to"), "window")
    )
    return statements.withColumn("error", rule)


def merge_bridge(direct: DataFrame, bridge: DataFrame, threshold: float, k: int, id_: str = "statement_id") -> DataFrame:
    """Direct hits and hits of templated questions: the better score of each statement."""
    from mnemospark.operators.ranking import ranked

    both = direct.select(id_, "score").unionByName(bridge.select(id_, "score").where(F.col("score") >= threshold))
    return ranked(both.groupBy(id_).agg(F.max("score").alias("score")), "score", id_, k=k)


def questions(statements: DataFrame) -> DataFrame:
    """statement_id, question: templated questions a statement answers."""
    what = F.replace("predicate", F.lit("_"), F.lit(" "))
    forms = F.array(F.concat(F.lit("What is the "), what, F.lit(" of "), "subject", F.lit("?")), F.concat("subject", F.lit(" "), what, F.lit("?")), F.concat(F.lit("Who has "), what, F.lit(" "), "object", F.lit("?")))
    return statements.select("statement_id", F.explode(forms).alias("question"))


def forget_relations(relation_evidence: DataFrame, forgotten: DataFrame) -> DataFrame:
    """relation_id of relations whose only evidence is forgotten (relation_id, memory_id)."""
    marked = relation_evidence.join(forgotten.select("memory_id", F.lit(True).alias("gone")), "memory_id", "left")
    return marked.groupBy("relation_id").agg(F.count_if(F.col("gone").isNull()).alias("left"), F.count_if("gone").alias("lost")).where("left = 0").select("relation_id", "lost")


def expired(rows: DataFrame, at: str, now: Column, grace_seconds: int, where: Column | None = None) -> DataFrame:
    """Rows that a retention sweep deletes: past the grace period (and marked)."""
    from mnemospark.operators.derive import seconds_between

    old = seconds_between(now, F.col(at)) >= grace_seconds
    return rows.where(old if where is None else old & where)


def within_budget(costs: DataFrame, by: str, order: tuple[str, ...], cost: str, budget: float) -> DataFrame:
    """Calls in order while their running cost stays within the budget of each ``by``."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return costs.select("*", spent.alias("spent")).where(F.col("spent") <= budget)
