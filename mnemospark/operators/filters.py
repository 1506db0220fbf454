"""The retrieval filter chain and its single steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S

STEPS = ("type", "temporal", "confidence", "tombstone", "supersession", "as_of")


@dataclass(frozen=True)
class FilterChain:
    """What each step asks for; None: the step passes everything.

    Rows need tag ('memory', 'statement', 'relation', 'entity'), kind, predicate,
    created_at, event_at, valid_from, valid_to, salience, confidence, active,
    superseded_by, extracted_at, invalidated_at.
    """

    kinds: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    after: Column | None = None
    before: Column | None = None
    min_confidence: float | None = None
    include_tombstoned: bool = False
    include_superseded: bool = False
    as_of: Column | None = None
    limit: int = 0
    conditions: dict[str, Column] = field(default_factory=dict)

    def steps(self) -> dict[str, Column]:
        """Step name to predicate, in the order of the chain."""
        true, tag = F.lit(True), F.col("tag")
        out = dict.fromkeys(STEPS, true)
        if self.kinds or self.predicates:
            kind = F.col("kind").isin(*self.kinds) if self.kinds else true
            predicate = F.col("predicate").isin(*self.predicates) if self.predicates else true
            out["type"] = F.when(tag == "memory", kind).when(tag == "statement", kind & predicate).otherwise(True)
        if self.after is not None and self.before is not None:
            seen = F.coalesce("event_at", "extracted_at").between(self.after, self.before)
            overlap = S.open_overlap(F.col("valid_from"), F.col("valid_to"), self.after, self.before)
            out["temporal"] = F.when(tag == "memory", F.col("created_at").between(self.after, self.before)).when(tag == "statement", F.when(F.col("kind") == "Event", seen).otherwise(overlap)).when(tag == "relation", overlap).otherwise(True)
        if self.min_confidence is not None:  # memories have salience in the place of confidence
            out["confidence"] = F.when(tag == "memory", F.col("salience")).when(tag == "entity", F.lit(1.0)).otherwise(F.col("confidence")) >= self.min_confidence
        if not self.include_tombstoned:
            out["tombstone"] = F.col("active")
        if not self.include_superseded:
            out["supersession"] = F.when(tag.isin("statement", "relation"), F.col("superseded_by").isNull()).otherwise(True)
        if self.as_of is not None:
            out["as_of"] = F.when(tag == "statement", S.as_of(F.col("extracted_at"), F.col("invalidated_at"), self.as_of)).otherwise(True)
        return out

    def apply(self, items: DataFrame) -> DataFrame:
        for step in self.steps().values():
            items = items.where(step)
        return items.limit(self.limit) if self.limit else items

    def survivors(self, items: DataFrame) -> DataFrame:
        """step, n: how many items are left after each step, in one pass."""
        so_far, counts = F.lit(True), []
        for name, step in self.steps().items():
            so_far = so_far & F.coalesce(step, F.lit(False))
            counts.append(F.count_if(so_far).alias(name))
        wide = items.agg(F.count("*").alias("input"), *counts)
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in wide.columns])).alias("s")).select("s.step", "s.n")
