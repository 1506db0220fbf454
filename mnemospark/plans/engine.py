"""Routing, planning and running a recall: Python decides which lanes a plan
has; the lanes, their fusion and everything after are one DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.operators import derive, lexical, ranking, vectors
from mnemospark.scratch import materialize

#: Lane weights and pool of each query class.
PROFILES = {
    "EntityAnchored": ({"semantic": 1.0, "lexical": 0.7, "graph": 2.0}, 50),
    "ExactTerm": ({"semantic": 1.0, "lexical": 2.0, "graph": 0.7}, 100),
    "Paraphrase": ({"semantic": 1.5, "lexical": 1.0, "graph": 0.5}, 200),
    "ListAggregation": ({"semantic": 1.5, "lexical": 1.0, "graph": 0.5}, 400),
    "Default": ({"semantic": 1.0, "lexical": 1.0, "graph": 1.0}, 100),
}
LEAST_POOL, MOST_POOL, MOST_POOL_LIST = 100, 200, 400
DEFAULT_LIMIT = 20


@dataclass(frozen=True)
class Request:
    cue: list[float] | None = None
    text: str | None = None
    terms: list[str] | None = None
    contexts: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    min_salience: float = 0.0
    anchor: object = None
    now: str | None = None
    limit: int = DEFAULT_LIMIT
    pool: int | None = None
    weights: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    query_class: str
    lanes: tuple[str, ...]
    weights: dict[str, float]
    pool: int
    limit: int
    recency: bool

    def render(self) -> str:
        lanes = ", ".join(f"{lane} x{self.weights[lane]:g}" for lane in self.lanes)
        return f"class {self.query_class}\nlanes {lanes}; top {self.pool}\nfuse rrf, adaptive k\nfilter, {'recency, ' if self.recency else ''}limit {self.limit}"


def classify(text: str, anchored: bool) -> str:
    """An anchor or a proper name, an exact id or capitals only, a list intent, prose, nothing."""
    text = text.strip()
    if anchored or re.search(S.TITLE_CASE, text):
        return "EntityAnchored"
    if re.search(S.EXACT_ID, text) or re.search(S.ALL_CAPS, text):
        return "ExactTerm"
    if not text:
        return "Default"
    return "ListAggregation" if re.search(S.LIST_INTENT, text.lower()) else "Paraphrase"


def routed(text: str, anchored: bool) -> dict[str, float]:
    """Lane to weight: the union of the rules that match, or both text lanes."""
    found: dict[str, float] = {}
    if anchored:
        found = {"graph": 2.0, "semantic": 1.0} | ({"lexical": 0.5} if text else {})
    if re.search(S.EXACT_ID, text) or re.search(S.ALL_CAPS, text.strip()):
        found = {"graph": found["graph"]} if "graph" in found else {}
        found |= {"lexical": 2.0, "semantic": 1.0 if anchored else 0.5}
    return found or ({"semantic": 1.0, "lexical": 1.0} if text else {})


def plan(request: Request) -> Plan:
    """At most three lanes; a lane's weight is the greatest of request (1 if not given), router and class."""
    text = request.text if request.text is not None else " ".join(request.terms or [])
    kind = classify(text, request.anchor is not None)
    router = routed(text, request.anchor is not None) or {"semantic": 1.0}
    given = {"semantic": request.cue is not None, "lexical": bool(text), "graph": request.anchor is not None}
    lanes = [lane for lane in ("semantic", "lexical", "graph") if lane in router and given[lane]]
    if not lanes:
        raise ValueError("a request needs a cue, text or an anchor")
    profile, pool = PROFILES[kind]
    weights = {lane: max(request.weights.get(lane, 1.0), router[lane], profile[lane]) for lane in lanes}
    limit = request.limit or DEFAULT_LIMIT
    ceiling = MOST_POOL_LIST if re.search(S.LIST_INTENT, text.lower()) else MOST_POOL
    pool = request.pool or min(max(3 * limit, pool, LEAST_POOL), ceiling)
    return Plan(kind, tuple(lanes), weights, pool, limit, request.now is not None)


class Engine:
    """memories: memory_id, agent, context, kind, created_at, salience, text.
    vectors: memory_id, v. edges (for anchored requests): src, kind, dst, weight."""

    def __init__(self, memories: DataFrame, vectors_: DataFrame, edges: DataFrame | None = None):
        self.memories, self.vectors, self.edges = memories, vectors_, edges

    def scope(self, request: Request) -> DataFrame | None:
        """The memories that the caller may see (memory_id): contexts and agents; None for all."""
        wanted = [(c, v) for c, v in (("context", request.contexts), ("agent", request.agents)) if v]
        if not wanted:
            return None
        seen = self.memories
        for column, values in wanted:
            seen = seen.where(F.col(column).isin(*values))
        return seen.select("memory_id")

    def lane(self, name: str, request: Request, pool: int) -> DataFrame:
        """The best ``pool`` items of a lane within the caller's scope: the scope
        stands below the top-k, so a rare context still fills its page. Text
        statistics are those of all memories."""
        seen = self.scope(request)
        within = lambda df, id_="memory_id": df if seen is None else df.join(seen, df[id_] == seen["memory_id"], "left_semi")
        if name == "semantic":
            out = vectors.knn(within(self.vectors), request.cue, pool)
        elif name == "lexical":
            scored = lexical.bm25(self.memories, request.terms or lexical.content_terms(request.text or ""))
            out = ranking.ranked(within(scored), "score", "memory_id", k=pool)
        else:
            from mnemospark.operators import graph

            kind = self.edges.schema["src"].dataType.simpleString()
            start = self.edges.sparkSession.createDataFrame([(request.anchor,)], f"start {kind}")
            walked = graph.star(start, self.edges, 1).select(F.col("node").alias("memory_id"), "score")
            out = ranking.ranked(within(walked), "score", "memory_id", k=pool)
        return out.select(F.lit(name).alias("lane"), F.col("memory_id").alias("item_id"), "rank", "score")

    def recall(self, request: Request) -> DataFrame:
        """item_id, score, lanes, rank."""
        todo = plan(request)
        lists = None
        for name in todo.lanes:
            one = self.lane(name, request, todo.pool)
            lists = one if lists is None else lists.unionByName(one)
        fused = ranking.rrf(lists, todo.weights)
        row = self.memories.select(F.col("memory_id").alias("item_id"), "agent", "context", "kind", "salience", "created_at")
        kept = fused.join(row, "item_id")
        for column, values in (("context", request.contexts), ("agent", request.agents), ("kind", request.kinds)):
            if values:
                kept = kept.where(F.col(column).isin(*values))
        if request.min_salience:
            kept = kept.where(F.col("salience") >= request.min_salience)
        score = F.col("fused")
        if todo.recency:
            score = ranking.recency(score, derive.seconds_between(F.lit(request.now).cast("timestamp_ntz"), F.col("created_at")))
        scored = kept.select("item_id", S.rounded(score).alias("score"), F.array_join("lanes", ",").alias("lanes"))
        top = ranking.top_k(scored, todo.limit, F.desc("score"), F.asc("item_id"))
        return top.select("*", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("item_id"))).cast("bigint").alias("rank"))

    def recall_deep(self, request: Request, ceiling: int = 400) -> DataFrame:
        """One retry with a pool at the ceiling if fewer than the limit came back."""
        todo = plan(request)
        first = materialize(self.recall(request), "page")
        if first.count() >= todo.limit or todo.pool >= ceiling:
            return first
        return self.recall(replace(request, pool=ceiling))

    def trace(self, request: Request) -> dict:
        """The rendered plan, the length of each lane, and the rows returned."""
        todo = plan(request)
        lanes = {name: self.lane(name, request, todo.pool).count() for name in todo.lanes}
        return {"plan": todo.render(), "lanes": lanes, "returned": self.recall(request).count()}

    def explain(self, request: Request) -> str:
        return plan(request).render()

    def grounded(self, facts: DataFrame, predicates: DataFrame, subject, cue: list[float], least: float = 0.5) -> DataFrame:
        """The values of the predicate nearest to the cue, newest first: value, times, newest.

        facts: subject, predicate, object, extracted_at, confidence. predicates: predicate, v.
        """
        near = ranking.top_k(predicates.select("predicate", S.cosine(F.col("v"), vectors.literal(cue)).alias("cos")).where(F.col("cos") >= least), 1, F.desc("cos"), F.asc("predicate"))
        mine = facts.where(F.col("subject") == subject).join(near.select("predicate"), "predicate", "left_semi")
        return mine.groupBy("object").agg(F.count("*").alias("times"), F.max("extracted_at").alias("newest"), F.max("confidence").alias("confidence")).orderBy(F.desc("newest"), F.desc("confidence"), "object")
