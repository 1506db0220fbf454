"""Who may ask what: permissions, the tenant wall, agent scoping, and checks
that a request's filters fit its scope. All of it is decided before a plan exists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERBS = {
    "read": ("recall", "query", "query_text", "plan", "reason", "explain", "trace", "entity_get", "entity_list", "statement_get", "statement_list", "relation_list", "subscribe"),
    "write": ("encode", "link", "unlink", "forget", "statement_create", "relation_create", "entity_create", "txn"),
    "admin": ("schema_upload", "schema_replace", "merge_review", "stats", "backfill"),
}
MEMORY_ONLY, STATEMENT_ONLY = ("contexts", "min_salience"), ("predicates", "min_confidence")


class Denied(PermissionError):
    """The caller may not do this."""


@dataclass(frozen=True)
class Caller:
    namespace: int
    agent: str
    permissions: frozenset[str] = field(default_factory=lambda: frozenset({"read", "write"}))


def require(caller: Caller, verb: str) -> None:
    needed = next((p for p, verbs in VERBS.items() if verb in verbs), None)
    if needed is None:
        raise ValueError(f"no such verb: {verb}")
    if needed not in caller.permissions:
        raise Denied(f"{verb} needs {needed}")


def agents_in_scope(caller: Caller, agent_filter: tuple[str, ...] = (), include_others: bool = False) -> tuple[str, ...] | None:
    """An explicit filter, else every agent of the namespace (None), else the caller."""
    return agent_filter or (None if include_others else (caller.agent,))


def walled(df: DataFrame, caller: Caller, agents: tuple[str, ...] | None) -> DataFrame:
    """The namespace always holds; only the agents can be widened."""
    out = df.where(F.col("namespace") == caller.namespace) if "namespace" in df.columns else df
    return out if agents is None else out.where(F.col("agent").isin(*agents))


def check_filters(scope: str, used: set[str]) -> None:
    """Rejects filters of memories in statement scope and the other way round."""
    wrong = used & set(MEMORY_ONLY if scope == "statement" else STATEMENT_ONLY if scope == "memory" else ())
    if wrong:
        raise ValueError(f"{', '.join(sorted(wrong))}: not in {scope} scope")


def capabilities(dim: int, namespaces: list[str]) -> dict:
    return {"vector_dim": dim, "namespaces": namespaces, "retrievers": ["semantic", "lexical", "graph"], "exact_search": True, "verbs": sorted(v for verbs in VERBS.values() for v in verbs)}
