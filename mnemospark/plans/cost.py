"""Estimates for EXPLAIN: milliseconds of an interactive store, kept only to
compare plans with each other; Spark's own planning does not use them."""

from __future__ import annotations

import math

EMBED_MS, BUDGET_MS = 7.5, 1000.0


def pick_ef(k: int, selectivity: float, most: int = 500) -> int:
    return min(most, max(64, math.ceil(k / max(selectivity, 1e-3))))


def over_fetch(selectivity: float) -> float:
    return min(8.0, max(1.0, 1.0 / max(selectivity, 1e-3)))


def search_ms(ef: int, rows: int) -> float:
    return 0.05 + ef * math.log2(max(rows, 2)) * 0.001


def recall_ms(k: int, selectivity: float, rows: int, embedded: bool) -> float:
    return (0.0 if embedded else EMBED_MS) + search_ms(pick_ef(k, selectivity), rows) * over_fetch(selectivity)


def within_budget(ms: float, budget: float = BUDGET_MS) -> bool:
    return ms <= budget
