"""Benchmark decontamination by spaced seeds, with built-in functions only.

A seed hashes the tokens under the ones of a fixed mask and ignores those
under the zeros, so a substituted token under a zero does not hide a hit.
Seeds of benchmark items and of documents are joined by hash; around each hit
the two texts are laid on one diagonal and a document counts as contaminated
if some window of ``window`` tokens (the whole item, if shorter) agrees in at
least ``agree`` of its tokens.

The masks lose nothing: ``lossless_masks`` chooses them so that whichever
tokens of a window are substituted, up to the number that ``agree`` allows, one
mask lies somewhere in the window with no substitution under its ones. Items
are sorted into tiers by that number; each tier has masks for its shortest
window, and items that allow none (fewer than five tokens) are sought whole.

The benchmark side is broadcast while it has at most ``broadcast_seeds``
seeds (checked by a count); beyond that, seeds meet by a shuffle and the hits
are joined with both texts afterwards. A token that no item has cannot be part
of a hit, so while the items have at most ``vocabulary_most`` distinct tokens,
seeds that hold another one are not hashed; with more, all are.

Defined cases: tokens are words after lower-casing; null texts and texts
without words have no tokens and no hits, items alike; rows are known by id and
text, so rows that share an id are searched each and a null id is searched like
any other; repeated rows give one result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import nativetext as nt

#: Ones of a mask, at most: a few tokens make a seed rare enough, more would need more masks.
WEIGHT = 6


def _places(mask: str, length: int) -> list[int]:
    bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
    return [bits << p for p in range(length - len(mask) + 1)]


@cache
def lossless_masks(length: int, substitutions: int, weight: int, start: tuple[str, ...] = ()) -> tuple[str, ...] | None:
    """Masks, chosen greedily and added to ``start``, of which one escapes every choice of ``substitutions`` places."""
    left = np.array([sum(1 << i for i in some) for some in combinations(range(length), substitutions)], dtype=np.int64)
    hidden = lambda mask: np.logical_and.reduce([(left & p) != 0 for p in _places(mask, length)]) if len(mask) <= length else np.ones(len(left), bool)
    chosen = list(start)
    for mask in chosen:
        left = left[hidden(mask)]
    shapes = []
    for span in range(weight, min(length, 2 * weight + 2) + 1):
        shapes += ["1" + "".join("1" if i in some else "0" for i in range(span - 2)) + "1" for some in combinations(range(span - 2), weight - 2)]
    while len(left):
        best = min(shapes, key=lambda m: (int(hidden(m).sum()), m))
        rest = left[hidden(best)]
        if len(rest) == len(left):
            return None
        chosen.append(best)
        left = rest
    return tuple(chosen)


def _allowed(tokens: int, window: int, agree: float) -> int:
    """Substitutions that an item of so many tokens may have in a window."""
    win = min(tokens, window)
    return win - ceil(win * agree)


@cache
def tiers(window: int = 20, agree: float = 0.8) -> tuple[tuple[int, int | None, tuple[str, ...]], ...]:
    """(least tokens, most tokens, masks): every length of an item falls in one tier."""
    found: list[tuple[int, int | None, tuple[str, ...]]] = []
    for n in range(1, window + 1):
        s = _allowed(n, window, agree)
        if s and n > 1 and s == _allowed(n - 1, window, agree):
            found[-1] = (found[-1][0], n, found[-1][2])
            continue
        masks: tuple[str, ...] | None = ("1" * n,) if not s else None
        if masks is None and comb(n, s) <= 20_000:
            for weight in range(min(WEIGHT, n - s), 1, -1):  # the heaviest that takes four masks at most
                before = found[-1][2] if found and found[-1][2] and found[-1][2][0].count("1") == weight else ()
                masks = lossless_masks(n, s, weight, before)
                if masks and len(masks) <= 4:
                    break
                masks = None
        found.append((n, n, masks or ("1" * (n // (s + 1)),)))  # a run always fits between s substitutions
    return (*found[:-1], (found[-1][0], None, found[-1][2]))


def _tokens(df: DataFrame, key: str, row: str, known: list[int] | None = None) -> DataFrame:
    """``row`` (the row's key), key, t: 64-bit hashes of the lower-cased words; 0 for a word that is not ``known``."""
    words = df.select(nt.row_key(key).alias(row), key, nt.words(nt.spaced(F.lower("text"))).alias("w"))
    hashed = words.select(row, key, F.transform("w", lambda w: F.xxhash64(w)).alias("t"))
    if known is None:
        return hashed
    return hashed.select(row, key, F.transform("t", lambda h: F.when(h.isin(known), h).otherwise(F.lit(0).cast("bigint"))).alias("t"))


def _seeds(t: Column, number: int, mask: str) -> Column:
    """(p, h) of every seed without an unknown token under a one."""
    ones = [i for i, c in enumerate(mask) if c == "1"]

    def complete(i: Column) -> Column:
        good = nt.at(t, i + ones[0]) != 0
        for j in ones[1:]:
            good = good & (nt.at(t, i + j) != 0)
        return good

    places = F.filter(F.sequence(F.lit(0), F.size(t) - len(mask)), complete)
    hashed = F.transform(places, lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(number), *[nt.at(t, i + j) for j in ones]).alias("h")))
    return F.when(F.size(t) >= len(mask), hashed).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))


def _hits(df: DataFrame, masks: dict[str, Column], place: str) -> DataFrame:
    """One row for each seed: the columns of ``df``, ``place`` (the token at which it starts), h. A mask is tried where its condition holds."""
    none = F.array().cast("array<struct<p:int,h:bigint>>")
    found = F.explode(F.concat(*[F.when(cond, _seeds(F.col("t"), k, m)).otherwise(none) for k, (m, cond) in enumerate(masks.items())])).alias("s")
    return df.select("*", found).select(*df.columns, F.col("s.p").alias(place), "s.h")


def _laid(hits: DataFrame) -> DataFrame:
    """One row for each diagonal (row, item_row, shift): the stretches of both
    texts that lie on it. All hits of a diagonal give the same stretches, so they
    fold before the shuffle."""
    low = F.greatest(F.col("shift"), F.lit(0))
    n = F.least(F.size("t") - low, F.size("item_t") - low + F.col("shift"))
    ours, theirs = F.slice("t", low + 1, n), F.slice("item_t", low - F.col("shift") + 1, n)
    cut = hits.select("row", "item_row", "shift", "doc_id", "item_id", F.size("item_t").alias("m"), ours.alias("ours"), theirs.alias("theirs"))
    return cut.groupBy("row", "item_row", "shift").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "item_id", "m", "ours", "theirs")])


def _verified(laid: DataFrame, window: int, agree: float) -> DataFrame:
    """Diagonals on which some window agrees well enough, with the best window's count."""
    keys = ("row", "doc_id", "item_id", "shift")
    laid = laid.select(*keys, F.least(F.lit(window), F.col("m")).alias("win"), F.zip_with("ours", "theirs", lambda a, b: (a == b).cast("int")).alias("eq"))
    sums = F.transform(F.sequence(F.lit(1), F.size("eq") - F.col("win") + 1), lambda i: F.aggregate(F.slice("eq", i, F.col("win")), F.lit(0), lambda a, x: a + x))
    best = F.when(F.size("eq") >= F.col("win"), F.array_max(sums)).otherwise(0)
    laid = laid.select(*keys, "win", best.alias("n_equal"))
    return laid.where(F.col("n_equal") >= F.ceil(F.col("win") * F.lit(agree).cast("decimal(9,6)")))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 20, agree: float = 0.8, broadcast_seeds: int = 500_000, vocabulary_most: int = 100_000) -> DataFrame:
    """(row, doc_id, item_id, shift, win, n_equal): the diagonals that agree well enough; ``row`` is the document's row key."""
    items = _tokens(benchmark.select("item_id", "text"), "item_id", "item_row").where(F.size("t") > 0)
    n, masks = F.size("t"), {}
    levels = tiers(window, agree)
    level = F.coalesce(*[F.when(n >= low, F.lit(i)) for i, (low, _, _) in reversed(list(enumerate(levels)))])
    for i in sorted(r[0] for r in items.select(level.alias("i")).distinct().collect()):  # at most a number for each tier
        for m in levels[i][2]:
            masks[m] = masks.get(m, F.lit(False)) | (level == i)
    masks = masks or {"1": F.lit(False)}
    seeds = _hits(items, masks, "item_at").withColumnRenamed("t", "item_t")
    vocabulary = items.select(F.explode("t").alias("h")).distinct().limit(vocabulary_most + 1)
    known = [r[0] for r in vocabulary.collect()]  # at most vocabulary_most + 1 numbers
    tokens = _tokens(docs.select("doc_id", "text"), "doc_id", "row", known if len(known) <= vocabulary_most else None)
    ours = _hits(tokens, dict.fromkeys(masks, F.lit(True)), "doc_at")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = ours.join(F.broadcast(seeds), "h").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    else:
        met = ours.select("row", "doc_at", "h").join(seeds.select("item_row", "item_at", "h"), "h").select("row", "item_row", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
        hits = met.join(tokens, "row").join(items.withColumnRenamed("t", "item_t"), "item_row")
    return _verified(_laid(hits), window, agree)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, doc_start, window, n_equal): one row for each document and item it holds; options as of ``overlaps``."""
    best = F.max(F.struct(F.col("n_equal"), (-F.greatest("shift", F.lit(0))).alias("before"), F.col("win")))
    return overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.before")).cast("long").alias("doc_start"), F.col("b.win").cast("long").alias("window"), F.col("b.n_equal").cast("long").alias("n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of ``benchmark``, whatever their id."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), nt.row_key().alias("row"))
    kept = whole.join(overlaps(docs, benchmark, **options).select("row").distinct(), "row", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
