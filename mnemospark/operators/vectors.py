"""Vector search and vector joins.

A single cue is a literal in an expression: one scan, one partial top-k. Batches
and self-joins run cell against cell in numpy: rows are dealt to the cells of a
few fitted pivots, a cell is cut into blocks, and each task multiplies two
blocks, so no task holds more than two blocks however large a cell is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.operators.components import connected_components
from mnemospark.operators.ranking import ranked, top_k
from mnemospark.scratch import materialize

BLOCK_ROWS = 2000


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(vectors: DataFrame, cue: list[float], k: int, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """memory_id, score, rank of the k nearest by cosine; a filter goes below the top-k."""
    base = vectors if where is None else vectors.where(where)
    scored = base.select("memory_id", S.rounded(S.cosine(F.col("v"), literal(cue))).alias("score"))
    return ranked(scored, "score", "memory_id", k=k, threshold=threshold)


def best_per_owner(scored: DataFrame, owner: str, score: str, k: int) -> DataFrame:
    """Several vectors for one owner: the best counts."""
    return top_k(scored.groupBy(owner).agg(F.max(score).alias(score)), k, F.desc(score), F.asc(owner))


def _placed(both: DataFrame, score: Column, k: int, *order: Column) -> DataFrame:
    """memory_id, score, rank of the first k rows: a partial top-k, then ranks of k rows."""
    keyed = both.select("memory_id", score.alias("score"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [F.asc(f"_o{i}") for i in range(len(order))] + [F.asc("memory_id")]
    return top_k(keyed, k, *by).select("memory_id", "score", F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("rank"))


def merge_append(direct: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """direct (memory_id, rank, score) keeps its order, scores rise to the greater
    one; what only ``extra`` (memory_id, score) has follows by score."""
    both = direct.join(extra.select("memory_id", F.col("score").alias("extra")), "memory_id", "full")
    best = F.greatest("score", "extra")
    return _placed(both, best, k, F.col("rank").isNull(), F.coalesce("rank", F.lit(0)), -best)


def merge_boost(direct: DataFrame, extra: DataFrame, k: int, weight: float = 0.15) -> DataFrame:
    """direct is re-sorted by score + weight * extra; the rest follows by score."""
    both = direct.join(extra.select("memory_id", F.col("score").alias("extra")), "memory_id", "full")
    key = F.coalesce(F.col("score") + weight * F.coalesce("extra", F.lit(0.0)), F.col("extra"))
    return _placed(both, F.coalesce("score", "extra"), k, F.col("score").isNull(), -key)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """by, centroid: the normalised sum of a group's vectors, summed by position."""
    parts = vectors.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"))
    sums = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    length = S.norm(F.col("c"))
    return sums.select(by, F.transform("c", lambda x: x / length).alias("centroid"))


# --- cells --------------------------------------------------------------------
def fit_pivots(vectors: DataFrame, cells: int, sample: int = 4096, rounds: int = 8) -> np.ndarray:
    """Unit pivots from spherical k-means over at most ``sample`` rows (those with
    the smallest hash of their id)."""
    rows = vectors.where("v IS NOT NULL").orderBy(F.xxhash64("memory_id")).limit(sample).select("memory_id", "v").collect()
    x = np.array([r[1] for r in sorted(rows, key=lambda r: r[0])], dtype=float)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(1)
    pivots = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ pivots.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
        pivots = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return pivots


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def search(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 64, probes: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, memory_id, score, rank: the k nearest rows of each query row.

    Every row is indexed in its nearest pivot's cell; a query looks into its
    ``probes`` nearest cells (all of them: exact). Cells are cut into blocks by
    hash, a query meets each block of its cells, and each block returns k rows.
    """
    rows_ = vectors.where("v IS NOT NULL").count()
    pivots = fit_pivots(vectors, max(1, min(cells, -(-4 * rows_ // block_rows))))
    probes = min(probes, len(pivots))

    def home(it):
        for pdf in it:
            pdf["cell"] = (_unit(pdf["v"]) @ pivots.T).argmax(1) if len(pdf) else []
            yield pdf[["memory_id", "v", "cell"]]

    def near(it):
        for pdf in it:
            if len(pdf):
                best = np.argsort(-(_unit(pdf["v"]) @ pivots.T), axis=1, kind="stable")[:, :probes]
                pdf = pdf.loc[pdf.index.repeat(probes)].assign(cell=best.ravel())
                yield pdf.rename(columns={"memory_id": "query_id"})[["query_id", "v", "cell"]]

    kind = vectors.schema["memory_id"].dataType.simpleString()
    usable = vectors.select("memory_id", "v").where("v IS NOT NULL")
    rows = usable.mapInPandas(home, f"memory_id {kind}, v array<double>, cell long")
    sizes = {r[0]: -(-r[1] // block_rows) for r in rows.groupBy("cell").count().collect()}  # a number for each pivot
    blocks = F.coalesce(F.get(F.array(*[F.lit(sizes.get(c, 0)) for c in range(len(pivots))]), F.col("cell").cast("int")), F.lit(0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("memory_id"), F.greatest(blocks, F.lit(1))))
    asks = queries.select("memory_id", "v").where("v IS NOT NULL").mapInPandas(near, f"query_id {kind}, v array<double>, cell long")
    asks = asks.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("block", F.col("block").cast("long"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y, ids = _unit(right["v"]), right["memory_id"].to_numpy()
            for lo in range(0, len(left), 1024):
                some = left.iloc[lo : lo + 1024]
                score = np.round(_unit(some["v"]) @ y.T + 1e-9, 6)
                for q, line in zip(some["query_id"], score):
                    line = np.where(ids == q, -2.0, line)
                    best = np.lexsort((ids, -line))[:k]
                    best = best[line[best] > -2]
                    out.append(pd.DataFrame({"query_id": q, "memory_id": ids[best], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "memory_id": [], "score": []})

    found = asks.groupBy("cell", "block").cogroup(rows.groupBy("cell", "block")).applyInPandas(meet, f"query_id {kind}, memory_id {kind}, score double")
    return ranked(found, "score", "memory_id", ("query_id",), k)


def _block_pairs(vectors: DataFrame, threshold: float, block_rows: int, cells: int = 64) -> DataFrame:
    """Rows (memory_id, v, own) under the pairs (a, b) of blocks they belong to.

    Two cells meet only if the angle between their pivots, less both radii,
    allows the threshold (triangle inequality on angles), so clustered data
    meets its own neighbourhood only; whatever the data, no pair is missed.
    """
    rows_ = vectors.where("v IS NOT NULL").count()
    pivots = fit_pivots(vectors, max(1, min(cells, -(-rows_ // block_rows))))  # a cell for each block of rows: more would deal rows to more pairs than there is work
    kind = vectors.schema["memory_id"].dataType.simpleString()

    def home(it):
        for pdf in it:
            if len(pdf):
                cosines = np.clip(_unit(pdf["v"]) @ pivots.T, -1, 1)
                cell = cosines.argmax(1)
                yield pdf.assign(cell=cell, angle=np.arccos(cosines[np.arange(len(cell)), cell]))

    rows = vectors.select("memory_id", "v").where("v IS NOT NULL").mapInPandas(home, f"memory_id {kind}, v array<double>, cell int, angle double")
    rows = materialize(rows, "cells")
    known = {r[0]: (max(1, -(-r[1] // block_rows)), r[2]) for r in rows.groupBy("cell").agg(F.count("*"), F.max("angle")).collect()}  # one row for each cell
    base, at = {}, 0
    for c in sorted(known):
        base[c], at = at, at + known[c][0]
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-3
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((0, 0))
    near = [[d for d in sorted(known) if c in known and between[c, d] <= known[c][1] + known[d][1] + reach] for c in range(len(pivots))]
    number = lambda values: F.array(*[F.lit(int(x)) for x in values])
    first = number(base.get(c, 0) for c in range(len(pivots)))
    blocks = number(known.get(c, (1, 0))[0] for c in range(len(pivots)))
    partners = F.array(*[number(n).cast("array<int>") for n in near]) if near else F.array(F.array().cast("array<int>"))
    own = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("memory_id"), F.get(blocks, F.col("cell")).cast("long")).cast("int")
    dealt = rows.select("memory_id", "v", own.alias("own"), F.explode(F.get(partners, F.col("cell"))).alias("to"))
    other = F.sequence(F.get(first, F.col("to")), F.get(first, F.col("to")) + F.get(blocks, F.col("to")) - 1)
    dealt = dealt.select("memory_id", "v", "own", F.explode(other).alias("other"))
    return dealt.select("memory_id", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def similar_to(vectors: DataFrame, threshold: float = 0.85, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """src, dst, weight: each row's k nearest others with cosine >= threshold (exact).

    Blocks against blocks in matrix products; a task returns k rows for each row
    at most, never all pairs. Zero vectors link to nothing.
    """
    kind = vectors.schema["memory_id"].dataType.simpleString()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = _unit(pdf["v"]), pdf["memory_id"].to_numpy(), pdf["own"].to_numpy()
        same = pdf["a"].iat[0] == pdf["b"].iat[0]
        out = []
        for lo in range(0, len(ids), 512):
            score = np.round(x[lo : lo + 512] @ x.T + 1e-9, 6)
            for i, line in zip(range(lo, lo + len(score)), score):
                keep = np.flatnonzero((line >= threshold) & (ids != ids[i]) & ((own != own[i]) | same))
                best = keep[np.lexsort((ids[keep], -line[keep]))][:k]
                if len(best):
                    out.append(pd.DataFrame({"src": ids[i], "dst": ids[best], "weight": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "weight": []})

    near = _block_pairs(vectors, threshold, block_rows).groupBy("a", "b").applyInPandas(meet, f"src {kind}, dst {kind}, weight double")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), F.asc("dst")))
    return near.select("*", place.alias("_n")).where(F.col("_n") <= k).drop("_n")


def similarity_clusters(vectors: DataFrame, threshold: float = 0.6, least: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """memory_id, cluster (smallest member): single linkage at cosine >= threshold, small clusters dropped.

    A block pair returns a spanning forest of its links, so rows stay linear.
    """
    kind = vectors.schema["memory_id"].dataType.simpleString()

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(pdf["v"]), pdf["memory_id"].to_numpy()
        root = np.arange(len(ids))
        for lo in range(0, len(ids), 512):
            hits = np.round(x[lo : lo + 512] @ x.T + 1e-9, 6) >= threshold
            for i in range(len(hits)):
                joined = np.unique(root[hits[i] | (np.arange(len(ids)) == lo + i)])
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        return pd.DataFrame({"u": ids, "v": ids[root]})

    edges = _block_pairs(vectors, threshold, block_rows).groupBy("a", "b").applyInPandas(forest, f"u {kind}, v {kind}")
    of = connected_components(edges)
    sizes = of.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return of.join(sizes, "component").select(F.col("node").alias("memory_id"), F.col("component").alias("cluster"), "members")


# --- holographic vectors and product codes: small models, in numpy ---------------
def unitary(seed: int, dim: int = 512) -> np.ndarray:
    """A real vector whose spectrum has magnitude 1, from seeded phases."""
    phase = np.random.default_rng(seed).uniform(-np.pi, np.pi, dim // 2 - 1)
    spectrum = np.concatenate([[1.0], np.exp(1j * phase), [1.0]])
    return np.fft.irfft(spectrum, dim)


def bind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), len(a))


def unbind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), len(a))


def bundle(*parts: np.ndarray) -> np.ndarray:
    total = np.sum(parts, axis=0)
    return total / max(np.linalg.norm(total), 1e-12)


def cleanup(noisy: np.ndarray, fillers: dict[str, np.ndarray]) -> tuple[str, float]:
    score = {name: float(noisy @ v / max(np.linalg.norm(noisy) * np.linalg.norm(v), 1e-12)) for name, v in fillers.items()}
    best = max(score, key=lambda n: (score[n], n))
    return best, score[best]


def role_query(triples: DataFrame, codebook: list[str], dim: int = 512) -> DataFrame:
    """id, filler, score: the object of each triple (id, subject, object), bound and
    bundled as one vector, read back through its role and cleaned up against the
    codebook. Fillers get vectors from a hash of their name."""
    import zlib

    def run(it):
        vector = lambda name: unitary(zlib.crc32(name.encode()), dim)
        subject, object_ = unitary(1, dim), unitary(2, dim)
        fillers = {name: vector(name) for name in codebook}
        for pdf in it:
            found = [cleanup(unbind(bundle(bind(subject, vector(s)), bind(object_, vector(o))), object_), fillers) for s, o in zip(pdf["subject"], pdf["object"])]
            yield pd.DataFrame({"id": pdf["id"], "filler": [f for f, _ in found], "score": [x for _, x in found]})

    kind = triples.schema["id"].dataType.simpleString()
    return triples.select("id", "subject", "object").mapInPandas(run, f"id {kind}, filler string, score double")


def train_codes(sample: np.ndarray, parts: int, centroids_: int = 16, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Product-quantiser codebook (part, centroid, width) from a bounded sample."""
    rng = np.random.default_rng(seed)
    book = []
    for piece in np.split(sample, parts, axis=1):
        c = piece[rng.choice(len(piece), size=min(centroids_, len(piece)), replace=False)]
        for _ in range(rounds):
            near = ((piece[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1)
            c = np.stack([piece[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        book.append(c)
    return np.stack(book)


def encode_codes(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """memory_id, codes: nearest centroid of each part."""
    kind = vectors.schema["memory_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            x = np.array(pdf["v"].tolist(), dtype=float)
            codes = np.stack([((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for p, c in zip(np.split(x, len(book), axis=1), book)], axis=1) if len(x) else np.zeros((0, len(book)), int)
            yield pd.DataFrame({"memory_id": pdf["memory_id"], "codes": codes.tolist()})

    return vectors.select("memory_id", "v").mapInPandas(run, f"memory_id {kind}, codes array<int>")


def adc_search(coded: DataFrame, book: np.ndarray, cue: list[float], k: int) -> DataFrame:
    """Asymmetric distances from look-up tables, in expressions; the k nearest."""
    table = [[float(((np.array(q) - c) ** 2).sum()) for c in part] for q, part in zip(np.split(np.array(cue, dtype=float), len(book)), book)]
    tables = F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])
    distance = F.aggregate(F.zip_with("codes", tables, lambda c, t: F.get(t, c)), F.lit(0.0), lambda a, x: a + x)
    return top_k(coded.select("memory_id", distance.alias("distance")), k, F.asc("distance"), F.asc("memory_id"))


def adc_join(vectors: DataFrame, queries: DataFrame, book: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, memory_id, score, rank: the k nearest other rows of each query row
    by cosine, exact for any codebook (of unit vectors).

    A row is coded once and keeps its distance to its decoded self. In a block of
    rows the k nearest by asymmetric distance set a radius; a row whose
    asymmetric distance less that error lies beyond it cannot be among the k
    (triangle inequality), and every other row is scored on its vector.
    """
    kind = vectors.schema["memory_id"].dataType.simpleString()
    part = np.arange(len(book))

    def code(it):
        for pdf in it:
            if len(pdf):
                x = _unit(pdf["v"])
                codes = np.stack([((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for p, c in zip(np.split(x, len(book), axis=1), book)], axis=1)
                error = np.linalg.norm(x - book[part, codes].reshape(len(x), -1), axis=1)
                yield pd.DataFrame({"memory_id": pdf["memory_id"], "v": x.tolist(), "codes": codes.tolist(), "error": error})

    usable, asks = (d.select("memory_id", "v").where("v IS NOT NULL") for d in (vectors, queries))
    blocks, parts = (-(-max(d.count(), 1) // block_rows) for d in (usable, asks))
    hashed = lambda n: F.pmod(F.xxhash64("memory_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = usable.mapInPandas(code, f"memory_id {kind}, v array<double>, codes array<int>, error double").withColumn("block", hashed(blocks)).withColumn("part", every(parts))
    asks = asks.withColumn("part", hashed(parts)).withColumn("block", every(blocks)).withColumnRenamed("memory_id", "query_id")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y, ids, codes, error = _unit(right["v"]), right["memory_id"].to_numpy(), np.array(right["codes"].tolist()), right["error"].to_numpy()
            for q, x in zip(left["query_id"], _unit(left["v"])):
                table = ((np.split(x, len(book)) - book.transpose(1, 0, 2)) ** 2).sum(2).T
                near = np.where(ids == q, np.inf, np.sqrt(table[part, codes].sum(1)))
                first = np.argsort(near, kind="stable")[:k]
                least = np.round(y[first] @ x + 1e-9, 6).min() if len(first) == k and np.isfinite(near[first]).all() else -1.0
                some = np.flatnonzero(np.isfinite(near) & (near - error <= np.sqrt(max(0.0, 2 - 2 * (least - 2e-6))) + 1e-6))
                score = np.round(y[some] @ x + 1e-9, 6)
                best = np.lexsort((ids[some], -score))[:k]
                out.append(pd.DataFrame({"query_id": q, "memory_id": ids[some[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "memory_id": [], "score": []})

    found = asks.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(meet, f"query_id {kind}, memory_id {kind}, score double")
    return ranked(found, "score", "memory_id", ("query_id",), k)
