import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import vectors as V
from mnemospark.sources import records as R


def test_search_recall(spark, sf):
    v = R.vectors(spark, sf)
    found = V.search(v, v.where("memory_id % 100 = 0"), 10, cells=32, probes=24).collect()
    rows = sorted(v.collect(), key=lambda r: r.memory_id)
    x = np.array([r.v for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.memory_id)
    hits = total = 0
    for i, r in enumerate(rows):
        if r.memory_id % 100 == 0:
            s = x @ x[i]
            s[i] = -2
            best = {rows[j].memory_id for j in np.argsort(-s)[:10]}
            hits, total = hits + len(best & got[r.memory_id]), total + 10
    assert hits / total >= 0.9


def test_search_with_all_cells_is_exact_over_small_blocks(spark, sf):
    v = R.vectors(spark, sf)
    a = V.search(v, v.where("memory_id % 100 = 0"), 5, cells=8, probes=8, block_rows=20).select("query_id", "memory_id", "score").collect()
    b = V.search(v, v.where("memory_id % 100 = 0"), 5, cells=1, probes=1).select("query_id", "memory_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_similar_to_blocks_agree(spark, sf):
    v = R.vectors(spark, sf)
    a = V.similar_to(v, 0.3, 5, block_rows=60).collect()
    assert sorted(a) == sorted(V.similar_to(v, 0.3, 5).collect()) and len(a) > 0


def test_holographic_binding():
    fillers = {n: V.unitary(i) for i, n in enumerate(["Stripe", "Acme", "Initech", "Hooli", "Umbrella", "Globex", "Soylent", "Bob"])}
    roles = {n: V.unitary(100 + i) for i, n in enumerate(["subject", "predicate", "object"])}
    works_at = V.unitary(50)
    triple = V.bundle(V.bind(roles["subject"], fillers["Bob"]), V.bind(roles["predicate"], works_at), V.bind(roles["object"], fillers["Stripe"]))
    name, score = V.cleanup(V.unbind(triple, roles["object"]), fillers)
    assert name == "Stripe" and score > 0.4


def test_product_codes_rank_near_vectors_first(spark, sf):
    v = R.vectors(spark, sf)
    x = np.array([r.v for r in v.orderBy("memory_id").collect()])
    book = V.train_codes(x, 8)
    near = [r.memory_id for r in V.adc_search(V.encode_codes(v, book), book, list(x[7]), 20).collect()]
    assert 7 in near


def _nearest(rows, k=10):
    """Brute force: {query: {memory: score}} for ids divisible by 100, ties by id."""
    ids, x = np.array([r.memory_id for r in rows]), np.array([r.v for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.where(ids == ids[i], -2, np.round(x @ x[i] + 1e-9, 6))
        found[ids[i]] = {ids[j] for j in np.lexsort((ids, -score))[:k]}
    return found


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_product_code_search_recall(spark, size):
    from mnemospark.queries import queries

    path = f"/root/testdata/{size}"
    want, got = _nearest(R.vectors(spark, path).collect()), {}
    for r in queries()["pq_adc_search"](spark, path).collect():
        got.setdefault(r.query_id, set()).add(r.memory_id)
    recall = sum(len(got.get(q, set()) & best) for q, best in want.items()) / sum(map(len, want.values()))
    print(size, "recall@10", recall)
    assert recall >= 0.99 and set(got) == set(want)


def test_product_code_search_over_small_blocks(spark, sf):
    v = R.vectors(spark, sf)
    book = V.train_codes(np.array([r.v for r in v.limit(50).collect()]), 8, 4)
    got = {}
    for r in V.adc_join(v, v.where("memory_id % 100 = 0"), book, 10, block_rows=30).collect():
        got.setdefault(r.query_id, set()).add(r.memory_id)
    assert got == _nearest(v.collect())


def test_centroid_is_a_unit_vector(spark, sf):
    for r in V.centroids(R.vectors(spark, sf), "label").collect():
        assert sum(c * c for c in r.centroid) == pytest.approx(1.0)


def test_cosine_of_zero_vector(spark):
    from mnemospark.functions import scalars as S

    z = F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(S.cosine(z, z)).first()[0] == 0.0
