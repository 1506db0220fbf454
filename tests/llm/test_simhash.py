import random

import numpy as np
import pytest
import xxhash

from mnemospark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _plain(text, size=4):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["Ab", "cD", "é", "x" * 9, "1"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 200)] + [None, " \t\n", "a\x0bb\x0cc\rd e"]
    assert [simhash.fingerprint(t) for t in texts] == [_plain(t) for t in texts]
    monkeypatch.setattr(simhash, "_BLOCK_BYTES", 64)  # long texts go in blocks
    assert [simhash.fingerprint(t) for t in texts] == [_plain(t) for t in texts]


def _components(fps, bound):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= bound:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("group_most,blocks", [(256, 7), (3, 7), (256, 6)])
def test_links_against_all_pairs(spark, group_most, blocks):
    rnd = random.Random(5)
    fps = set()
    for _ in range(30):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(rnd.randrange(0, 12)):  # a chain of near ones, some too far
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 7)))
            fps.add(f)
    fps |= {0, 15, 255, (1 << 64) - 1}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in simhash.link_fingerprints(df, 4, blocks, group_most).collect()}
    groups = {}
    for f, r in _components(fps, 4).items():
        groups.setdefault(r, set()).add(simhash._signed(f))
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert got == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (3, base), (5, base + " tail"), (7, "something else entirely different here"), (1, None), (2, ""), (8, "  "), (9, base), (None, base)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    near = (simhash.fingerprint(base) ^ simhash.fingerprint(base + " tail")).bit_count() <= 4
    assert by[9] == by[3] == by[None] == 3 and by[5] == (3 if near else 5) and by[7] == 7 and by[1] == by[2] == by[8] == 1
    assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 for r in got)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_pivots_never_discard_a_link(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300)
    b = a ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    both = df.select("a", "b", simhash._coordinates(F.col("a")).alias("near_a"), simhash._coordinates(F.col("b")).alias("near_b"))
    assert simhash._verified(both, 4).count() == 300 == both.where(simhash._allowed(F.col("near_a"), F.col("near_b"), 4)).count()
    first = both.first()
    packed = [first.near_a[i // 8] >> 8 * (i % 8) & 255 for i in range(simhash.PIVOTS)]
    assert packed == [((first.a ^ p) & (1 << 64) - 1).bit_count() for p in simhash.pivots()]


def test_pivots_discard_most_candidates(spark):
    """Pairs that share three of seven blocks and nothing else: the candidates of unrelated texts."""
    rng = np.random.default_rng(4)
    a = rng.integers(-(1 << 62), 1 << 62, 4000)
    b = (a & np.int64(simhash._block_masks(7, 4)[0])) | (rng.integers(-(1 << 62), 1 << 62, 4000) & ~np.int64(simhash._block_masks(7, 4)[0]))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    left = df.where(simhash._allowed(simhash._coordinates(F.col("a")), simhash._coordinates(F.col("b")), 4)).count()
    assert left < 0.05 * 4000


def test_representatives(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (3, base + " "), (3, "quite another text under the same id"), (7, "something else entirely different here"), (None, base), (None, "no id and nothing like it"), (7, "something else entirely different here")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, fp int")
    got = sorted((r.doc_id or -1, r.text) for r in simhash.representatives(df).collect())
    assert got == sorted([(3, base + " "), (3, rows[2][1]), (7, rows[3][1]), (-1, rows[5][1])])
    assert simhash.representatives(df).columns == df.columns and simhash.representatives(df.limit(0)).count() == 0


def test_keys_are_not_broadcast(spark, tmp_path):
    """35 keys come of each fingerprint; Spark's guess is the compressed file of fingerprints."""
    spark.range(20_000).selectExpr("cast(id as long) as doc_id", "xxhash64(id) as fp").write.parquet(str(tmp_path / "fp"))
    fps = spark.read.parquet(str(tmp_path / "fp")).select("fp").distinct()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        assert simhash.link_fingerprints(fps).count() == 0  # random ones lie far apart
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_representatives_are_not_broadcast(spark, tmp_path):
    spark.range(20_000).selectExpr("id as doc_id", "concat_ws(' ', sha2(string(id), 256), sha2(string(-id), 256)) as text").write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        assert simhash.representatives(spark.read.parquet(str(tmp_path / "docs"))).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
