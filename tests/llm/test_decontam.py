import random
from itertools import combinations

import pytest

from mnemospark.llm import decontam

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _plain(doc, item, window=20, agree=0.8):
    """Whether some window on some diagonal agrees well enough, by trying all."""
    d, t = (doc or "").lower().split(), (item or "").lower().split()
    if not t:
        return False
    w = min(window, len(t))
    for shift in range(-len(t) + 1, len(d)):
        low = max(shift, 0)
        eq = [d[i] == t[i - shift] for i in range(low, min(len(d), len(t) + shift))]
        if any(sum(eq[i : i + w]) >= -(-w * 8 // 10) for i in range(len(eq) - w + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([40, 30, 22, 15, 12, 9, 6, 5, 4, 60])] + [(10, None), (11, ""), (12, "t1 t2"), (13, "t7"), (3, "t9 t8 t7 t6 t5 t4 t3")]
    docs = []
    for d in range(120):
        body = [rnd.choice(words) for _ in range(rnd.randrange(0, 120))]
        if d % 3 == 0:
            t = items[rnd.randrange(10)][1].split()
            lo = rnd.randrange(0, max(1, len(t) - 30)) if d % 2 else 0
            t = t[lo : lo + 30] if d % 2 else t
            for i in rnd.sample(range(len(t)), len(t) // 5):
                t[i] = "SUBST"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in t]
        docs.append((d, "\n".join([" ".join(body[:10]), "\t".join(body[10:])])))
    return docs + [(200, None), (201, ""), (0, docs[0][1])], items


@pytest.mark.parametrize("broadcast_seeds,vocabulary_most", [(500_000, 100_000), (0, 0), (0, 100_000)])
def test_against_all_diagonals(spark, planted, broadcast_seeds, vocabulary_most):
    docs, items = planted
    df = spark.createDataFrame([(d, t, "", "", 0) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, broadcast_seeds=broadcast_seeds, vocabulary_most=vocabulary_most).collect()}
    assert got == {(d, i) for d, t in docs for i, s in items if _plain(t, s)} and len(got) > 50


@pytest.mark.parametrize("n", range(1, 26))
def test_every_substitution_that_is_allowed_leaves_a_seed(n):
    win = min(n, 20)
    most = win - -(-win * 8 // 10)
    masks = next(m for low, high, m in decontam.tiers() if low <= n and (high is None or n <= high))
    seeds = {tuple(p + i for i, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)}
    for start in {0, (n - win) // 2, n - win}:
        inside = [set(s) for s in seeds if min(s) >= start and max(s) < start + win]
        assert all(any(s.isdisjoint(gone) for s in inside) for gone in combinations(range(start, start + win), most))


def test_other_windows_and_shares_lose_nothing():
    for window, agree in ((10, 0.7), (30, 0.9), (50, 0.6)):
        n = 0
        for low, high, masks in decontam.tiers(window, agree):
            assert low == n + 1 and masks
            n = high or n
        assert n < window or high is None


def test_every_substitution_is_found(spark):
    texts, items = [], []
    for n in (5, 7, 9, 10, 11, 14):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for gone in combinations(range(n), n // 5):
            texts.append((len(texts), " ".join(["x"] * 3 + [f"S{i}" if i in gone else w for i, w in enumerate(words)] + ["y"])))
    got = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == len(texts)


def test_rows_that_share_an_id_are_searched_each(spark):
    item = " ".join(f"w{i}" for i in range(24))
    half = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for rows in ([(1, half), (1, item)], [(1, item), (1, half)], [(None, half), (None, item), (None, item)]):
        df = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, row string, h double")
        assert [(r.doc_id, r.n_equal) for r in decontam.contaminated(df, bench).collect()] == [(rows[0][0], 20)]
        assert [(r.text, r.row, r.h) for r in decontam.clean(df, bench).collect()] == [(half, "x", 0.5)]


def test_whole_passages_are_always_found(spark, planted):
    _, items = planted
    whole = [(i, "before words " + t + " after words") for i, t in items if t]
    df = spark.createDataFrame([(i, t, i, 0.5) for i, t in whole], "doc_id long, text string, t long, h double")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i, _ in whole} <= got


def test_very_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(24))
    long_ = "some words over and over " * 40_000 + item.upper().replace("W7", "x") + " and more" * 1000
    df = spark.createDataFrame([(1, long_), (2, long_[:-20_000])], "doc_id long, text string")
    got = decontam.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.doc_start, r.n_equal) for r in got] == [(1, 200_000, 19)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0
