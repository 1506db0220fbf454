"""PPM scores against a plain trie walked byte by byte."""

import binascii
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemospark.llm import bytewords as bw
from mnemospark.llm import ppm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _learn(doc_id):
    return binascii.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0


def _lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def _plain(docs, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for doc, text in docs:
        if _learn(doc):
            s = [256] * order + list(_lower(text)) + [256]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][tuple(s[i - k : i])][s[i]] += 1
    out = []
    for _, text in docs:
        s, total = [256] * order + list(_lower(text)) + [256], 0.0
        for i in range(order, len(s)):
            excluded, done = set(), False
            for k in range(order, -1, -1):
                seen = counts[k].get(tuple(s[i - k : i]))
                if not seen:
                    continue
                left = {c: n for c, n in seen.items() if c not in excluded}
                t, q = sum(left.values()), len(left)
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / t)
                    done = True
                    break
                if q:
                    total += math.log10(0.5 * q / t)
                excluded |= set(seen)
            if not done:
                total += math.log10(1 / (257 - len(excluded)))
        out.append(total)
    return out


def _base(docs):
    c = Counter()
    for doc, text in docs:
        if _learn(doc):
            c.update(_lower(text).split() + [None])
    n, v = sum(c.values()), len(c)
    return [(len(w := _lower(t).split() + [None]), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for _, t in docs]


DOCS = [(i, t) for i, t in enumerate(["the cat sat", "The CAT\tsat on\n the mat ", None, "", "  ", "été déjà vu", "x" * 300, "the cat sat", "zzz qqq", "a b c d e f g " * 40, "€ symbols \x0b here", "the dog"] * 3)]


@pytest.mark.parametrize("order,split", [(2, 4096), (3, 4096), (5, 4096), (6, 4096), (3, 6), (5, 12), (5, 40), (6, 3)])
def test_scores_equal_the_plain_trie(spark, monkeypatch, order, split):
    monkeypatch.setattr(ppm, "SPLIT", split)  # small: contexts are split down to different depths
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in DOCS], SCHEMA)
    got = {r.doc_id: r for r in ppm.score_documents(df, max_order=order, chunk_bytes=900).collect()}
    for (doc, _), score, base in zip(DOCS, _plain(DOCS, order), _base(DOCS)):
        r = got[doc]
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[:3] and r.base_score == pytest.approx(base[3])
        assert r.held_out == (not _learn(doc))


def test_no_group_of_a_split_context_is_large(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ppm, "SPLIT", 50)
    raw = np.frombuffer(("the cat of the house and the dog of the hall " * 30 + "".join(f"x{i}y" for i in range(300))).encode(), np.uint8)
    gram, _ = ppm.grams(raw, np.array([0, len(raw)]), 5)
    df = spark.createDataFrame([(int(k), 1) for k in gram], "key long, n long")
    pairs = np.zeros((257, 257), np.int64)
    np.add.at(pairs, ((gram >> 9) & 511, gram & 511), 1)
    split = ppm._split_contexts(df, 5, pairs)
    assert set(split) == {2, 3, 4}
    groups = df.groupBy(ppm._dealt_by(split).alias("c")).agg(F.count("*").alias("rows"), F.count_distinct(F.shiftright("key", 9)).alias("contexts")).collect()
    assert all(g.rows <= len(gram) / 50 or g.contexts == 1 for g in groups)
    dealt = df.select("key", ppm._dealt_by(split).alias("c")).collect()
    depth = ppm._depths(np.array([r.key for r in dealt]), ppm.LowOrders(pairs, split))
    assert all(r.c == (r.key >> 9) & ppm._tail(int(d)) for r, d in zip(dealt, depth))


def test_probabilities_add_up():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(20)]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [60] * 20)
    gram, _ = ppm.grams(raw, offsets, 3)
    keys, n = bw.counted(gram)
    pairs = np.zeros((257, 257), np.int64)
    np.add.at(pairs, ((keys >> 9) & 511, keys & 511), n)
    context = keys[len(keys) // 2] & ~511
    group = keys[((keys >> 9) & ppm.PAIR) == ((context >> 9) & ppm.PAIR)]
    every = np.unique(np.concatenate([group, context | np.arange(257)]))
    count = np.zeros(len(every))
    count[np.searchsorted(every, group)] = n[np.isin(keys, group)]
    p = ppm.log10_probability(every, count, 3, ppm.LowOrders(pairs))
    assert (10 ** p[np.searchsorted(every, context | np.arange(257))]).sum() == pytest.approx(1.0)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ppm.score_documents(empty).count() == 0
    odd = spark.createDataFrame([(None, None, 1, "x"), (None, "a", 1, "x"), (5, "a", 2, "y"), (5, "a", 2, "y")], "doc_id long, text string, chunk int, score string")
    rows = ppm.score_documents(odd).collect()
    assert len(rows) == 4 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    alone = spark.createDataFrame([(None, "ab", "", "", 1)], SCHEMA)  # a held-out row only: nothing to learn from
    r = ppm.score_documents(alone).first()
    assert r.held_out and r.score == pytest.approx(-3 * math.log10(257)) and r.train_tokens == 0 and r.n_known == 0


def test_held_out_texts_do_better_than_the_word_model(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    r = ppm.score_documents(df, max_order=6).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_words_and_hashes():
    raw = np.frombuffer(b"ab cd\tab\x0b\x0bx ab", np.uint8)
    start, end, row = bw.spans(raw, np.array([0, 5, 5, len(raw)]))
    assert [bytes(raw[s:e]) for s, e in zip(start, end)] == [b"ab", b"cd", b"ab", b"x", b"ab"] and row.tolist() == [0, 0, 2, 2, 2]
    h = bw.word_hash(raw, start, end)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    index = bw.Index(np.unique(h))
    assert (index.keys[index.find(h)] == h).all() and index.find(np.array([12345]))[0] == -1
