import numpy as np
import pytest

from mnemospark.llm import fm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = fm.FactorisationMachine(np.sort(rng.normal(size=(len(fm.STATS), fm.BINS - 1)), axis=1), rank=3)
    model.w, model.v, model.b = rng.normal(size=model.w.shape), rng.normal(size=model.v.shape), 0.3
    stats = rng.normal(size=(4, len(fm.STATS)))
    row, bucket, x = np.array([0, 0, 0, 1, 3, 3]), np.array([5, 9, 11, 5, 1, 2]), rng.random(6)
    got = model.logits(4, stats, row, bucket, x)
    for r in range(4):
        at = np.concatenate([model.bins(stats)[r], bucket[row == r]])
        v = np.concatenate([np.ones(len(fm.STATS)), x[row == r]])
        want = model.b + model.w[at] @ v + sum(model.v[at[i]] @ model.v[at[j]] * v[i] * v[j] for i in range(len(at)) for j in range(i))
        assert got[r] == pytest.approx(want)


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = fm.classify(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "", "", None), (2, "", "", "", 0), (3, " \n", "", "", 2), (4, "word " * 50_000, "", "", 1), (4, "a", "", "", 1), (None, "b", "", "", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = fm.classify(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(2, None, 1), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = fm.classify(docs, labels).collect()
    assert len(got) == 6 and all(np.isfinite(r.score) for r in got)
    assert fm.classify(docs.limit(0), labels).count() == 0


def test_features_are_normalised():
    import pyarrow as pa

    texts = pa.array(["a b c a", None, "", "x\nx\ny", "word"])
    for rows, stats, row, bucket, x in fm.features(texts, np.zeros(5)):
        assert stats.shape == (rows, len(fm.STATS)) and np.isfinite(stats).all()
        assert np.allclose(np.bincount(row, weights=x**2, minlength=rows), [1, 0, 0, 1, 1])
        assert stats[3, fm.STATS.index("same_lines")] == pytest.approx(2 / 3)


def _plain_features(text, n_chars):
    """Statistics and word features of one text, byte by byte."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    repeated = lambda items: sum(items.count(x) > 1 for x in items) / max(len(items), 1)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(len(raw), 1)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    stats = [
        np.log1p(len(words)), sum(map(len, words)) / max(len(words), 1), share(b"#*$%&|<>{}[]~^@\\/=+_"), share(bytes(range(65, 91))), share(b"0123456789"),
        sum(raw.count(bytes([c])) for c in b".!?,;:") / max(len(words), 1), repeated(low), np.log1p(len(raw) / max(len(lines), 1)), repeated(lines), np.log1p(n_chars),
    ]
    return stats, {w: (low.count(w) / len(low)) ** 0.5 for w in low}


def test_features_against_plain_counting():
    import pyarrow as pa

    from mnemospark.llm import bytewords as bw

    texts = ["a b c A", None, "", "x\nx\ny\n", "Word, word; 12 {ok}", "\n\n", "é été\tÉté\x0bz", "no end\nno end", "w " * 300]
    chars = np.arange(len(texts), dtype=float)
    for rows, stats, row, bucket, x in fm.features(pa.array(texts), chars):
        for i, t in enumerate(texts):
            want, words = _plain_features(t, chars[i])
            assert np.allclose(stats[i], want), (t, stats[i], want)
            cells = {}
            for w, v in words.items():
                key = bw.word_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
                cells[int(np.uint64(key.view(np.uint64)) >> np.uint64(50))] = v
            assert dict(zip(bucket[row == i].tolist(), x[row == i])) == pytest.approx(cells)
    model = fm.FactorisationMachine(np.tile(np.arange(1.0, fm.BINS), (len(fm.STATS), 1)))
    stats = np.array([[0.5, 1, 1.5, 6.9, 7, 99, -1, 3, 3.5, 2]])
    assert (model.bins(stats)[0] - fm.BUCKETS - fm.BINS * np.arange(len(fm.STATS))).tolist() == [0, 1, 1, 6, 7, 7, 0, 3, 3, 2]


def test_reruns_agree_where_many_rows_share_an_id(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} and more of {i}", "", "", i) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 0), (0, 0, 0), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    first, second = (sorted((r.doc_id, r.score) for r in fm.classify(docs.repartition(n, "text"), labels).collect()) for n in (1, 7))
    assert first == second
