import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_gradients_by_differences():
    model = langid.ByteLabeller(["a", "b", "c"], embed=3, hidden=4)
    for p in model.parameters():
        p[...] = p.astype(np.float32)
    codes = np.random.default_rng(0).integers(0, 256, (5, 6))
    label = np.array([0, 1, 2, 0, 1, 2])
    _, grads = model.gradients(codes, label)
    rng = np.random.default_rng(1)
    for p, g in zip(model.parameters(), grads):
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-3)
        for i in rng.choice(flat, size=min(3, len(flat)), replace=False) if len(flat) else []:
            at, eps = np.unravel_index(i, p.shape), np.float32(1e-2)
            old = p[at]
            p[at] = old + eps
            up, _ = model.gradients(codes, label)
            p[at] = old - eps
            down, _ = model.gradients(codes, label)
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def _plain(model, text):
    """The mean distribution by the textbook formulas, one byte and one unit at a time, in float64."""
    raw = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(gru, codes):
        size, h, out = len(gru.u), [0.0] * len(gru.u), []
        for c in codes:
            x = [sum(float(e) * float(gru.w[i, j]) for i, e in enumerate(model.embedding[c])) + float(gru.b[j]) for j in range(3 * size)]
            g = [sum(h[i] * float(gru.u[i, j]) for i in range(size)) for j in range(3 * size)]
            r, z = [sig(x[j] + g[j]) for j in range(size)], [sig(x[j] + g[j]) for j in range(size, 2 * size)]
            n = [np.tanh(x[2 * size + j] + r[j] * g[2 * size + j]) for j in range(size)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
            out.append(h)
        return out

    total = np.zeros(len(model.labels))
    for a, b in zip(states(model.ahead, raw), states(model.back, raw[::-1])[::-1]):
        logits = np.array([sum(v * float(model.out[i, j]) for i, v in enumerate(a + b)) + float(model.bias[j]) for j in range(len(model.labels))])
        total += np.exp(logits) / np.exp(logits).sum()
    return total / max(len(raw), 1)


@pytest.mark.parametrize("batch,segment", [(1 << 20, 1 << 18), (40, 1 << 18), (1, 7), (64, 16)])
def test_whole_texts_by_the_plain_formulas(monkeypatch, batch, segment):
    monkeypatch.setattr(langid, "BATCH", batch)
    monkeypatch.setattr(langid, "SEGMENT", segment)
    model = langid.ByteLabeller(["x", "y", "z"], embed=3, hidden=4)
    texts = ["abc" * 15 + " de", "de abc", None, "", "\t \n", "Zürich", "d", "the end of a text\nof two lines", "de abc"]
    got = langid.document_probabilities(langid.Reader(model), pa.array(texts))
    assert np.allclose(got, [_plain(model, t or "") for t in texts], atol=1e-5)


def test_state_is_carried_over_the_whole_text():
    model = langid.ByteLabeller(["x", "y"])
    codes = np.frombuffer(b"one two " * 40, np.uint8)
    whole = model.positions(codes[:, None])[:, 0].mean(0)
    assert np.allclose(langid.document_probabilities(langid.Reader(model), pa.array(["one two " * 40]))[0], whole, atol=1e-5)


def test_edges(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "guten tag und die", "de", "s", 1) for i in range(8)] + [(i, "the and of this", "en", "s", 1) for i in range(8, 16)]
    rows += [(1, "the and of this and the", None, "s", 1)]  # shares an id, not the text
    rows += [(16, None, "en", "s", 1), (17, "", None, "s", 1), (18, "123 !!", "de", "s", 1), (None, "the this", "en", "s", 1), (1, "guten tag und die", "de", "s", 1)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), steps=120).collect()
    assert len(got) == 22
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (16, 17, 18)} == {("und", 0.0)}
    assert sorted(r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 8) == ["de"] * 9 + ["en"]
    clash = spark.createDataFrame([(1, "abc", None, 0.5, True)], "doc_id long, text string, lang string, score double, letter boolean")
    assert langid.identify(clash).first().lang_pred == "und"


def test_many_languages_and_long_texts(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i} " * 4, f"l{i}", "s", 1) for i in range(1500)]
    rows.append((9999, "ab cd " * 100_000, None, "s", 1))
    got = langid.identify(spark.createDataFrame(rows, SCHEMA).repartition(2), steps=2).collect()
    assert len(got) == 1501 and all(0 <= r.score <= 1 and r.lang_pred != "und" for r in got)
