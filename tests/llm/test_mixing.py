import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] or sizes[s] == 0]
        if not over:
            return {**full, **share}
        full |= {s: 2.0 * sizes[s] for s in over}
        if len(full) == len(names):
            return full


def _plain(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for d, t, s in rows:
        u = (int(hashlib.md5(f"mix{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = max(0.1, 1 - 4 * (len(re.findall(r"[#*$%&|<>]", t)) / len(t) if t else 0))
        by.setdefault(s, []).append((-math.log(u) / w, -1 if d is None else d, size(t)))
    sizes = {s: sum(x[2] for x in docs) for s, docs in by.items()}
    out = []
    for s, target in _targets(sizes).items():
        epochs = math.floor(target / sizes[s]) if sizes[s] else 0
        left = math.floor(target - epochs * sizes[s])
        for _, d, n in sorted(by[s]):
            part = max(0, min(n, left))
            left -= n
            out.append((d, n, sizes[s], round(target, 6), n * epochs + part))
    return sorted(out)


def _rows():
    rows = [(i, " ".join(["wort"] * (i * 7 % 23)) + (" ##$$" if i % 5 == 0 else ""), ["b", "a", None, "é", "zz", "hot"][i % 6 if i % 2 else 5]) for i in range(300)]
    return rows + [(1000, None, "only-empty"), (1001, "", "only-empty"), (None, "no id here", "a")]


@pytest.mark.parametrize("levels,broadcast_sources", [(2, 100_000), (1, 0), (0, 100_000)])
def test_against_one_sorted_list(spark, levels, broadcast_sources):
    df = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in _rows()], SCHEMA)
    got = mixing.mix(df, levels=levels, broadcast_sources=broadcast_sources).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == _plain(_rows())
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_texts_hold_the_words_taken(spark):
    rows = [(d, (t or "") and " \n" + t, s, d) for d, t, s in _rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix_texts(df)
    assert got.columns == ["doc_id", "text", "source", "size", "copy"]
    words = F.size(F.array_remove(F.split("text", "[ \n]+"), ""))
    have = {r[0]: r[1] for r in got.groupBy("doc_id").agg(F.sum(words)).collect()}
    want = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    assert have == want


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, "", "a", 1), (2, " ", "", None, 1)], SCHEMA)
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}
    twice = spark.createDataFrame([(7, "a b c d", "", "a", 1)] * 5, SCHEMA)
    got = [r.taken for r in mixing.mix(twice).collect()]
    assert len(got) == 5 and sum(got) == 30


def test_given_weights_and_rows_without_ids(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"word{i} " * 10, "en", "a" if i % 2 else "b", 1, float(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good double")
    slim = mixing._keyed(df, "mix", F.col("good"), F.col("good"))
    assert slim.select("place").distinct().count() == 400  # each text draws its own number
    took = mixing.mix(df.withColumn("text", F.concat("text", F.col("good").cast("string"))), weight=F.col("good")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 11 for r in took)
    less = mixing.mix_texts(df.where("source = 'a'"), budget=0.1, weight=F.col("good")).agg(F.avg("good")).first()[0]
    assert less > 0.9  # what is worth most goes first
