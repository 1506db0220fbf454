import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import duck_rows, spark_rows

import corpus_pipeline as cp
from mnemospark.llm import queries as q


def test_stages_keep_columns_and_work(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(columns)] == columns
        counts.append(docs.count())
    assert docs.columns == [*columns, "copy"]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    leaked = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    texts = [r.text for r in docs.collect()]
    assert not any(r.text in t for r in leaked for t in texts)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    assert cp.run(spark, sf).count() == counts[-1]


def test_odd_rows_pass_through(spark, sf):
    rows = [(1, None, "en", "a", 1), (2, "", None, "a", 0), (None, "the word of this", "en", None, 5), (3, "123", "en", "b", 3), (4, "the word of this", None, "b", 16), (4, "the word of this", None, "b", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_copies_leave_one(spark, sf):
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(5, base, "en", "a", 1), (2, base, "en", "b", 1), (9, "other words of a text", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, sf).collect()) == [2, 9]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracles(spark, sf, name):
    assert spark_rows(q.queries()[name](spark, sf)) == duck_rows(q.oracle_sql()[name], sf)


def test_clashing_columns(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = ["id", "gone", "exact", "near", "cut", "doc", "_doc", "_lines", "copy", "score", "lang_pred", "_lang_pred", "held_out", "chunk", "fp", "component_id", "size", "place", "mix_key", "taken", "target", "low", "width", "t", "p", "h", "no", "line", "component", "letter", "_letter2", "a.b"]
    from pyspark.sql import functions as F

    docs = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert set(base.columns) <= set(docs.columns) and len(set(docs.columns)) == len(docs.columns)
        assert docs.count() > 0
    from mnemospark.llm import fm, langid, ppm, rules, simhash

    docs = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for frame in (ppm.score_documents(docs), langid.identify(docs), simhash.near_duplicates(docs), rules.judge(docs), fm.classify(docs, spark.read.parquet(f"{sf}/labels.parquet").withColumn("score", F.lit(1)))):
        assert frame.count() == 40


def test_language_stage_keeps_mixed_and_clean_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = {r.lang: r.text for r in docs.where("n_chars > 600").collect()}
    two = list(some.values())[:2]
    odd = [(10_001, two[0][:500] + " " + two[1][:500]), (10_002, "12 34 !! -- 56"), (10_003, "☃ ☃ 123"), (10_004, None), (10_005, "")]
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in odd], docs.schema)
    kept = {r.doc_id for r in cp.language_id(spark, docs.unionByName(more), sf).collect()}
    lettered = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert kept == lettered | {10_001}


def test_stages_with_shared_and_missing_ids(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words = " ".join(f"word{i} of this text" for i in range(60))
    rows = [(1, words), (1, "quite another text under one id, and it is kept"), (None, words + " tail"), (None, item), (1, item), (2, "something of its own, in a line")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = [r.text for r in cp.decontaminate(spark, docs, sf).collect()]
    assert sorted(clean) == sorted(t for _, t in rows if t != item)
    left = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, sf).collect()]
    assert (1, words) in left and (1, rows[1][1]) in left and (2, rows[5][1]) in left and sum(t == item for _, t in left) == 1
    assert sorted(cp.line_dedup(spark, docs, sf).toPandas().text) == sorted({t for _, t in rows})
