import re
from collections import Counter

from mnemospark.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


CASES = [None, "", " \n\t", "a b", "a a a", "a a a a", "x y z x y z", "one\none\n one\n\none", "é ü €\x0b\x0c\rß", "the of and " * 40, "# $ % & | < > *" * 20]
CASES += [" ".join(f"w{(i * i) % 97}" for i in range(n)) + "\nthe of\nthe of" for n in (60, 400, 3000)] + ["the end of a word and " + " ".join(f"{i}x" for i in range(200))]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(CASES)] * 2, SCHEMA)
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(df).collect())
    assert got == sorted([(i, *_plain(t)) for i, t in enumerate(CASES)] * 2)


def test_verdict_follows_the_table(spark):
    prose = " ".join(["the", "house", "of", "people", "and"] + [f"word{i}" for i in range(60)])
    df = spark.createDataFrame([(1, prose, 5, 6), (2, prose.replace("word", "#|#"), 5, 6), (3, "short", 5, 6), (4, " ".join(f"word{i}" for i in range(70)), 5, 6)], "doc_id long, text string, n_words int, _w int")
    assert {r.doc_id: r.kept for r in rules.judge(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.doc_id: r.kept for r in rules.judge(df, []).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert rules.judge(df.limit(0)).count() == 0


def test_labelled_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs).join(labels, "doc_id").where("n_words >= 50").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = rules.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
