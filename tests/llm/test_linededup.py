import random

import pytest

from mnemospark.llm import linededup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _plain(docs, least):
    """The places (row of ``docs``, line) that go, by trying all pairs; order by (id, row key), a null id first."""
    order = {i: (d is not None, d or 0, key) for i, (d, _, key) in enumerate(docs)}
    lines = [(order[i], n, i, s.strip(" \t\x0b\x0c\r").lower()) for i, (_, t, _) in enumerate(docs) if t is not None for n, s in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[3]) >= least and any(c.isalnum() for c in x[3]))
    gone = set()
    for i, (o, n, row, s) in enumerate(lines):
        if any((e[0], e[1]) < (o, n) and abs(len(e[3]) - len(s)) <= 1 and _edits(e[3], s) <= 1 for e in lines[:i]):
            gone.add((row, n))
    return gone


def _keyed(spark, docs):
    """docs with their row keys, which Spark computes."""
    from mnemospark.llm.nativetext import row_key

    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, i int")
    return [(r.doc_id, r.text, r.key) for r in df.select("*", row_key().alias("key")).orderBy("i").collect()]


def _mutated(rnd, s):
    i = rnd.randrange(len(s))
    return rnd.choice([s[:i] + s[i + 1 :], s[:i] + "é" + s[i:], s[:i] + "#" + s[i + 1 :], s[:i] + s[i : i + 1] + s[i:], s])


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_against_all_pairs(spark, broadcast_rows):
    rnd = random.Random(7)
    seeds = ["".join(rnd.choice("abcab ") for _ in range(rnd.randrange(10, 16))).strip() + "xyz" for _ in range(25)]
    docs = []
    for d in range(60):
        parts = [_mutated(rnd, rnd.choice(seeds)) if rnd.random() < 0.7 else "".join(rnd.choice("abc") for _ in range(12)) for _ in range(4)]
        docs.append((d % 50, "\n".join(parts)))  # ten ids are shared by two texts
    docs += [(100, None), (101, ""), (102, "short\n\n"), (103, seeds[0]), (104, "  " + seeds[0].upper() + " "), (None, seeds[1] + "\nof no id"), (None, "of no id"), (102, "short\n\n")]
    keyed = _keyed(spark, docs)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA)
    got = {(r.row, r.no) for r in linededup.repeated_lines(df, broadcast_rows=broadcast_rows).collect()}
    assert got == {(keyed[i][2], n) for i, n in _plain(keyed, 1)} and len(got) > 30
    long_ = {(r.row, r.no) for r in linededup.repeated_lines(df, min_chars=12, broadcast_rows=broadcast_rows).collect()}
    assert long_ == {(keyed[i][2], n) for i, n in _plain(keyed, 12)} and len(long_) < len(got)


def test_rows_that_share_an_id_keep_what_only_they_say(spark):
    a, b, line = "a line that one row has", "quite another sentence", "x" * 40
    rows = [(5, f"{line}\n{a}"), (5, f"{b}\n{line}"), (None, f"{line}\nno id, own words"), (None, "no id, other words"), (5, f"{line}\n{a}")]
    got = [r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    words = "\n".join(dict.fromkeys(got))
    assert len(got) == 5 and all(words.count(x) == 1 for x in (a, b, line, "no id, own words", "no id, other words"))


def test_texts_and_columns(spark):
    line, near = "a line that is long enough to count here", "a line that is long enough to count hero"
    rows = [(1, f"{line}\nkeep me", "x"), (2, f"and me\n{near}\n{line}", "y"), (3, line, "z"), (None, "of no id", "n"), (4, None, "n"), (3, line, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, no string")
    got = {(r.doc_id, r.no): r for r in linededup.dedup(df).collect()}
    assert got[1, "x"].text == f"{line}\nkeep me"
    assert got[2, "y"].text == "and me" and got[None, "n"].text == "of no id" and (got[2, "y"]._exact, got[2, "y"]._near, got[2, "y"]._lines) == (1, 1, 3)
    assert got[3, "z"].text == "" and got[4, "n"].text is None
    assert linededup.dedup(df).count() == 6 and linededup.dedup(df.limit(0)).count() == 0


def test_long_line(spark):
    long = "abcdefghij" * 20_000
    df = spark.createDataFrame([(1, long, "", "", 1), (2, long[:100_000] + "X" + long[100_001:], "", "", 1)], SCHEMA)
    assert [(r.no, r.near) for r in linededup.repeated_lines(df).collect()] == [(0, True)]


def test_one_edit_by_trying():
    rnd = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(6))) for _ in range(2))
        assert linededup.within_one(a, b) == (_edits(a, b) <= 1)


def test_only_one_edit(spark):
    with pytest.raises(ValueError):
        linededup.repeated_lines(spark.createDataFrame([], SCHEMA), max_edits=2)


def test_short_lines_as_the_query_and_the_pipeline_call_it(spark, tmp_path):
    import corpus_pipeline as cp
    from mnemospark.llm import queries

    rnd = random.Random(3)
    words = ["all rights reserved.", "les.", "ok", "7", "licensed under cc by-nc 4.0.", "a line that is long enough to count here"]
    docs = [(d, "\n".join(_mutated(rnd, rnd.choice(words)) if rnd.random() < 0.7 else rnd.choice(["--", "", "}", "other %d" % rnd.randrange(99)]) for _ in range(4))) for d in range(40)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], SCHEMA)
    gone = _plain(_keyed(spark, docs), 1)
    want = {d: "\n".join(s for n, s in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == want and len(gone) > 60
    kept = {r.doc_id: r.text for r in cp.line_dedup(spark, df, "").collect()}
    assert kept and kept == {d: t for d, t in want.items() if t.strip() or t == dict(docs)[d]}
