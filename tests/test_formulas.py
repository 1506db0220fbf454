"""Golden values and properties of the pure formulas."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.operators import ranking, statements


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def _lists(spark, rows):
    return spark.createDataFrame(rows, "lane string, item_id long, rank long, score double")


def test_rrf_worked_example(spark):
    out = {r.item_id: r.fused for r in ranking.rrf(_lists(spark, [("a", i, i, 1.0) for i in (1, 2, 3, 10)]), k=60).collect()}
    assert [out[i] for i in (1, 2, 3, 10)] == pytest.approx([1 / 61, 1 / 62, 1 / 63, 1 / 70])


def test_adaptive_k(spark):
    assert [_one(spark, ranking.adaptive_k(F.lit(n))) for n in (0, 199, 200, 1999, 2000)] == [15, 15, 30, 30, 60]


def test_minmax_keeps_the_gap(spark):
    out = {r.item_id: r.fused for r in ranking.fuse_relative(_lists(spark, [("a", 1, 1, 0.95), ("a", 2, 2, 0.50), ("a", 3, 3, 0.45)]), {}, "minmax").collect()}
    assert out[1] == 1.0 and out[1] - out[2] > 0.85


def test_flat_lanes(spark):
    rows = [("a", 1, 1, 0.5), ("a", 2, 2, 0.5)]
    assert {r.fused for r in ranking.fuse_relative(_lists(spark, rows), {}, "minmax").collect()} == {1.0}
    assert {r.fused for r in ranking.fuse_relative(_lists(spark, rows), {}, "zscore").collect()} == {0.0}


def test_confidence_bucket(spark):
    assert [_one(spark, S.confidence_bucket(F.lit(c))) for c in (0.0, 0.05, 0.5, 0.95, 1.0, -0.5, 2.0)] == [0, 0, 5, 9, 10, 0, 10]


def test_proximity_and_clamp(spark):
    assert [_one(spark, S.proximity(F.lit(h))) for h in (0, 1, 3)] == [1.0, 0.5, 0.25]
    assert [_one(spark, S.clamp01(F.lit(x))) for x in (2.0, -1.0, 0.5)] == [1.0, 0.0, 0.5]


def test_evidence_decay(spark):
    five_years = 5 * 365 * 86400
    assert _one(spark, F.lit(0.9) * S.evidence_decay(F.lit("Event"), F.lit(five_years))) == pytest.approx(0.9)
    assert _one(spark, S.evidence_decay(F.lit("Fact"), F.lit(365 * 86400))) == pytest.approx(math.exp(-1))
    assert _one(spark, S.evidence_decay(F.lit("Preference"), F.lit(60 * 86400))) == pytest.approx(math.exp(-1))
    assert _one(spark, F.lit(0.5) * S.evidence_decay(F.lit("Fact"), F.lit(-100))) == 0.5


def test_noisy_or(spark):
    df = spark.createDataFrame([("many", 0.1)] * 100 + [("sure", 1.0), ("sure", 0.3), ("over", 7.0), ("none", None)], "g string, c double")
    out = {r.g: r.x for r in df.groupBy("g").agg(S.noisy_or(F.col("c")).alias("x")).collect()}
    assert out["many"] >= 0.99 and out["sure"] == 1.0 and out["over"] == 1.0 and out["none"] == 0.0


def test_geometric_mean(spark):
    of = lambda *xs: _one(spark, S.geometric_mean(F.array(*map(F.lit, xs))))
    assert of(2.0, 8.0) == pytest.approx(4.0) and of(2.0, 0.0) == 0.0
    assert _one(spark, S.geometric_mean(F.array().cast("array<double>"))) == 0.0


def test_names_and_trigrams(spark):
    assert _one(spark, S.normalize_name(F.lit("  The   Big Apple "))) == "big apple"
    assert _one(spark, S.normalize_name(F.lit("the"))) == "the"
    grams = _one(spark, S.trigrams(F.lit("cat")))
    assert sorted(grams) == sorted(["  c", " ca", "cat", "at "])
    assert _one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_sweep_moves_slowly(spark):
    assert _one(spark, statements.sweep(F.lit(0.5), F.lit(0.9))) == pytest.approx(0.52)
    assert _one(spark, statements.sweep(F.lit(0.5), F.lit(0.5004))) == 0.5


def test_consensus_and_autocut(spark):
    rows = spark.createDataFrame([(1, 3, 0.9), (2, 1, 0.8), (3, 1, 0.7)], "item long, n_lanes int, cos double")
    assert [r.item for r in ranking.consensus(rows, "n_lanes", "cos", "item").collect()] == [1]
    tied = spark.createDataFrame([(1, 2, 0.9), (2, 2, 0.8)], "item long, n_lanes int, cos double")
    assert ranking.consensus(tied, "n_lanes", "cos", "item").count() == 2
    scores = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.4), (4, 0.39)], "item long, s double")
    assert sorted(r.item for r in ranking.autocut(scores, "s", "item").collect()) == [1, 2]


def test_mmr_prefers_what_is_new(spark):
    rows = [(1, 1, 1.0, "alpha beta gamma"), (1, 2, 0.95, "alpha beta gamma"), (1, 3, 0.6, "delta epsilon zeta")]
    df = spark.createDataFrame(rows, "cue long, item long, score double, text string")
    out = [r.item for r in ranking.mmr(df, "cue", "item", "score", "text").orderBy("place").collect()]
    assert out == [1, 3, 2]
    tied = spark.createDataFrame([(1, i, 1.0, f"word{i}") for i in range(4)], "cue long, item long, score double, text string")
    assert [r.item for r in ranking.mmr(tied, "cue", "item", "score", "text").orderBy("place").collect()] == [3, 2, 1, 0]  # the last of equals
    long_ = spark.createDataFrame([(1, i, 100.0 - i, f"word{i}") for i in range(60)], "cue long, item long, score double, text string")
    places = {r.item: r.place for r in ranking.mmr(long_, "cue", "item", "score", "text").collect()}
    assert len(places) == 60 and all(places[i] == i + 1 for i in range(50, 60))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), min_size=1, max_size=20, unique=True), st.randoms())
def test_rrf_does_not_depend_on_order(spark, pairs, rnd):
    rows = [(lane, item, i + 1, 0.5) for i, (lane, item) in enumerate(pairs)]
    first = sorted(tuple(r)[:1] + (round(r.fused, 12),) for r in ranking.rrf(_lists(spark, rows), k=60).collect())
    rnd.shuffle(rows)
    assert first == sorted(tuple(r)[:1] + (round(r.fused, 12),) for r in ranking.rrf(_lists(spark, rows), k=60).collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_noisy_or_is_bounded_and_monotone(spark, xs):
    df = spark.createDataFrame([(0, x) for x in xs] + [(1, x) for x in [*xs, 0.5]], "g int, c double")
    out = {r.g: r.x for r in df.groupBy("g").agg(S.noisy_or(F.col("c")).alias("x")).collect()}
    assert 0 <= out[0] <= 1 and out[1] >= out[0] - 1e-12


def test_supersession_has_one_current_row(spark):
    rows = [(i, i % 3, "p", "Attribute", str(i), f"2024-01-{1 + i % 5:02d}") for i in range(30)]
    st_ = spark.createDataFrame(rows, "statement_id long, subject int, predicate string, kind string, object string, extracted_at string")
    out = statements.supersede(st_)
    assert out.where("superseded_by IS NULL").count() == 3
    assert out.groupBy("chain_root").agg(F.max("version").alias("v"), F.count("*").alias("n")).where("v <> n").count() == 0


def test_supersession_by_kind(spark):
    rows = [(1, 7, "a", "Fact", 1), (2, 7, "a", "Fact", 2), (3, 7, "s", "Preference", 1), (4, 7, "s", "Preference", 2), (5, 7, "s", "Event", 1), (6, 7, "s", "Event", 2), (7, 7, "d", "Directive", 1), (8, 7, "d", "Directive", 2)]
    df = spark.createDataFrame(rows, "statement_id long, subject int, predicate string, kind string, extracted_at int")
    pinned = df.withColumn("pinned_to", F.when(F.col("statement_id") == 7, 99))
    got = {r.statement_id: (r.superseded_by, r.valid_to) for r in statements.supersede(pinned, stateful=("s",)).collect()}
    assert {k for k, v in got.items() if v[0]} == {3, 7} and got[3] == (4, 2) and got[7] == (8, 99)


def test_mirrored_edges_have_a_cap(spark):
    from mnemospark.operators import derive

    edges = spark.createDataFrame([(1, i, 1.0 / i) for i in range(2, 30)] + [(2, 1, 0.4)], "src long, dst long, weight double")
    got = derive.mirrored(edges).collect()
    assert sum(r.src == 1 for r in got) == 16 and sum(r.dst == 1 for r in got) == 28 and len({(r.src, r.dst) for r in got}) == len(got)
