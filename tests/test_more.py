import pytest
from pyspark.sql import functions as F

from mnemospark.functions import analyzer as A
from mnemospark.operators import graph, ranking, statements
from mnemospark.plans import access, cost
from mnemospark.plans.schema_store import SchemaStore
from mnemospark.sources import connector


def test_stems():
    golden = """generously:generous skies:sky news:news dying:die running:run consistency:consist consolation:consol knightly:knight happy:happi
    national:nation hopping:hop hoping:hope generate:generat communication:communic arsenal:arsenal cry:cri by:by say:say kiwis:kiwi gas:gas this:this
    ties:tie cries:cri proceed:proceed succeeding:succeed luxuriating:luxuri relational:relat possibly:possibl ability:abil controlling:control rolled:roll
    agreed:agre feed:feed caresses:caress flies:fli ponies:poni bed:bed shed:shed bead:bead youth:youth boyish:boyish sensational:sensat adjustment:adjust
    hopefulness:hope electricity:electr apologies:apolog analogously:analog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas"""
    assert [A.stem(p.split(":")[0]) for p in golden.split()] == [p.split(":")[1] for p in golden.split()]
    assert A.stem("café") == "café" and A.stem("x1") == "x1" and A.stem("a") == "a"


def test_analyzer_protects_ids_and_urls(spark):
    assert A.analyze_text("See ABC-123 at https://e.com/Running, api.v2 Cafés running") == ["see", "abc-123", "at", "https://e.com/running,", "api.v2", "cafés", "run"]
    df = spark.createDataFrame([("Running dogs",), (None,)], "t string")
    assert [r[0] for r in df.select(A.analyzed(F.col("t"))).collect()] == [["run", "dog"], []]


def test_embedder_is_a_histogram(spark):
    v = spark.createDataFrame([("ab",)], "t string").select(A.embedded(F.col("t"), 4)).first()[0]
    n = (97**2 + 98**2) ** 0.5
    assert v == pytest.approx([97 / n, 98 / n, 0, 0])


def test_event_dates(spark):
    def of(text):
        return [str(d) for d in spark.createDataFrame([(text,)], "t string").select(A.event_dates(F.col("t"), F.lit("2024-03-31").cast("date"))).first()[0]]

    assert of("on 2023-05-06, in 1999; last month") == ["2023-05-06", "1999-01-01", "2024-02-29"]
    assert of("3 weeks ago and 2 years ago, 2023-02-30") == ["2024-03-10", "2022-03-31"]
    assert of("this week, in 2 days; on Sunday and Monday, NEXT YEAR") == ["2024-03-31", "2025-03-31", "2024-04-02", "2024-03-24", "2024-03-25"]
    assert of("nothing") == [] and of(None) == []


def test_access(spark):
    me = access.Caller(1, "a")
    access.require(me, "recall")
    with pytest.raises(access.Denied):
        access.require(me, "backfill")
    with pytest.raises(ValueError):
        access.require(me, "fly")
    assert access.agents_in_scope(me) == ("a",) and access.agents_in_scope(me, include_others=True) is None and access.agents_in_scope(me, ("b",), True) == ("b",)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "namespace int, agent string")
    assert access.walled(df, me, ("a",)).count() == 1 and access.walled(df, me, None).count() == 2
    with pytest.raises(ValueError):
        access.check_filters("statement", {"contexts"})
    access.check_filters("both", {"contexts", "predicates"})
    assert access.capabilities(64, ["x"])["vector_dim"] == 64


def test_costs_order_plans():
    assert cost.recall_ms(10, 1.0, 10**6, True) < cost.recall_ms(10, 0.01, 10**6, True) < cost.recall_ms(10, 0.01, 10**6, False)
    assert cost.within_budget(5) and not cost.within_budget(5000)


def test_connector_and_tiers(spark):
    connector.register_connector(spark, "numbers_src", "n int, part int", lambda request, part: ((int(request) * 10 + part, part),), partitions=3)
    assert sorted(r.n for r in spark.read.format("numbers_src").option("request", "4").load().collect()) == [40, 41, 42]
    enrichers = connector.Enrichers()
    enrichers.add("one", lambda df: df.withColumn("x", F.lit(1)))
    with pytest.raises(ValueError):
        enrichers.add("one", lambda df: df)
    assert enrichers.apply(spark.range(2)).columns == ["id", "x"]
    mem = spark.createDataFrame([(1, "a b"), (2, "c")], "memory_id long, text string")
    tier = lambda word, name: lambda todo, found: todo.where(F.col("text").contains(word)).select("memory_id", F.lit(name).alias("extractor"))
    assert sorted((r.memory_id, r.extractor) for r in connector.Tiers(tier("a", "first"), tier("", "second")).run(mem).collect()) == [(1, "first"), (2, "second")]


def test_schema_versions():
    store = SchemaStore()
    assert store.upload("namespace n predicate p { kind: Fact } predicate q { kind: Fact }") == (1, {"predicate p": "added", "predicate q": "added"})
    version, changes = store.upload("namespace n predicate p { kind: Event }")
    assert version == 2 and changes == {"predicate p": "changed"} and set(store.get("n").declared["predicate"]) == {"p", "q"}
    assert store.upload("namespace n predicate p { kind: Event }", replace=True)[1] == {"predicate q": "removed"}
    assert store.list() == [("n", 3)] and "q" in store.get("n", 1).declared["predicate"]
    with pytest.raises(ValueError):
        store.upload("namespace n predicate p { kind: Odd }")


def test_statement_shapes(spark):
    rows = [(0.5, "Fact", None, 1, 2), (1.5, "Fact", None, 1, 2), (0.5, "Event", None, 1, 2), (0.5, "Fact", 3, 1, 2), (0.5, "Event", 3, 2, 1)]
    df = spark.createDataFrame(rows, "confidence double, kind string, event_at int, valid_from int, valid_to int")
    assert [r.error for r in statements.shape_errors(df).collect()] == [None, "confidence", "event_without_time", "time_without_event", "window"]


def test_grounded_walk_keeps_a_beam(spark):
    edges = spark.createDataFrame([(1, "k", i, 1.0) for i in range(2, 9)] + [(2, "l", 20, 1.0), (8, "k", 21, 1.0)], "src long, kind string, dst long, weight double")
    kinds = spark.createDataFrame([("k", 0.9), ("l", 0.5)], "kind string, cos double")
    out = {r.node: r.hop for r in graph.grounded_walk(F.lit(1), edges, kinds, hops=2, beam=4).collect()}
    assert out == {2: 1, 3: 1, 4: 1, 5: 1, 20: 2}


def test_rerank_blend_outside_window_is_zero(spark):
    df = spark.createDataFrame([(i, 1.0 / i, 0.0) for i in range(1, 6)], "item long, fused double, logit double")
    out = {r.item: r.blend for r in ranking.rerank_blend(df, "fused", "logit", "item", window=2).collect()}
    assert out[1] > out[2] > 0 and out[3] == out[4] == out[5] == 0.0
