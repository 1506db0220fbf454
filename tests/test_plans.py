import pytest

from mnemospark.plans import dsl
from mnemospark.plans.engine import Engine, Request, classify, plan
from mnemospark.sources import records as R

GOOD = """
namespace demo
use base
entity_type Person { name: text, age: number, home: ref<City>, mood: enum["good", "bad"] }
entity_type City { name: text }
kind Habit { cardinality: set }
predicate works_at { kind: Fact, stateful: true, subject: Person }
relation_type knows { from: Person, to: Person, symmetric: true, cardinality: many_to_many }
extractor names { pattern: /[A-Z][a-z]+ham/, target: Person, when: salience >= 0.0 and context in ["en"] }
"""


def test_parse_and_validate(spark):
    schema = dsl.parse(GOOD)
    assert schema.namespace == "demo" and dsl.validate(schema) == []
    assert [r.name for r in schema.dictionary(spark, "entity_type").orderBy("id").collect()] == ["Person", "City"]


def test_validation_codes(spark):
    bad = dsl.parse("entity_type A { x: ref<Nope>, y: blob } kind Fact { } predicate p { kind: Odd, subject: Z } relation_type r { from: A, to: B, symmetric: true, cardinality: some } extractor e { pattern: /(/ }")
    assert {w.split(":")[0] for w in dsl.validate(bad)} == {"missing_namespace", "unknown_ref", "unknown_attribute_type", "reserved_kind", "unknown_kind", "unknown_entity_type", "unknown_cardinality", "asymmetric_ends", "bad_pattern"}
    with pytest.raises(dsl.DslError):
        dsl.parse("entity_type A { ")
    with pytest.raises(dsl.DslError):
        dsl.condition("a ! 3")


def test_conditions(spark):
    df = spark.createDataFrame([(1, "x1", 0.5), (2, "y", 0.9)], "id long, s string, n double")
    of = lambda c: sorted(r.id for r in df.where(dsl.condition(c)).collect())
    assert of('s matches /^x\\d/ or n > 0.8') == [1, 2]
    assert of('not (s = "y") and n < 1') == [1]
    assert of("id in [2, 3]") == [2]


def test_extract(spark):
    m = spark.createDataFrame([(1, "en", 0.2, "Beckham met Oldham"), (2, "de", 0.2, "Beckham")], "memory_id long, context string, salience double, text string")
    out = dsl.extract(m, dsl.parse(GOOD)).collect()
    assert sorted((r.memory_id, r.surface) for r in out) == [(1, "Beckham"), (1, "Oldham")]


def test_router():
    assert classify("list all tickets", False) == "ListAggregation" and classify("how many tickets", False) == "ListAggregation"
    assert classify("status of ABC-123", False) == "ExactTerm" and classify("FOO BAR_9", False) == "ExactTerm"
    assert classify("where does Alice work", False) == "EntityAnchored" and classify("hello", True) == "EntityAnchored"
    assert classify("hello there", False) == "Paraphrase" and classify("", False) == "Default"
    p = plan(Request(cue=[1.0], text="where does Alice work"))
    assert p.lanes == ("semantic", "lexical") and p.weights == {"semantic": 1.0, "lexical": 1.0} and p.pool == 100
    p = plan(Request(cue=[1.0], text="x", anchor=5))
    assert p.lanes == ("semantic", "lexical", "graph") and p.weights == {"semantic": 1.0, "lexical": 1.0, "graph": 2.0}
    assert plan(Request(cue=[1.0], text="see ABC-1")).weights == {"semantic": 1.0, "lexical": 2.0}
    assert plan(Request(text="how many x", limit=200)).pool == 400 and "top 200" in plan(Request(text="x", limit=90)).render()
    with pytest.raises(ValueError):
        plan(Request())


def test_terms():
    from mnemospark.operators.lexical import content_terms

    assert content_terms("Where will the Harbour office move to in March?") == ["harbour", "office", "move", "march"]
    assert content_terms("who are you") == ["who", "are", "you"] and content_terms("") == []


def test_anchored_recall(spark, sf):
    m, v = R.memories(spark, sf), R.vectors(spark, sf)
    edges = spark.createDataFrame([(3, "SimilarTo", 4, 0.9), (3, "FollowedBy", 5, 0.9)], "src long, kind string, dst long, weight double")
    out = Engine(m, v, edges).recall(Request(text="of the", anchor=3, limit=1000, pool=200)).collect()
    by = {r.item_id: r.lanes for r in out}
    assert "graph" in by[4] and "graph" in by[3] and "graph" not in by.get(5, "")


def test_a_rare_scope_still_fills_its_page(spark, sf):
    m, v = R.memories(spark, sf), R.vectors(spark, sf)
    agent = m.groupBy("agent").count().orderBy("count", "agent").first()
    cue = list(v.where("memory_id = 0").first()["v"])
    got = Engine(m, v).recall(Request(cue=cue, agents=(agent["agent"],), limit=5, pool=5)).collect()
    inside = {r.memory_id for r in m.where(m["agent"] == agent["agent"]).join(v, "memory_id", "left_semi").collect()}
    assert len(got) == min(5, len(inside)) and {r.item_id for r in got} <= inside


def test_trace_and_deepening(spark, sf):
    engine = Engine(R.memories(spark, sf), R.vectors(spark, sf))
    request = Request(text="thanedble anea erinter", contexts=("es",), limit=5, pool=3)
    inside = {r.memory_id for r in R.memories(spark, sf).where("context = 'es'").collect()}
    assert engine.trace(Request(text="thanedble anea erinter", limit=5, pool=3))["lanes"] == {"lexical": 3}
    scoped = {r.item_id for r in engine.lane("lexical", request, 3).collect()}
    assert scoped <= inside and engine.trace(request)["lanes"] == {"lexical": len(scoped)}
    assert engine.recall_deep(request).count() >= engine.recall(request).count()
