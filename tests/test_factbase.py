import pytest
from pyspark.sql import functions as F

from factloom.factbase import ENTITIES, EVIDENCE, FACTS, FactBase
from factloom.operators import conflicts as K
from factloom.operators import registry
from factloom.operators import resolve as R
from factloom.operators.ontology import EntityType, Ontology, Predicate
from factloom.sources.store import Store


def day(i):
    return F.lit(f"2026-01-0{i + 1} 00:00:00")



def ontology():
    o = Ontology()
    o.add_type(EntityType("Person"))
    o.add_predicate(Predicate("BIRTH_YEAR", ("Person",), "integer", "one"))
    return o


def batch(spark, *rows):
    """(fact_id, year, confidence) as facts and evidence."""
    facts = spark.createDataFrame([(i, f, "p", "BIRTH_YEAR", f"int:{y}", str(y), None, None, "{}", c, "active", None, None) for i, (f, y, c) in enumerate(rows)], FACTS)
    evidence = spark.createDataFrame([(f, i, "s", None, f"quote {f} {c}", c, "x", None) for i, (f, _, c) in enumerate(rows)], EVIDENCE)
    return facts, evidence


def statuses(base):
    return {r["fact_id"]: r["status"] for r in base.facts.collect()}


def test_merging_judging_and_deciding(spark, tmp_path):
    base = FactBase.empty(spark, ontology(), "highest_confidence")
    base = base.add(*batch(spark, ("a", 1706, 0.6)), day(0))
    again = base.add(*batch(spark, ("a", 1706, 0.5)), day(1))
    (fact,) = again.facts.collect()
    assert fact["confidence"] == pytest.approx(0.8) and fact["recorded_at"].day == 1 and again.evidence.count() == 2
    assert again.add(*batch(spark, ("a", 1706, 0.5)), day(2)).evidence.count() == 2

    won = base.add(*batch(spark, ("b", 1707, 0.9)), day(1))
    assert statuses(won) == {"a": "superseded", "b": "active"} and [r["winner"] for r in won.conflicts.collect()] == ["b"]
    assert [r["fact_id"] for r in won.find(as_of="2026-01-01T12:00:00Z").collect()] == ["a"] and [r["fact_id"] for r in won.find().collect()] == ["b"]
    more = won.add(*batch(spark, ("c", 1708, 0.9), ("a", 1706, 0.99)), day(2))
    assert statuses(more) == {"a": "superseded", "b": "active", "c": "active"} and more.find_conflicts(open_only=True).first()["conflict_id"] == "conflict:2"
    done, refused = more.decide(spark.createDataFrame([("conflict:2", "c"), ("conflict:1", "c")], "conflict_id string, winner string"), day(3))
    assert statuses(done)["b"] == "superseded" and refused.count() == 1

    store = Store(spark, f"file://{tmp_path}/base", ontology())
    done.save(store)
    back = FactBase.load(Store(spark, f"file://{tmp_path}/base"))
    assert statuses(back) == statuses(done) and back.conflicts.count() == 2 and back.get("c").count() == 1


def test_without_ontology_nothing_conflicts(spark):
    base = FactBase.empty(spark).add(*batch(spark, ("a", 1706, 0.6), ("b", 1707, 0.9)), day(0))
    assert set(statuses(base).values()) == {"active"} and base.conflicts.count() == 0


def test_own_policy(spark):
    pairs = spark.createDataFrame([("a", "b")], "fact_a string, fact_b string")
    measured = spark.createDataFrame([("a", 0.1, 0.2, 1.0), ("b", 0.9, 0.1, 2.0)], "fact_id string, confidence double, authority double, latest double")
    policy = lambda: F.when(F.col("authority_a") + F.col("confidence_a") < F.col("authority_b") + F.col("confidence_b"), F.col("fact_b"))
    assert K.judged(pairs, measured, policy).first()["winner"] == "b"


def test_registry(spark):
    have = spark.createDataFrame([(1, "a", "A", None, None, True)], ENTITIES)
    new = spark.createDataFrame([(2, "a", "other", None, None, False), (3, "b", "B", None, ["x"], True), (4, "b", "B2", None, None, False), (5, "", "C", None, None, False)], ENTITIES)
    all_, refused = registry.add(have, new)
    assert sorted((r["id"], r["label"]) for r in all_.collect()) == [("a", "A"), ("b", "B")] and sorted(r["seq"] for r in refused.collect()) == [2, 4, 5]
    more = registry.add_aliases(all_, spark.createDataFrame([("b", "y"), ("b", "x"), ("z", "q"), ("a", None)], "id string, alias string"))
    assert {r["id"]: r["aliases"] for r in more.collect()} == {"a": [], "b": ["x", "y"]}
    assert [r["id"] for r in registry.provisional(registry.confirm(more, spark.createDataFrame([("b",)], "id string"))).collect()] == ["a"]


def test_own_resolver(spark):
    ddl = "STRUCT<kind: STRING, text: STRING, hint: STRING>"
    claims = spark.createDataFrame([(1, ("string", "Ben", None), "P", ("string", "x", None)), (2, ("string", "Zed", None), "P", None)], f"seq long, subject {ddl}, predicate string, object {ddl}")
    mine = lambda m: m.withColumn("entity_id", F.when(F.col("text") == "Ben", "person:ben"))
    done, fresh = R.resolve_claims(claims, spark.createDataFrame([], ENTITIES), resolver=mine)
    assert {r["seq"]: (r["subject"]["kind"], r["subject"]["text"]) for r in done.collect()} == {1: ("ref", "person:ben"), 2: ("mention", "Zed")} and fresh.count() == 0
