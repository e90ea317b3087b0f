import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.terms import TERM_DDL
from factloom.operators import checks as H
from factloom.operators import conflicts as K
from factloom.operators import export as X
from factloom.operators import facts as A
from factloom.operators import resolve as R
from factloom.operators import serve as Q
from factloom.operators import validate as V
from factloom.operators.ontology import EntityType, Ontology, Predicate
from factloom.sources.store import Store, upsert

FACTS = "seq long, fact_id string, subject_id string, predicate string, object_key string, object_json string, valid_from string, valid_to string, qualifiers_json string, confidence double, status string, recorded_at timestamp, superseded_at timestamp"
EVIDENCE = "fact_id string, position long, source_id string, locator string, quote string, confidence double, extractor string, extracted_at timestamp"
ENTITIES = "seq long, id string, label string, type string, aliases array<string>, provisional boolean"
SOURCES = "id string, kind string, uri string, title string, retrieved_at timestamp, authority double"


def ontology(strict=False):
    o = Ontology(strict=strict)
    for t in (EntityType("Person"), EntityType("Scientist", "Person"), EntityType("Place"), EntityType("Organization")):
        o.add_type(t)
    for p in (
        Predicate("BORN_IN", ("Person",), "Place", "one", "moment"), Predicate("BIRTH_YEAR", ("Person",), "integer", "one"),
        Predicate("WORKED_AT", ("Person",), "Organization"), Predicate("HEADQUARTERED_IN", ("Organization",), "Place", "one"),
    ):
        o.add_predicate(p)
    return o


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        (1, "person:franklin", "Benjamin Franklin", "Scientist", ["Ben Franklin"], False), (2, "place:boston", "Boston", "Place", [], False),
        (3, "place:philadelphia", "Philadelphia", "Place", [], False), (4, "org:post-office", "Post Office", "Organization", None, False),
        (5, "place:paris-fr", "Paris", "Place", [], False), (6, "place:paris-tx", "Paris", "Place", [], False), (7, "boston", "Boston, Lincolnshire", "Place", [], False),
        (8, "x:untyped", "Untyped", None, [], True),
    ]
    return spark.createDataFrame(rows, ENTITIES)


@pytest.fixture(scope="module")
def kitchen(spark):
    at = "2026-01-01 00:00:00"
    rows = [
        (1, "f1", "person:franklin", "BORN_IN", "ref:place:boston", '{"$ref": "place:boston"}', "1706-01-17", None, "{}", 0.9564, "active"),
        (3, "f2", "person:franklin", "BORN_IN", "ref:place:philadelphia", '{"$ref": "place:philadelphia"}', "1706-01-17", None, "{}", 0.54, "active"),
        (4, "f3", "person:franklin", "BIRTH_YEAR", "int:1706", "1706", None, None, "{}", 0.81, "active"),
        (5, "f4", "person:franklin", "WORKED_AT", "ref:org:post-office", '{"$ref": "org:post-office"}', "1753", "1774", '{"role": "Deputy Postmaster General"}', 0.72, "active"),
    ]
    facts = spark.createDataFrame(rows, FACTS.rsplit(", recorded_at", 1)[0]).withColumns({"recorded_at": F.lit(at).cast("timestamp"), "superseded_at": F.lit(None).cast("timestamp")})
    ev = [("f1", 0, "encyclopedia", 0.95), ("f1", 1, "letters", 0.7), ("f2", 0, "blog", 0.9), ("f3", 0, "encyclopedia", 0.9), ("f4", 0, "letters", 0.9)]
    evidence = spark.createDataFrame([(f, p, s, None, "q", c, "pattern") for f, p, s, c in ev], EVIDENCE.rsplit(", extracted_at", 1)[0]).withColumn("extracted_at", F.lit(at).cast("timestamp"))
    src = [("encyclopedia", "document", "https://example.org/franklin", "Encyclopedia", 0.9), ("letters", "document", None, None, 0.8), ("blog", "document", None, None, 0.6)]
    sources = spark.createDataFrame(src, "id string, kind string, uri string, title string, authority double").withColumn("retrieved_at", F.lit(None).cast("timestamp"))
    return facts, evidence, sources


def single(spark):
    return spark.createDataFrame([("BORN_IN",), ("BIRTH_YEAR",), ("HEADQUARTERED_IN",)], "predicate string")


# Ontology


def test_ontology_refuses_and_round_trips(spark):
    o = ontology()
    again = Ontology.from_json(o.to_json())
    assert again.to_dict() == o.to_dict() and o.is_a("Scientist", "Person") and not o.is_a("Person", "Scientist") and o.is_any("Place", ["Person", "Place"])
    for bad in (lambda: o.add_type(EntityType("Person")), lambda: o.add_type(EntityType("integer")), lambda: o.add_type(EntityType("X", "Nowhere")), lambda: o.add_predicate(Predicate("BORN_IN")), lambda: o.add_predicate(Predicate("P", "Nobody")), lambda: Predicate("P", cardinality="few")):
        with pytest.raises(ValueError):
            bad()
    assert Predicate("P", "Person").domain == ("Person",) and o.predicate("NONE") is None
    assert {tuple(r) for r in o.closure(spark).where("type_name = 'Scientist'").collect()} == {("Scientist", "Scientist"), ("Scientist", "Person")}


# Resolution


def test_resolution_tiers_types_and_ambiguity(spark, registry):
    asked = [("Ben Franklin", None), ("ben  franklin.", None), ("Paris", None), ("Boston", "Person"), ("Boston", "Place"), ("Benjamin Franklin", "Person"), ("Untyped", "Place"), ("   ", None), ("nobody", None), (None, None)]
    got = {(r["text"], r["hint"]): (r["entity_id"], r["score"], r["n_candidates"]) for r in R.resolve(spark.createDataFrame(asked, "text string, hint string"), registry, ontology()).collect()}
    assert got["Ben Franklin", None] == ("person:franklin", 1.0, 1) and got["ben  franklin.", None] == ("person:franklin", 0.9, 1)
    assert got["Paris", None] == (None, 1.0, 2) and got["Boston", "Person"] == (None, 0.0, 0) and got["Boston", "Place"] == ("place:boston", 1.0, 1)
    assert got["Benjamin Franklin", "Person"][0] == "person:franklin" and got["Untyped", "Place"][0] == "x:untyped" and got["   ", None][0] is None and len(got) == 9
    listed = R.candidates(spark.createDataFrame([("Paris", None)], "text string, hint string"), registry)
    assert {r["entity_id"] for r in listed.collect()} == {"place:paris-fr", "place:paris-tx"}


def test_claims_resolve_and_create(spark, registry):
    rows = [
        (1, ("string", "Ben Franklin", None), "BORN_IN", ("string", "Boston", None)), (2, ("mention", "Deborah Read", None), "BORN_IN", ("mention", "Paris", None)),
        (3, ("string", "deborah read", None), "BIRTH_YEAR", ("integer", "1708", None)), (4, ("string", "Boston", None), "LIKES", ("string", "tea", None)), (5, ("ref", "place:boston", None), "LIKES", None),
    ]
    claims = spark.createDataFrame(rows, f"seq long, subject {TERM_DDL}, predicate string, object {TERM_DDL}")
    done, fresh = R.resolve_claims(claims, registry, ontology())
    got = {r["seq"]: (r["subject"], r["object"]) for r in done.collect()}
    assert got[1][0]["text"] == "person:franklin" and got[1][1]["text"] == "place:boston" and got[1][1]["kind"] == "ref"
    assert got[2][0]["text"] == got[3][0]["text"] == "person:deborah-read" and got[2][1]["kind"] == "mention"
    assert got[4][0]["text"] == "place:boston" and got[4][1]["kind"] == "string" and got[5][1] is None
    made = fresh.collect()
    assert [(r["id"], r["label"], r["provisional"]) for r in made] == [("person:deborah-read", "Deborah Read", True)]
    stay, none = R.resolve_claims(claims, registry, ontology(), create=False)
    assert none.count() == 0 and {r["seq"]: r["subject"]["kind"] for r in stay.collect()}[2] == "mention"


def test_taken_ids_get_the_lowest_free_suffix(spark, registry):
    names = spark.createDataFrame([(1, "Boston!", "nothing")], "seq long, text string, hint string").select("seq", F.lit("Boston").alias("text"), F.lit(None).cast("string").alias("hint"))
    more = registry.select("id").unionByName(spark.createDataFrame([("boston-3",)], "id string")).withColumns({"label": F.lit("z")})
    assert [r["id"] for r in R.provisional(names, more).collect()] == ["boston-2"]
    both = names.unionByName(names.select("seq", F.lit("Boston").alias("text"), F.lit("").alias("hint")).withColumn("seq", F.lit(2).cast("long")))
    assert [r["id"] for r in R.provisional(both, more).orderBy("seq").collect()] == ["boston-2", "boston-4"]


# Validation


def claim(seq, subject=("ref", "person:franklin", None), predicate="BORN_IN", obj=("ref", "place:boston", None), confidence=0.9, start=None, end=None, evidence=1):
    return (seq, subject, predicate, obj, [(confidence, None)] * evidence, start, end, {})


CLAIMS = f"seq long, subject {TERM_DDL}, predicate string, object {TERM_DDL}, evidence array<struct<confidence: double, authority: double>>, valid_from string, valid_to string, qualifiers map<string, {TERM_DDL}>"

CASES = [
    (claim(1), "accepted", set()),
    (claim(2, predicate=" "), "rejected", {"predicate.empty"}),
    (claim(3, subject=("mention", "x", None)), "needs_review", {"subject.unresolved"}),
    (claim(4, obj=None), "rejected", {"object.missing"}),
    (claim(5, obj=("mention", "x", None)), "needs_review", {"object.unresolved"}),
    (claim(6, evidence=0), "rejected", {"provenance.missing", "confidence.unknown"}),
    (claim(7, start="2024-01-01T12:00:00"), "rejected", {"time.naive"}),
    (claim(8, predicate="WORKED_AT", obj=("ref", "org:post-office", None), start="1774", end="1753"), "rejected", {"time.empty_interval"}),
    (claim(9, predicate="ODD"), "accepted", {"schema.unknown_predicate"}),
    (claim(10, end="1800"), "rejected", {"schema.moment_with_end"}),
    (claim(11, subject=("ref", "place:boston", None)), "rejected", {"schema.domain"}),
    (claim(12, subject=("ref", "x:untyped", None)), "needs_review", {"schema.domain"}),
    (claim(13, subject=("ref", "person:nobody", None)), "needs_review", {"subject.unknown_entity"}),
    (claim(14, predicate="BIRTH_YEAR", obj=("string", "1706", None)), "rejected", {"schema.range"}),
    (claim(15, predicate="BIRTH_YEAR", obj=("boolean", "true", None)), "rejected", {"schema.range"}),
    (claim(16, predicate="BIRTH_YEAR", obj=("integer", "1706", None)), "accepted", set()),
    (claim(17, obj=("ref", "org:post-office", None)), "rejected", {"schema.range"}),
    (claim(18, obj=("integer", "3", None)), "rejected", {"schema.range"}),
    (claim(19, obj=("string", "Boston", None)), "needs_review", {"object.unresolved"}),
    (claim(20, confidence=0.1), "rejected", {"confidence.too_low"}),
    (claim(21, confidence=0.3), "needs_review", {"confidence.below_accept"}),
    (claim(22, confidence=None), "accepted", {"confidence.unknown"}),
    (claim(23, start="nonsense"), "rejected", {"time.invalid"}),
    (claim(24, obj=("ref", "place:nowhere", None)), "needs_review", {"object.unknown_entity"}),
]


def test_every_rule(spark, registry):
    df = spark.createDataFrame([c for c, _, _ in CASES], CLAIMS)
    got = {r["seq"]: (r["status"], {f["rule"] for f in r["findings"]}, r["fact_id"]) for r in V.validate(df, ontology(), registry).collect()}
    for c, status, rules in CASES:
        assert got[c[0]][:2] == (status, rules), c[0]
        assert (got[c[0]][2] is not None) == (status == "accepted")
    strict = {r["seq"]: r["status"] for r in V.validate(df, ontology(strict=True), registry).collect()}
    assert strict[9] == "rejected"


def test_validation_without_ontology_with_rules_and_limits(spark):
    df = spark.createDataFrame([claim(1, confidence=0.45), claim(2, predicate="ANY")], CLAIMS)
    rule = lambda: F.when(F.col("predicate") == "ANY", V.finding("mine", "warning", "m"))
    got = {r["seq"]: (r["status"], list(r["m"])) for r in V.validate(df, rules=[rule], accept_at=0.4).withColumn("m", V.reasons(F.col("findings"))).collect()}
    assert got == {1: ("accepted", []), 2: ("needs_review", ["m"])}
    with pytest.raises(ValueError):
        V.validate(df, accept_at=0.1, reject_below=0.2)
    ids = [r["fact_id"] for r in V.validate(spark.createDataFrame([claim(1), claim(2, confidence=0.6), claim(3, start="1706")], CLAIMS)).orderBy("seq").collect()]
    assert ids[0] == ids[1] != ids[2]
    assert V.validate(df.limit(0), ontology()).count() == 0


# Conflicts


def test_conflict_and_policies(spark, kitchen):
    facts, evidence, sources = kitchen
    pairs = K.detect(facts, single(spark))
    assert [(r["fact_a"], r["fact_b"]) for r in pairs.collect()] == [("f1", "f2")]
    measured = K.scores(facts, evidence, sources)
    winners = {p: K.judged(pairs, measured, p).first()["winner"] for p in K.POLICIES}
    assert winners == {"keep_both": None, "highest_confidence": "f1", "highest_authority": "f1", "most_recent_evidence": None}
    made = K.numbered(K.judged(pairs, measured, "keep_both"), F.lit("2026-01-02 00:00:00"), "keep_both", existing=4)
    assert made.first()["conflict_id"] == "conflict:5"
    ends = facts.withColumns({"valid_to": F.when(F.col("fact_id") == "f1", "1800"), "valid_from": F.when(F.col("fact_id") == "f1", "1750").otherwise("1800")})
    assert K.detect(ends, single(spark)).count() == 0


def test_facts_of_one_claim_are_rivals_each_and_judged_by_their_own_scores(spark):
    def fact(seq, fact_id, obj, confidence, start=None, end=None, qualifiers="{}"):
        return (seq, fact_id, "person:franklin", "BORN_IN", obj, None, start, end, qualifiers, confidence, "active", None, None)

    rows = [fact(1, "a1", "ref:x", 0.3), fact(2, "b", "ref:y", 0.5), fact(3, "a2", "ref:x", 0.9, qualifiers='{"role": 1}'), fact(4, "a1", "ref:x", 0.2), fact(5, "c", "ref:y", 0.9, "1700", "1600"), fact(6, "d", None, 0.9)]
    facts = spark.createDataFrame(rows, FACTS).repartition(3)
    measured = facts.groupBy("fact_id").agg(F.max("confidence").alias("confidence"))
    pairs = K.judged(K.detect(facts, single(spark)), measured, "highest_confidence")
    got = {(r["fact_a"], r["fact_b"], r["winner"]) for r in pairs.where("fact_b <> 'c'").collect()}
    assert got == {("a1", "b", "b"), ("b", "a2", "a2")}
    counted = {r["fact_id"]: r["n_rivals"] for r in K.fact_rival_counts(facts, single(spark)).collect()}
    assert counted == {"a1": 1, "a2": 1, "b": 2}
    assert {r["fact_id"]: r["rep"] for r in K.members_of(facts).collect()} == {"a1": "a1", "a2": "a1", "b": "b", "c": "c", "d": "d"}


def arrive(rows, policy):
    """Facts one by one, as lists."""
    active, out = {}, []
    for seq, fact, group, obj, start, end, score in rows:
        mine, lost = active.setdefault(group, []), False
        for rival in list(mine):
            r_seq, r_fact, r_obj, r_start, r_end, r_score = rival
            if r_obj == obj or (r_end is not None and start is not None and r_end <= start) or (end is not None and r_start is not None and end <= r_start):
                continue
            winner = None if policy == "keep_both" or score is None or r_score is None or score == r_score else fact if score > r_score else r_fact
            out.append(("conflict", r_fact, fact, winner))
            if winner == fact:
                out.append(("superseded", r_fact, fact, fact))
                mine.remove(rival)
            elif winner == r_fact:
                out.append(("superseded", fact, r_fact, r_fact))
                lost = True
                break
        if not lost:
            mine.append((seq, fact, obj, start, end, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("policy", ["keep_both", "highest_confidence"])
def test_settling_matches_arrival_one_by_one(spark, policy):
    rng = random.Random(7)
    plain, rows = [], []
    for seq in range(300):
        start = rng.choice([None, rng.randrange(1800, 1900)])
        end = None if start is None or rng.random() < 0.4 else start + rng.randrange(1, 40)
        score, group, obj = rng.choice([None, 0.1, 0.5, 0.5, 0.9]), f"s{rng.randrange(6)}", f"int:{rng.randrange(4)}"
        plain.append((seq, f"f{seq}", group, obj, start, end, score))
        rows.append((seq, f"f{seq}", group, "BORN_IN", obj, obj[4:], None if start is None else str(start), None if end is None else str(end), "{}", score, "active", None, None))
    facts = spark.createDataFrame(rows, FACTS).repartition(5)
    measured = facts.select("fact_id", "confidence")
    got = K.settle(facts.unionByName(facts.limit(20).withColumn("seq", F.col("seq") + 1000)), single(spark), measured, policy)
    assert sorted(((r["kind"], r["fact_a"], r["fact_b"], r["winner"]) for r in got.collect()), key=str) == arrive(plain, policy)
    assert K.settle(facts.limit(0), single(spark), measured, policy).count() == 0


def test_decisions(spark, kitchen):
    facts = kitchen[0]
    conflicts = spark.createDataFrame([(1, "c1", "f1", "f2", "person:franklin", "BORN_IN", None, "keep_both", None)], "seq long, conflict_id string, fact_a string, fact_b string, subject_id string, predicate string, detected_at timestamp, policy string, winner string")
    asked = spark.createDataFrame([("c1", "f1"), ("c1", "f1"), ("c9", "f1")], "conflict_id string, winner string")
    settled, after, refused = K.decide(conflicts, facts, asked, F.lit("2026-02-01 00:00:00"))
    assert settled.first()["winner"] == "f1" and [r["conflict_id"] for r in refused.collect()] == ["c9"]
    assert {r["fact_id"]: r["status"] for r in after.collect()} == {"f1": "active", "f2": "superseded", "f3": "active", "f4": "active"}
    _, _, wrong = K.decide(conflicts, facts, spark.createDataFrame([("c1", "f4")], "conflict_id string, winner string"), F.lit("2026-02-01 00:00:00"))
    assert wrong.first()["reason"] == "winner is no member"


# Finding and merging


def test_find(spark, kitchen):
    facts = kitchen[0]
    ids = lambda **k: sorted(r["fact_id"] for r in A.find(facts, **k).collect())
    assert ids(predicate="BORN_IN") == ["f1", "f2"] and ids(object_key="int:1706") == ["f3"] and ids(valid_at="1760", predicate="WORKED_AT") == ["f4"]
    assert ids(valid_at="1774", predicate="WORKED_AT") == [] and ids(min_confidence=0.9) == ["f1"] and ids(as_of="2025-01-01T00:00:00Z") == []
    old = facts.withColumns({"status": F.lit("superseded"), "superseded_at": F.lit("2026-01-03 00:00:00").cast("timestamp")})
    assert A.find(old).count() == 0 and A.find(old, include_superseded=True).count() == 4 and A.find(old, as_of="2026-01-02T00:00:00Z").count() == 4 and A.find(old, as_of="2026-01-03T00:00:00Z").count() == 0


def test_merge_and_confidence(spark, kitchen):
    facts, evidence, sources = kitchen
    again = facts.unionByName(facts.withColumns({"seq": F.col("seq") + 100, "recorded_at": F.lit("2027-01-01 00:00:00").cast("timestamp")}))
    merged = A.merge_arrivals(again).collect()
    assert len(merged) == 4 and all(r["arrivals"] == 2 and r["recorded_at"].year == 2026 for r in merged)
    got = {r["fact_id"]: (r["confidence"], r["n_evidence"]) for r in A.combined_confidence(evidence.unionByName(evidence), sources).collect()}
    assert got["f1"][0] == pytest.approx(1 - (1 - 0.95 * 0.9) * (1 - 0.7 * 0.8)) and got["f1"][1] == 2
    assert [r["id"] for r in A.first_seen_sources(facts, evidence, sources).orderBy("first_seq", "first_position").collect()] == ["encyclopedia", "letters", "blog"]


# Exports and serving


def test_exports(spark, kitchen, registry):
    facts, evidence, sources = kitchen
    table = {r["fact_id"]: r for r in X.fact_table(facts).collect()}
    assert table["f1"]["object_entity_id"] == "place:boston" and table["f3"]["object_value"] == "1706" and table["f3"]["object_type"] == "integer" and table["f4"]["valid_from_precision"] == "year"
    assert X.evidence_table(facts, evidence).count() == 5 and X.source_table(sources).count() == 3
    assert [tuple(r) for r in X.qualifier_table(facts).collect()] == [("f4", "role", "Deputy Postmaster General", "string")]
    assert X.graph_edges(facts).count() == 3 and X.graph_statements(facts).count() == 1
    assert {r["id"] for r in X.graph_nodes(facts, registry.where("id <> 'place:boston'")).where("type is null and not provisional").collect()} == {"place:boston"}
    twice = facts.unionByName(facts.where("fact_id = 'f3'").withColumn("seq", F.lit(9).cast("long")))
    assert X.node_properties(twice).first()["value"] == "[1706, 1706]" and X.node_properties(facts).first()["value"] == "1706"
    lines = {r["line"] for r in X.ntriples(facts, registry).collect()}
    assert '<urn:factloom:entity/person%3Afranklin> <urn:factloom:predicate/BIRTH_YEAR> "1706"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines
    odd = spark.createDataFrame([(1, 'a b~*"', 'say "hi"\n\\', None, [], False)], ENTITIES)
    assert X.ntriples(facts.limit(0), odd).first()["line"] == '<urn:factloom:entity/a%20b~%2A%22> <http://www.w3.org/2000/01/rdf-schema#label> "say \\"hi\\"\\n\\\\" .'


def test_graph_modes(spark, kitchen, registry, tmp_path):
    simple, full = X.graph(kitchen[0], registry), X.graph(kitchen[0], registry, "full")
    assert simple.statements is None and simple.properties.count() == 1 and full.properties is None and full.statements.count() == 1
    assert {e["target"] for e in simple.to_dict()["edges"]} == {"place:boston", "place:philadelphia", "org:post-office"}
    facts, evidence, sources = kitchen
    conflicts = K.numbered(K.judged(K.detect(facts, single(spark)), facts, "keep_both"), F.lit("2026-01-02 00:00:00"), "keep_both")
    sizes = {n: t.count() for n, t in X.tables(facts, evidence, sources, registry, conflicts).items()}
    assert sizes == {"entities": 8, "aliases": 1, "sources": 3, "facts": 4, "evidence": 5, "qualifiers": 1, "conflicts": 1}
    simple.write(f"file://{tmp_path}/graph")
    assert spark.read.parquet(f"file://{tmp_path}/graph/edges").count() == 3
    with pytest.raises(ValueError):
        X.graph(kitchen[0], registry, "other")


def test_rendering(spark, kitchen, registry):
    facts, evidence, sources = kitchen
    text = Q.render_text(Q.render_facts(facts, evidence, registry), Q.source_lines(facts, evidence, sources))
    assert text.splitlines() == [
        "- Benjamin Franklin born in Boston (from 1706-01-17; confidence 0.96) [1, 2]",
        "- Benjamin Franklin born in Philadelphia (from 1706-01-17; confidence 0.54) [3]",
        "- Benjamin Franklin birth year 1706 (confidence 0.81) [1]",
        "- Benjamin Franklin worked at Post Office (role: Deputy Postmaster General; from 1753 to 1774; confidence 0.72) [2]",
        "", "Sources:", "[1] Encyclopedia - https://example.org/franklin", "[2] letters", "[3] blog",
    ]
    assert Q.render_text(Q.render_facts(facts.limit(0), evidence, registry), Q.source_lines(facts.limit(0), evidence, sources)) == ""


def test_claim_checks(spark, kitchen, registry):
    facts = kitchen[0]
    rows = [
        (1, "Ben Franklin", "BORN_IN", "name:Boston"), (2, "person:franklin", "BORN_IN", "ref:place:paris-fr"), (3, "person:franklin", "BIRTH_YEAR", "int:1706"),
        (4, "person:franklin", "BIRTH_YEAR", "int:1"), (5, "person:franklin", "WORKED_AT", "ref:org:other"), (6, "Paris", "BORN_IN", "name:Boston"), (7, "nobody", "X", "int:1"),
    ]
    claims = spark.createDataFrame(rows, "claim_id long, subject string, predicate string, object string")
    got = {r["claim_id"]: r["verdict"] for r in Q.check_claims(claims, facts, single(spark), registry).collect()}
    assert got == {1: "disputed", 2: "contradicted", 3: "supported", 4: "contradicted", 5: "unknown", 6: "unknown", 7: "unknown"}
    settled = facts.withColumn("status", F.when(F.col("fact_id") == "f2", "superseded").otherwise(F.col("status")))
    assert {r["claim_id"]: r["verdict"] for r in Q.check_claims(claims, settled, single(spark), registry).collect()}[1] == "supported"


def test_supporting_evidence(spark, kitchen, registry):
    facts, evidence, _ = kitchen
    claims = spark.createDataFrame([(1, "Ben Franklin", "BORN_IN", "name:Boston"), (2, "nobody", "BORN_IN", "name:Boston")], "claim_id long, subject string, predicate string, object string")
    got = Q.supporting_evidence(claims, facts.unionByName(facts), evidence, registry)
    assert sorted((r["claim_id"], r["fact_id"], r["position"]) for r in got.collect()) == [(1, "f1", 0), (1, "f1", 1)]
    assert Q.supporting_evidence(claims, facts, evidence, registry, at="1700").count() == 0


def test_evidence_with_sources(spark, kitchen):
    facts, evidence, sources = kitchen
    got = A.evidence_of(facts.where("fact_id = 'f1'"), evidence, sources.where("id <> 'letters'"))
    assert sorted((r["position"], r["title"]) for r in got.collect()) == [(0, "Encyclopedia"), (1, None)]
    assert {r["fact_id"]: r["source_ids"] for r in A.sources_of(evidence.unionByName(evidence)).collect()}["f1"] == ["encyclopedia", "letters"]


def test_refusals(spark):
    sources = spark.createDataFrame([("", "document", 0.5), (None, "odd", None), ("a", "api", 1.5), ("b", None, 0.0), ("c", "model", 1.0)], "id string, kind string, authority double")
    assert {r["id"]: r["reasons"] for r in H.refused_sources(sources).collect()} == {"": ["empty id"], None: ["empty id", "unknown kind"], "a": ["authority beyond 0 to 1"], "b": ["unknown kind"]}
    evidence = spark.createDataFrame([("f", 0, "c", 0.5), ("f", 1, None, 2.0), ("f", 2, "zz", None)], "fact_id string, position long, source_id string, confidence double")
    assert {r["position"]: r["reasons"] for r in H.refused_evidence(evidence, sources).collect()} == {1: ["no source", "confidence beyond 0 to 1"], 2: ["unknown source"]}


# The store


def test_store_commits_whole_snapshots(spark, kitchen, registry, tmp_path):
    facts, evidence, sources = kitchen
    folder = f"file://{tmp_path}/store"
    store = Store(spark, folder, ontology())
    assert store.table("facts") is None
    store.commit(facts=facts, evidence=evidence, sources=sources)
    with pytest.raises(Exception):
        store.commit(facts=facts.select(F.raise_error(F.lit("no")).alias("predicate"), "subject_id"))
    again = Store(spark, folder)
    assert again.ontology.to_dict() == ontology().to_dict() and again.snapshot == store.snapshot and again.table("facts").count() == 4
    changed = facts.where("fact_id = 'f1'").withColumn("status", F.lit("superseded"))
    again.commit(facts=upsert(again.table("facts"), changed, "fact_id"))
    assert Store(spark, folder).table("facts").where("status = 'superseded'").count() == 1 and Store(spark, folder).table("evidence").count() == 5
    (tmp_path / "store" / "CURRENT").write_text('{"format": "0", "snapshot": "x", "ontology": null}')
    (tmp_path / "store" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        Store(spark, folder)
    with pytest.raises(KeyError):
        again.table("nothing")


def test_mentions_of_nobody_are_contradicted_by_every_value(spark, kitchen, registry):
    facts = kitchen[0]
    rows = [(1, "person:franklin", "BORN_IN", "mention:Boston"), (2, "person:franklin", "BORN_IN", "mention:Atlantis"), (3, "person:franklin", "BORN_IN", "name:" + "x" * 2_000_000), (4, "person:franklin", "WORKED_AT", "mention:Atlantis")]
    claims = spark.createDataFrame(rows, "claim_id long, subject string, predicate string, object string")
    single = spark.createDataFrame([("BORN_IN",)], "predicate string")
    got = {r["claim_id"]: r["verdict"] for r in Q.check_claims(claims, facts, single, registry).collect()}
    assert got == {1: "disputed", 2: "contradicted", 3: "contradicted", 4: "unknown"}


def test_two_places_round_like_the_binary_value(spark):
    values = [0.285, 0.125, 0.375, 2.675, 0.004999, 1.0, 1e-9, 0.995, 1.005, 12345.675, None, float("nan")]
    rng = random.Random(1)
    values += [round(rng.random(), rng.randrange(1, 17)) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(Q.two_places(F.col("v"))).collect()]
    assert got == [None if v is None or v != v else f"{v:.2f}" for v in values]


def test_a_text_for_a_prompt_is_bounded(spark):
    lines = spark.createDataFrame([(i, str(i), f"- {i}") for i in range(5)], "seq long, fact_id string, line string")
    none = spark.createDataFrame([], "number int, line string")
    assert Q.render_text(lines, none).count("\n") == 4
    with pytest.raises(ValueError):
        Q.render_text(lines, none, most=4)


def test_edges_and_statements_name_their_sources(kitchen, registry):
    facts, evidence = kitchen[0], kitchen[1]
    full = X.graph(facts, registry, "full", evidence=evidence)
    cited = {r["fact_id"]: r["source_ids"] for r in A.sources_of(evidence).collect()}
    rows = full.edges.select("id", "source_ids").unionByName(full.statements.select("id", "source_ids")).collect()
    assert len(rows) == 4 and all(r["source_ids"] == cited[r["id"]] for r in rows) and max(len(r["source_ids"]) for r in rows) == 2
    assert all(r["source_ids"] == [] for r in X.graph_edges(facts).collect())


def test_a_registry_writes_through_to_its_backend(spark, tmp_path, registry):
    from factloom.factbase import FactBase
    from factloom.sources.backend import Backend, MemoryStore, Registry
    from factloom.sources.store import Store

    with pytest.raises(TypeError):
        Backend()
    for backend in (MemoryStore(spark), Store(spark, f"file://{tmp_path}/s")):
        one = Registry(backend)
        assert len(one) == 0 and "person:franklin" not in one
        assert one.add(registry).count() == 0 and one.add(registry.limit(1)).count() == 1
        one.add_aliases(spark.createDataFrame([("person:franklin", "Dr Franklin")], "id string, alias string"))
        again = Registry(backend)
        assert len(again) == registry.count() and "person:franklin" in again and "Dr Franklin" in again.get("person:franklin").first()["aliases"]
        assert again.provisional().count() == 1 and FactBase.load(backend).entities.count() == len(again)
        with pytest.raises(KeyError):
            backend.table("other")
        with pytest.raises(KeyError):
            backend.commit(other=registry)
