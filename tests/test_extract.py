import json
import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom import factbase as FB
from factloom.operators import extract as E
from factloom.operators import pipeline as P
from factloom.operators.ontology import EntityType, Ontology, Predicate

BIO = (
    "Benjamin Franklin was born in Boston on January 17, 1706. In 1723 Franklin moved to Philadelphia. "
    "Franklin served as Deputy Postmaster General at the Post Office from 1753 to 1774. He was born in Boston, according to the letters."
)
BORN = [E.Pattern("BORN_IN", "{subject} was born in {object} on {valid_from}", "Person", "Place"), E.Pattern("BORN_IN", "{subject} was born in {object}", "Person", "Place")]


def one(text, *patterns):
    return E.matches(text, patterns)


def test_born_in_with_date_wins_over_the_plain_pattern():
    (c,) = one(BIO, *BORN)
    assert c["locator"] == "chars 0-56" and c["valid_from"] == "1706-01-17" and c["confidence"] == 0.7 and c["quote"] == BIO[:56]
    assert c["subject"] == {"kind": "mention", "text": "Benjamin Franklin", "hint": "Person"} and c["object"]["text"] == "Boston"


def test_templates_names_and_qualifiers():
    (c,) = one("J. R. de Silva was born in Rio de Janeiro.", BORN[1])
    assert (c["subject"]["text"], c["object"]["text"]) == ("J. R. de Silva", "Rio de Janeiro")
    (c,) = one("Ada Lovelace WAS\n  born IN London", BORN[1])
    assert c["object"]["text"] == "London"
    worked = E.Pattern("WORKED_AT", "{subject} served as {role} at the {object} from {valid_from} to {valid_to}")
    (c,) = one(BIO, worked)
    assert c["qualifiers"]["role"]["text"] == "Deputy Postmaster General" and (c["valid_from"], c["valid_to"]) == ("1753", "1774")
    (c,) = one("Boston had a population of 16,382 in 1765.", E.Pattern("POPULATION", "{subject} had a population of {object:int} in {valid_from:year}"))
    assert c["object"] == {"kind": "integer", "text": "16382", "hint": None}
    (c,) = one("Franklin was 84 years old.", E.Pattern("AGE", r"(?P<subject>\w+) was (?P<object>\d+) years", regex=True, convert={"object": int}))
    assert c["object"]["text"] == "84"
    (c,) = one("Ada was born in London on February 30, 1800", E.Pattern("B", "{subject} was born in {object} on {valid_from}", convert={"valid_from": lambda s: date.fromisoformat(E.iso_date(s)).isoformat()}))
    assert c["error"]


def test_names_do_not_start_with_pronouns():
    assert one("He was born in Boston.", BORN[1]) == []
    (c,) = one("The University of Pennsylvania was born in Philadelphia", BORN[1])
    assert c["subject"]["text"] == "University of Pennsylvania"


@pytest.mark.parametrize(("template", "fault"), [
    ("{object} is large", "no {subject}"), ("{subject} {object} {object}", "more than once"), ("{subject} meets {object:animal}", "kind 'animal'"), ("plain words", "no {object}"),
])
def test_templates_with_faults(template, fault):
    with pytest.raises(ValueError, match=fault):
        E.Pattern("P", template)


@pytest.mark.parametrize("kwargs", [{"predicate": ""}, {"confidence": -0.1}, {"template": "(?P<object>b)", "regex": True}])
def test_patterns_with_faults(kwargs):
    with pytest.raises(ValueError):
        E.Pattern(**{"predicate": "P", "template": "{subject} likes {object}"} | kwargs)


def test_templates_are_read_as_tokens():
    t = E.Template("In {year:year}, {subject} met {object}.")
    assert t.words == ["In", ",", "met", "."] and t.holes == {"year": "year", "subject": "name", "object": "name"}
    (c,) = one("we say: in 1801,  Ada Byron MET\nCharles Babbage. Fine", E.Pattern("MET", t.text))
    assert c["qualifiers"]["year"]["text"] == "1801" and c["object"]["text"] == "Charles Babbage" and c["quote"].startswith("in 1801")


@pytest.mark.parametrize(("text", "iso"), [
    ("2 Feb. 1801", "1801-02-02"), ("December 25th, 1999", "1999-12-25"), ("3rd of", None), ("aug 1914", "1914-08"), ("sept. 30 1066", "1066-09-30"), ("1st June 1850", "1850-06-01"),
    ("0999", "0999"), ("2020-11", "2020-11"), (" 2020-11-05 ", "2020-11-05"), ("ma 1900", None), ("12 12 1900", None), ("May", None), ("1900 May", None), ("", None),
])
def test_dates(text, iso):
    if iso is None:
        with pytest.raises(ValueError):
            E.iso_date(text)
    else:
        assert E.iso_date(text) == iso


def test_overlaps_are_told_from_touching_spans():
    from factloom.operators.phrases import Spans

    rng, spans, kept = random.Random(4), Spans(), []
    for _ in range(2_000):
        s = rng.randrange(500)
        e = s + rng.randrange(1, 6)
        assert spans.take(s, e) == (free := not any(s < b and a < e for a, b in kept))
        kept += [(s, e)] * free


def test_the_filter_knows_unusual_cases(spark):
    texts = ["Ada waſ born in Kent.", "Ada was born in Kent.", "Ada was borne in Kent", "ADA WAS BORN İN KENT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    passed = {r["doc_id"] for r in df.where(E.may_match(F.col("text"), BORN)).collect()}
    assert passed >= {i for i, t in enumerate(texts) if one(t, *BORN)} and 0 in passed and {r["doc_id"] for r in E.extract(df, BORN).collect()} == {i for i, t in enumerate(texts) if one(t, *BORN)}


def test_splitting():
    assert E.split_text("abcdefgh", 3) == [(0, "abc"), (3, "def"), (6, "gh")]
    text = "First paragraph here.\n\nSecond one is long. And more words."
    parts = E.split_text(text, 40)
    assert parts[0] == (0, "First paragraph here.\n\n") and "".join(t for _, t in parts) == text and all(len(t) <= 40 for _, t in parts)
    assert E.split_text("  \n ", 2) == [] and E.split_text("", 5) == [] and E.split_text(text, None) == [(0, text)]
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("ab. \n!") for _ in range(rng.randrange(60)))
        pieces = E.split_text(t, 9)
        assert all(len(p) <= 9 and t[o : o + len(p)] == p and p.strip() for o, p in pieces)
        covered = {i for o, p in pieces for i in range(o, o + len(p))}
        assert all(t[i].isspace() for i in range(len(t)) if i not in covered)
    assert E.split_text("aa. bb\n \ncc dd", 13) == [(0, "aa. bb\n \n"), (9, "cc dd")] and E.split_text("aa. bb cc", 8) == [(0, "aa. "), (4, "bb cc")]
    with pytest.raises(ValueError):
        E.split_text("a", 0)


def test_replies():
    c = {"subject": "a", "predicate": "p", "object": "o"}
    for reply in (json.dumps({"claims": [c]}), json.dumps([c]), json.dumps(c), f"```json\n{json.dumps([c])}\n```", f"Sure! {json.dumps([c])} done", f"see {{x}} ```\n{json.dumps({'claims': [c]})}```"):
        assert E.parse_claims(reply) == [c]
    with pytest.raises(E.UnreadableReply) as e:
        E.parse_claims("No claims, sorry.")
    assert e.value.response == "No claims, sorry."


def schema():
    o = Ontology()
    o.add_type(EntityType("Person"))
    o.add_type(EntityType("Place"))
    o.add_predicate(Predicate("BORN_IN", ("Person",), "Place", "one", "moment"))
    o.add_predicate(Predicate("BIRTH_YEAR", ("Person",), "integer", "one"))
    o.add_predicate(Predicate("ALIVE", ("Person",), "boolean"))
    return o


GOOD = {"subject": "Franklin", "predicate": "born in", "object": "Boston", "quote": "Franklin was born"}


@pytest.mark.parametrize(("change", "reason"), [
    ("text", "claim.not_an_object"), ({"subject": " "}, "subject.missing"), ({"predicate": "!"}, "predicate.missing"), ({"object": None}, "object.missing"),
    ({"object": []}, "object.not_single"), ({"predicate": "BIRTH_YEAR", "object": "x"}, "object.not_integer"), ({"object": "maybe", "object_type": "boolean"}, "object.not_boolean"),
    ({"quote": "not there"}, "quote.not_in_text"), ({"quote": None}, "quote.missing"), ({"qualifiers": [1]}, "qualifiers.not_an_object"), ({"valid_from": "soon"}, "valid_from.not_a_time"),
    ({"valid_to": True}, "valid_to.not_a_time"), ({"subject": "", "object": None}, "subject.missing"),
])
def test_skips(change, reason):
    item = change if isinstance(change, str) else GOOD | change
    with pytest.raises(E.Skip) as e:
        E.Reader(E.Chunk("Franklin   was BORN there", 10), schema()).read(item)
    assert str(e.value) == reason


def test_good_claims():
    c = E.Reader(E.Chunk("So Franklin   was\nBORN there", 10), schema()).read(GOOD | {"confidence": True, "subject_type": "Person", "valid_from": 1706})
    assert c["predicate"] == "BORN_IN" and c["object"] == {"kind": "mention", "text": "Boston", "hint": "Place"} and c["confidence"] == 0.6 and c["valid_from"] == "1706"
    assert c["locator"] == "chars 13-32" and c["quote"] == "Franklin   was\nBORN"
    c = E.Reader(E.Chunk(""), schema(), require_quote=False).read(GOOD | {"predicate": "BIRTH_YEAR", "object": "1,706", "confidence": 0.9})
    assert c["object"]["text"] == "1706" and c["object"]["kind"] == "integer" and c["confidence"] == 0.9 and c["quote"] is None


def test_prompt():
    text = E.build_prompt("Some text.", schema(), "Be brief.")
    assert "BORN_IN: Person -> Place; one value at a time; a moment" in text and "Be brief." in text and text.rstrip().endswith("Some text.")
    assert "UPPER_SNAKE_CASE" in E.build_prompt("x")


def test_extraction_over_documents(spark):
    rows = [(1, BIO, "bio"), (2, None, "bio"), (3, "", "bio"), (4, "Ada Lovelace was born in London. " * 3000, "x"), (5, "nothing here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = E.extract(docs, BORN).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 1, 4: 3000}
    assert E.extract(docs.limit(0), BORN).count() == 0


def test_model_extraction_isolates_bad_replies(spark):
    docs = spark.createDataFrame([(1, "Ada was born in London."), (2, "bad"), (3, None)], "doc_id long, text string")

    def complete(prompt):
        body = prompt.rpartition("Text:\n")[2].strip()
        return "no" if body == "bad" else json.dumps([{"subject": "Ada", "predicate": "born in", "object": "London", "quote": "Ada was born"}, {"subject": ""}])

    got = E.extract_with_model(docs, complete).select("doc_id", "kind", "reason").collect()
    assert {r["reason"] for r in got} == {None, "subject.missing", "reply.unreadable"}
    assert sorted((r["doc_id"], r["kind"]) for r in got) == [(1, "claim"), (1, "response"), (1, "skipped"), (2, "response"), (2, "skipped")]


def test_bare_triples(spark):
    docs = spark.createDataFrame([(1, BIO)], "doc_id long, text string")
    triples = E.bare_triples(E.extract(docs, BORN))
    assert [tuple(r) for r in triples.collect()] == [("Benjamin Franklin", "BORN_IN", "Boston")]
    (claim,) = E.from_triples(triples, F.array(F.struct(F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("authority"))), F.lit(1)).collect()
    assert claim["subject"]["text"] == "Benjamin Franklin" and claim["object"]["kind"] == "string" and claim["evidence"][0]["confidence"] == 0.5


def test_ingestion_end_to_end(spark):
    docs = spark.createDataFrame([(1, BIO, "bio"), (2, "Ben Franklin was born in Boston on January 17, 1706.", "letters"), (3, "Ben Franklin was born in Philadelphia on January 17, 1706.", "blog")], "doc_id long, text string, source string")
    sources = spark.createDataFrame([("bio", 0.9), ("letters", None), ("blog", 0.95)], "id string, authority double")
    entities = spark.createDataFrame([(1, "person:franklin", "Benjamin Franklin", "Person", ["Ben Franklin"], False)], "seq long, id string, label string, type string, aliases array<string>, provisional boolean")
    done = P.ingest(docs, [lambda d: E.extract(d, BORN)], sources, entities, schema(), F.lit("2026-01-01T00:00:00Z"))
    facts = {r["object_key"]: r for r in done.facts.collect()}
    assert set(facts) == {"ref:place:boston", "ref:place:philadelphia"} and facts["ref:place:boston"]["confidence"] == pytest.approx(1 - (1 - 0.63) * (1 - 0.7))
    assert done.results.where("status = 'accepted'").count() == 3 and done.evidence.count() == 3 and done.entities.where("provisional").count() == 2
    (conflict,) = done.conflicts.collect()
    assert conflict["conflict_id"] == "conflict:1" and {conflict["fact_a"], conflict["fact_b"]} == {r["fact_id"] for r in facts.values()}


def test_ingestion_into_a_store_with_a_policy(spark):
    """Two extractors, one of them a model, documents with keys of text, and more claims in a document than any fixed step between numbers."""
    born = "Ada Lovelace was born in London. "
    docs = spark.createDataFrame([("b", born * 3, "blog"), ("a", "Ada Lovelace was born in Leeds.", "letters"), ("c", None, "blog")], "doc_id string, text string, source string")
    sources = spark.createDataFrame([("letters", "document", None, None, None, 0.9), ("blog", "document", None, None, None, 0.3)], FB.SOURCES)

    def complete(prompt):
        return json.dumps([{"subject": "Ada Lovelace", "subject_type": "Person", "predicate": "birth year", "object": "1815", "quote": "ada lovelace was"}, {"subject": ""}])

    extractors = [lambda d: E.extract(d, BORN), lambda d: E.extract_with_model(d, complete, schema(), max_chars=34)]
    base = replace(FB.FactBase.empty(spark, schema(), "highest_authority"), sources=sources)
    base, results = base.ingest(docs, extractors, F.lit("2026-01-01T00:00:00Z"), accept_at=0.1, reject_below=0.05)
    rows = results.select("seq", "doc_id", "predicate", "status").orderBy("seq").collect()
    assert [(r["doc_id"], r["predicate"]) for r in rows] == [("a", "BORN_IN"), ("a", "BIRTH_YEAR"), *[("b", "BORN_IN")] * 3, *[("b", "BIRTH_YEAR")] * 3]
    facts = {r["object_key"]: r["status"] for r in base.facts.collect()}
    assert facts == {"ref:place:leeds": "active", "ref:place:london": "superseded", "int:1815": "active"}
    (conflict,) = base.conflicts.collect()
    assert conflict["policy"] == "highest_authority" and conflict["winner"] == base.find(object_key="ref:place:leeds").first()["fact_id"]
    again, _ = base.ingest(docs, extractors, F.lit("2026-02-01T00:00:00Z"), accept_at=0.1, reject_below=0.05)
    assert again.facts.count() == 3 and again.conflicts.count() == 1 and again.evidence.count() == base.evidence.count() * 2
    one = P.ingest(docs, extractors, sources, FB.FactBase.empty(spark).entities, schema(), F.lit("2026-01-01T00:00:00Z"), policy="highest_authority", accept_at=0.1, reject_below=0.05)
    assert {r["object_key"]: r["status"] for r in one.facts.collect()} == facts and one.conflicts.count() == 1
