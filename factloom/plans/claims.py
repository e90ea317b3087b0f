"""Claims made from the relational tables and from documents: the flagship query, extraction and ingestion."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions.terms import claim_id, key, ref
from factloom.operators import conflicts as K
from factloom.operators import extract as E
from factloom.operators import pipeline as P
from factloom.operators.phrases import MONTHS
from factloom.plans.store import entities_of, ontology_of, steady
from factloom.sources.tables import table

PATTERNS = [
    E.Pattern("BORN_IN", "{subject} was born in {object} in {valid_from}", "Person", "Place", 0.8),
    E.Pattern("BORN_IN", "{subject} was born in {object}", "Person", "Place"),
    E.Pattern("WORKED_AT", "From {valid_from:year} to {valid_to:year} {subject} served as {role:text} at the {object}", "Person", "Organization", 0.8),
    E.Pattern("POPULATION", "{subject} had a population of {object:int} in {valid_from:year}", "Place", None, 0.9),
    E.Pattern("FOUNDED_IN", "{subject} was founded in {object} in {valid_from:year}", "Organization", "Place", 0.8),
]


def stocked_by(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as evidence that a part is stocked by a supplier: one fact per claim, its confidence and verdict."""
    items = table(spark, folder, "lineitem")
    authority = F.when(F.col("l_returnflag") == "R", 0.4).when(F.col("l_returnflag") == "A", 0.7)
    weight = C.weighted(F.col("l_quantity") / 50 * 0.2, authority)
    merged = items.groupBy("l_partkey", "l_suppkey").agg(C.noisy_or(weight).alias("confidence"), F.count(F.lit(1)).alias("n_evidence"))
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))
    none = F.lit(None).cast("string")
    qualifiers = F.expr("CAST(NULL AS MAP<STRING, STRUCT<kind: STRING, text: STRING, hint: STRING>>)")
    return merged.select(
        claim_id(key(ref(part)), F.lit("STOCKED_BY"), key(ref(supplier)), none, none, qualifiers).alias("fact_id"),
        part.alias("subject_id"), F.concat(F.lit("ref:"), supplier).alias("object_key"), "n_evidence", steady(F.col("confidence")).alias("confidence"),
        F.when(F.col("confidence") < 0.2, "rejected").when(F.col("confidence") < 0.5, "needs_review").otherwise("accepted").alias("status"),
    )


def supply_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as claims that one supplier alone supplies a part for 90 days from a shipping date: claims that contradict."""
    day = F.to_date("l_shipdate")
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    claims = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey", day.alias("day")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    facts = claims.select(
        "seq", F.concat_ws("/", "l_partkey", "l_suppkey", text(F.col("day"))).alias("fact_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("subject_id"),
        F.lit("SUPPLIED_BY").alias("predicate"), F.concat(F.lit("ref:supplier:"), F.col("l_suppkey").cast("string")).alias("object_key"),
        text(F.col("day")).alias("valid_from"), text(F.date_add("day", 90)).alias("valid_to"), F.lit("active").alias("status"),
    )
    return K.detect_claims(facts, None).select("fact_a", "fact_b", "subject_id")  # here a claim is one fact


def extracted_claims(spark: SparkSession, folder: str) -> DataFrame:
    found = E.extract(table(spark, folder, "documents"), PATTERNS)
    return found.select(
        "doc_id", F.col("subject.text").alias("subject"), "predicate", F.col("object.kind").alias("object_kind"), F.col("object.text").alias("object"),
        "valid_from", "valid_to", "locator", "quote", "confidence", "error",
    )


def _every_sentence(prompt: str) -> str:
    """A stand-in for a language model: of every sentence of the text it claims that its first two words begin what its last word ends."""
    sentences = [s.strip() for s in prompt.rpartition("Text:\n")[2].split(".") if s.strip()]
    claims = [{"subject": " ".join(s.split()[:2]), "predicate": "begins", "object": s.split()[-1], "quote": s} for s in sentences]
    return "Here you are:\n```json\n" + json.dumps({"claims": claims}) + "\n```"


def model_claims(spark: SparkSession, folder: str) -> DataFrame:
    found = E.extract_with_model(table(spark, folder, "documents"), _every_sentence, max_chars=4000)
    return found.select("doc_id", "chunk_offset", "kind", F.col("subject.text").alias("subject"), "predicate", F.col("object.text").alias("object"), "locator", "confidence", "reason")


def ingested_facts(spark: SparkSession, folder: str) -> DataFrame:
    done = P.ingest(
        table(spark, folder, "documents").select("doc_id", "text", "source"), [lambda d: E.extract(d, PATTERNS)], table(spark, folder, "sources"),
        entities_of(spark, folder), ontology_of(spark, folder), F.lit("2026-01-01T00:00:00Z"), accept_at=0.3,
    )
    return done.facts.select("fact_id", "subject_id", "predicate", "object_key", "valid_from", "valid_to", F.round("confidence", 6).alias("confidence"))


WORDS = [
    E.Pattern("BORN_IN", "{subject:word} was born in {object:word} in {valid_from:year}", "Person", "Place", 0.8),
    E.Pattern("BORN_IN", "{subject:word} was born in {object:word}", "Person", "Place"),
    E.Pattern("POPULATION", "{subject:word} had a population of {object:int} in {valid_from:year}", "Place", None, 0.9),
]


def template_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Templates with kinds; the specific one comes before the general one of its predicate."""
    found = E.extract(table(spark, folder, "documents"), WORDS).where("error is null")
    return found.select(
        "doc_id", F.col("subject.text").alias("subject"), "predicate", F.col("object.kind").alias("object_kind"), F.col("object.text").alias("object"), "valid_from", "quote", "confidence"
    )


_MONTHS = "|".join(m.capitalize() for m in MONTHS)
RAW = [
    E.Pattern("BORN_IN", "(?P<subject>[A-Z][a-z]+ [A-Z][a-z]+) was born in (?P<object>[A-Z][a-z]+)", regex=True),
    E.Pattern("DATED", f"(?P<subject>[A-Z][a-z]+) on (?P<object>(?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})", regex=True, convert={"object": E.iso_date}),
]


def raw_pattern_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of two expressions of one's own, one of them with a converter."""
    found = E.extract(table(spark, folder, "documents"), RAW)
    return found.select("doc_id", F.col("subject.text").alias("subject"), "predicate", F.col("object.text").alias("object"), "quote")


def _first_words(prompt: str) -> str:
    """A stand-in for a language model: the first word of a text begins with the second; without two words there is no claim."""
    words = re.findall(r"[^ \n\t]+", prompt.rpartition("Text:\n")[2])
    if len(words) < 2:
        return "Nothing is claimed."
    claim = {"subject": words[0], "predicate": "begins with", "object": words[1], "quote": f" {words[0]}   {words[1]}", "confidence": 0.75}
    return f"Sure:\n```json\n{json.dumps({'claims': [claim]})}\n```"


def whole_text_claims(spark: SparkSession, folder: str) -> DataFrame:
    """A model is asked about each text as a whole."""
    found = E.extract_with_model(table(spark, folder, "documents"), _first_words, max_chars=None).where("kind = 'claim'")
    return found.select("doc_id", F.col("subject.text").alias("subject"), "predicate", F.col("object.text").alias("object"), "locator", "quote", "confidence")


QUERIES = {"template_claims": template_claims, "raw_pattern_claims": raw_pattern_claims, "whole_text_claims": whole_text_claims, "stocked_by": stocked_by, "supply_conflicts": supply_conflicts, "extracted_claims": extracted_claims, "model_claims": model_claims, "ingested_facts": ingested_facts}

# the word kind in the letters of SQL; where a run of such letters begins and ends no other letter of a word stands
_SQL_WORD = r"([\p{L}\p{N}_''’-]+)"
_SQL_BORN = rf"{_SQL_WORD}\s+(?i:was\s+born\s+in)\s+{_SQL_WORD}(?:\s+(?i:in)\s+(\d{{4}})\b)?"
_SQL_SIZE = rf"{_SQL_WORD}\s+(?i:had\s+a\s+population\s+of)\s+(-?\d[\d,]*)\s+(?i:in)\s+(\d{{4}})\b"
_RAW_BORN, _RAW_DATED = (p.template.replace("?P<subject>", "").replace("?P<object>", "") for p in RAW)
SQL = {
    "raw_pattern_claims": f"""
with b as (select doc_id, unnest(regexp_extract_all(text, '{_RAW_BORN}', 0)) as quote, unnest(regexp_extract_all(text, '{_RAW_BORN}', 1)) as subject,
    unnest(regexp_extract_all(text, '{_RAW_BORN}', 2)) as object from documents),
d as (select doc_id, unnest(regexp_extract_all(text, '{_RAW_DATED}', 0)) as quote, unnest(regexp_extract_all(text, '{_RAW_DATED}', 1)) as subject,
    unnest(regexp_extract_all(text, '{_RAW_DATED}', 2)) as object from documents)
select doc_id, subject, 'BORN_IN' as predicate, object, quote from b
union all select doc_id, subject, 'DATED', strftime(strptime(object, '%B %d, %Y'), '%Y-%m-%d'), quote from d""",
    "whole_text_claims": r"""
with t as (select doc_id, text, regexp_extract(text, '[^ \n\t]+[ \n\t]+[^ \n\t]+') as quote, length(regexp_extract(text, '^[ \n\t]*')) as start from documents)
select doc_id, regexp_extract(quote, '^[^ \n\t]+') as subject, 'BEGINS_WITH' as predicate, regexp_extract(quote, '[^ \n\t]+$') as object,
  'chars ' || start || '-' || (start + length(quote)) as locator, quote, 0.75::double as confidence from t where quote <> ''""",
    "template_claims": rf"""
with b as (select doc_id, unnest(regexp_extract_all(text, '{_SQL_BORN}', 0)) as quote, unnest(regexp_extract_all(text, '{_SQL_BORN}', 1)) as subject,
    unnest(regexp_extract_all(text, '{_SQL_BORN}', 2)) as object, unnest(regexp_extract_all(text, '{_SQL_BORN}', 3)) as year from documents),
p as (select doc_id, unnest(regexp_extract_all(text, '{_SQL_SIZE}', 0)) as quote, unnest(regexp_extract_all(text, '{_SQL_SIZE}', 1)) as subject,
    unnest(regexp_extract_all(text, '{_SQL_SIZE}', 2)) as object, unnest(regexp_extract_all(text, '{_SQL_SIZE}', 3)) as year from documents)
select doc_id, subject, 'BORN_IN' as predicate, 'mention' as object_kind, object, nullif(year, '') as valid_from, quote, case when coalesce(year, '') = '' then 0.7 else 0.8 end::double as confidence from b
union all select doc_id, subject, 'POPULATION', 'integer', replace(object, ',', ''), year, quote, 0.9 from p""",
    "supply_conflicts": """
with c as (select l_partkey as p, l_suppkey as s, cast(l_shipdate as date) as d, min(l_orderkey * 10 + l_linenumber) as seq,
    l_partkey || '/' || l_suppkey || '/' || cast(l_shipdate as date) as id from lineitem group by all)
select a.id as fact_a, b.id as fact_b, 'part:' || a.p as subject_id
from c a join c b on a.p = b.p and (a.seq < b.seq or a.seq = b.seq and a.id < b.id) and a.s <> b.s and a.d < b.d + 90 and b.d < a.d + 90""",
    "stocked_by": """
with m as (select l_partkey, l_suppkey, count(*) as n,
    1 - product(1 - l_quantity / 50 * 0.2 * case l_returnflag when 'R' then 0.4 when 'A' then 0.7 else 1.0 end) as c from lineitem group by 1, 2)
select 'fact:' || substr(sha256('ref:part:' || l_partkey || chr(31) || 'STOCKED_BY' || chr(31) || 'ref:supplier:' || l_suppkey || chr(31) || 'none' || chr(31) || 'none' || chr(31)), 1, 16) as fact_id,
  'part:' || l_partkey as subject_id, 'ref:supplier:' || l_suppkey as object_key, n as n_evidence, floor(c * 1e6 + 0.4937) / 1e6 as confidence,
  case when c < 0.2 then 'rejected' when c < 0.5 then 'needs_review' else 'accepted' end as status from m""",
}
