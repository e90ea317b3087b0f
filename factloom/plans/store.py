"""Queries on the tables of the store: scans, filters, merging, validation, conflicts, exports, serving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions.temporal import earliest_second, is_naive, precision, written
from factloom.functions.terms import decode, key, ref
from factloom.operators import checks as H
from factloom.operators import conflicts as K
from factloom.operators import export as X
from factloom.operators import facts as A
from factloom.operators import resolve as R
from factloom.operators import serve as Q
from factloom.operators import validate as V
from factloom.operators.ontology import Ontology
from factloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def entities_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").withColumn("aliases", R.aliases_of(F.col("aliases_json")))


def ontology_of(spark: SparkSession, folder: str) -> Ontology:
    return Ontology.from_tables(table(spark, folder, "predicates"), table(spark, folder, "entity_types"))


def single_valued(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predicates").where("cardinality = 'one'").select(F.col("name").alias("predicate"))


def steady(c: Column) -> Column:
    """Six decimals, cut where no product of two-place decimals ends, so that the order of multiplication cannot show."""
    return F.floor(c * 1e6 + 0.4937) / 1e6


# Building blocks of the SQL
INSTANT = r"""case
  when regexp_full_match(trim({c}), '[0-9]{{4}}') then epoch(try_cast(trim({c}) || '-01-01' as timestamp))
  when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}') then epoch(try_cast(trim({c}) || '-01' as timestamp))
  when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then epoch(try_cast(trim({c}) as timestamp))
  when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})')
    then epoch(try_cast(substr(trim({c}), 1, 19) as timestamp)) - case when substr(trim({c}), 20) = 'Z' then 0
      else (case when substr(trim({c}), 20, 1) = '-' then -1 else 1 end) * (cast(substr(trim({c}), 21, 2) as int) * 3600 + cast(substr(trim({c}), 24, 2) as int) * 60) end
  end"""
PRECISION = r"""case when regexp_full_match(trim({c}), '[0-9]{{4}}') then 'year' when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}') then 'month'
  when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'day'
  when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') then 'instant' end"""
NAIVE = r"regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?')"
ISO = "strftime({c} at time zone 'UTC', '%Y-%m-%dT%H:%M:%S+00:00')"
ALIASES = "case when json_valid(aliases_json) then from_json(aliases_json, '[\"VARCHAR\"]') else [] end"
REF = "json_extract_string(object_json, '$.\"$ref\"')"


# Times


@query(f"""
select seq, {PRECISION.format(c="valid_from")} as shape, cast({INSTANT.format(c="valid_from")} as bigint) as second,
  coalesce({NAIVE.format(c="valid_from")}, false) as naive from facts""")
def times(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("valid_from")
    return table(spark, folder, "facts").select("seq", precision(t).alias("shape"), earliest_second(t).alias("second"), F.coalesce(is_naive(t), F.lit(False)).alias("naive"))


# Finding facts


@query("select seq, fact_id, subject_id, predicate, object_key, status from facts order by seq")
def all_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").orderBy("seq").select("seq", "fact_id", "subject_id", "predicate", "object_key", "status")


@query("select seq, fact_id, subject_id, object_key from facts where predicate = 'BORN_IN' and status = 'active'")
def find_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return A.find(table(spark, folder, "facts"), predicate="BORN_IN").select("seq", "fact_id", "subject_id", "object_key")


@query("""select seq, fact_id, status from facts
where recorded_at <= timestamptz '2024-03-01 00:00:00+00' and (superseded_at is null or superseded_at > timestamptz '2024-03-01 00:00:00+00')""")
def find_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return A.find(table(spark, folder, "facts"), as_of="2024-03-01T00:00:00Z").select("seq", "fact_id", "status")


@query(f"""with b as (select seq, fact_id, status, {INSTANT.format(c="valid_from")} as s, {INSTANT.format(c="valid_to")} as e from facts)
select seq, fact_id from b where status = 'active' and (s is null or s <= epoch(timestamp '1850-06-01')) and (e is null or e > epoch(timestamp '1850-06-01'))""")
def find_valid_at(spark: SparkSession, folder: str) -> DataFrame:
    return A.find(table(spark, folder, "facts"), valid_at="1850-06").select("seq", "fact_id")


@query("select seq, fact_id, confidence from facts where confidence >= 0.8")
def find_confident(spark: SparkSession, folder: str) -> DataFrame:
    return A.find(table(spark, folder, "facts"), min_confidence=0.8, include_superseded=True).select("seq", "fact_id", "confidence")


@query("select conflict_id, fact_a, fact_b from conflicts where winner is null")
def open_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conflicts").where("winner is null").select("conflict_id", "fact_a", "fact_b")


@query("select id, label from entities where provisional")
def provisional_entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").where("provisional").select("id", "label")


# Merging and confidence


@query("""select fact_id, arg_min(subject_id, seq) filter (true) as subject_id, arg_min(recorded_at, seq) as recorded_at, min(seq) as seq, count(*) as arrivals from (
  select seq, fact_id, coalesce(subject_id, '') as subject_id, strftime(recorded_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') as recorded_at from facts) group by 1""")
def merged_facts(spark: SparkSession, folder: str) -> DataFrame:
    merged = A.merge_arrivals(table(spark, folder, "facts"))
    return merged.select("fact_id", F.coalesce("subject_id", F.lit("")).alias("subject_id"), X._iso(F.col("recorded_at")).alias("recorded_at"), "seq", "arrivals")


@query("""with e as (select distinct fact_id, source_id, locator, quote, confidence, extractor, extracted_at from evidence)
select fact_id, floor((1 - product(1 - e.confidence * coalesce(authority, 1.0))) * 1e6 + 0.4937) / 1e6 as confidence, count(*) as n_evidence
from e left join sources on sources.id = source_id group by 1""")
def fact_confidence(spark: SparkSession, folder: str) -> DataFrame:
    out = A.combined_confidence(table(spark, folder, "evidence"), table(spark, folder, "sources"))
    return out.withColumn("confidence", steady(F.col("confidence")))


@query("""with o as (select fact_id, min(seq) as seq from facts group by 1), c as (select source_id, seq, min(position) as position from evidence join o using (fact_id) where source_id is not null group by 1, 2),
r as (select *, row_number() over (partition by source_id order by seq, position) as n from c)
select id, kind, title, seq as first_seq, position as first_position from r join sources on sources.id = source_id where n = 1""")
def cited_sources(spark: SparkSession, folder: str) -> DataFrame:
    out = A.first_seen_sources(table(spark, folder, "facts"), table(spark, folder, "evidence"), table(spark, folder, "sources"))
    return out.select("id", "kind", "title", "first_seq", "first_position")


@query("""with o as (select fact_id, min(seq) as seq from facts group by 1), c as (select source_id, seq, position from evidence join o using (fact_id) where source_id is not null),
f as (select source_id, min((seq, position)) as seen from c group by 1)
select source_id, cast(row_number() over (order by seen, source_id) as int) as number from f""")
def citation_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return Q.citations(table(spark, folder, "facts"), table(spark, folder, "evidence"))


@query("""select e.fact_id, position, source_id, kind, title, authority from evidence e left join sources on sources.id = source_id
where fact_id in (select fact_id from facts where predicate = 'BORN_IN' and status = 'active')""")
def born_in_evidence(spark: SparkSession, folder: str) -> DataFrame:
    facts = A.find(table(spark, folder, "facts"), predicate="BORN_IN")
    out = A.evidence_of(facts, table(spark, folder, "evidence"), table(spark, folder, "sources"))
    return out.select("fact_id", "position", "source_id", "kind", "title", "authority")


@query("""select fact_id, string_agg(source_id, '|' order by position, source_id) as source_ids
from (select fact_id, source_id, min(position) as position from evidence where source_id is not null group by 1, 2) group by 1""")
def fact_sources(spark: SparkSession, folder: str) -> DataFrame:
    return A.sources_of(table(spark, folder, "evidence")).withColumn("source_ids", F.array_join("source_ids", "|"))


@query("""select fact_id, max(f.confidence) as confidence, max(authority) as authority, cast(epoch_us(max(extracted_at)) as double) as latest
from (select fact_id, max(confidence) as confidence from facts group by 1) f left join evidence using (fact_id) left join sources on sources.id = source_id group by 1""")
def fact_scores(spark: SparkSession, folder: str) -> DataFrame:
    return K.scores(table(spark, folder, "facts"), table(spark, folder, "evidence"), table(spark, folder, "sources"))


@query("""select id, array_to_string(list_filter([case when id = '' or id is null then 'empty id' end, case when kind not in ('document', 'api', 'human', 'model') or kind is null then 'unknown kind' end,
  case when authority not between 0 and 1 then 'authority beyond 0 to 1' end], lambda x: x is not null), '|') as reasons from sources
where id = '' or id is null or kind not in ('document', 'api', 'human', 'model') or kind is null or authority not between 0 and 1""")
def refused_sources(spark: SparkSession, folder: str) -> DataFrame:
    return H.refused_sources(table(spark, folder, "sources")).withColumn("reasons", F.array_join("reasons", "|"))


@query("""select fact_id, position, case when source_id is null then 'no source' else 'unknown source' end as reasons
from evidence where source_id is null or source_id not in (select id from sources)""")
def refused_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return H.refused_evidence(table(spark, folder, "evidence"), table(spark, folder, "sources")).withColumn("reasons", F.array_join("reasons", "|"))


# Validation


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts").withColumnRenamed("confidence", "stored")
    weighed = A.combined_confidence(table(spark, folder, "evidence"), table(spark, folder, "sources")).withColumnRenamed("confidence", "combined")
    claims = facts.join(weighed, "fact_id", "left").select(
        "seq", ref(F.col("subject_id")).alias("subject"), "predicate", decode(F.col("object_json")).alias("object"),
        "valid_from", "valid_to", F.expr("CAST(NULL AS MAP<STRING, STRUCT<kind: STRING, text: STRING, hint: STRING>>)").alias("qualifiers"), "combined", "n_evidence",
    )
    return V.validate(claims, ontology_of(spark, folder), table(spark, folder, "entities"), weighed=(F.col("combined"), F.col("n_evidence")))


_VALIDATED = f"""
with recursive up as (select name as t, name as a from entity_types union all select up.t, e.parent from up join entity_types e on e.name = up.a where e.parent is not null),
w as (select fact_id, 1 - product(1 - e.confidence * coalesce(authority, 1.0)) as c, count(*) as n
  from (select distinct fact_id, source_id, locator, quote, confidence, extractor, extracted_at from evidence) e left join sources on sources.id = source_id group by 1),
b as (
  select f.seq, f.subject_id, f.predicate, f.object_json, f.valid_to, {REF} as r, f.valid_from, w.c, w.n, p.name as pn, p.domain, p.value_range, p.temporal,
    s.id as sid, s.type as st, o.id as oid, o.type as ot,
    {INSTANT.format(c="f.valid_from")} as vs, {INSTANT.format(c="f.valid_to")} as ve,
    {PRECISION.format(c="f.valid_from")} as ps, {PRECISION.format(c="f.valid_to")} as pe,
    coalesce({NAIVE.format(c="f.valid_from")}, false) as ns, coalesce({NAIVE.format(c="f.valid_to")}, false) as ne
  from facts f left join w using (fact_id) left join predicates p on p.name = f.predicate
  left join entities s on s.id = f.subject_id left join entities o on o.id = {REF}),
x as (
  select seq, 'subject.unresolved' as rule, 'warning' as severity from b where subject_id is null
  union all select seq, 'provenance.missing', 'error' from b where coalesce(n, 0) = 0
  union all select seq, 'time.naive', 'error' from b where ns
  union all select seq, 'time.naive', 'error' from b where ne
  union all select seq, 'time.invalid', 'error' from b where valid_from is not null and not ns and vs is null
  union all select seq, 'time.invalid', 'error' from b where valid_to is not null and not ne and ve is null
  union all select seq, 'time.empty_interval', 'error' from b where not ns and not ne and ve <= vs
  union all select seq, 'schema.unknown_predicate', 'info' from b where pn is null
  union all select seq, 'schema.moment_with_end', 'error' from b where temporal = 'moment' and valid_to is not null
  union all select seq, 'subject.unknown_entity', 'warning' from b where pn is not null and len(domain) > 0 and subject_id is not null and sid is null
  union all select seq, 'schema.domain', case when st is null then 'warning' else 'error' end from b
    where pn is not null and len(domain) > 0 and sid is not null and (st is null or not exists (select 1 from up where up.t = st and list_contains(domain, up.a)))
  union all select seq, 'schema.range', 'error' from b where value_range in ('string', 'integer', 'number', 'boolean', 'time')
    and (r is not null or value_range <> 'integer' or not regexp_full_match(object_json, '-?[0-9]+'))
  union all select seq, 'object.unknown_entity', 'warning' from b where value_range not in ('string', 'integer', 'number', 'boolean', 'time') and r is not null and oid is null
  union all select seq, 'schema.range', case when ot is null then 'warning' else 'error' end from b
    where value_range not in ('string', 'integer', 'number', 'boolean', 'time') and oid is not null and (ot is null or not exists (select 1 from up where up.t = ot and up.a = value_range))
  union all select seq, 'schema.range', 'error' from b where value_range not in ('string', 'integer', 'number', 'boolean', 'time') and r is null
  union all select seq, 'confidence.unknown', 'info' from b where c is null
  union all select seq, 'confidence.too_low', 'error' from b where c < 0.2
  union all select seq, 'confidence.below_accept', 'warning' from b where c >= 0.2 and c < 0.5)
"""


@query(f"{_VALIDATED} select seq, rule, severity, count(*) as times from x group by all")
def findings(spark: SparkSession, folder: str) -> DataFrame:
    found = _validated(spark, folder).select("seq", F.explode("findings").alias("f"))
    return found.groupBy("seq", F.col("f.rule").alias("rule"), F.col("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("times"))


@query(f"""{_VALIDATED}, worst as (select seq, bool_or(severity = 'error') as e, bool_or(severity = 'warning') as w from x group by 1),
s as (select case when e then 'rejected' when w then 'needs_review' else 'accepted' end as status from b left join worst using (seq))
select status, count(*) as claims from s group by 1""")
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _validated(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("claims"))


@query("""with c as (select facts.*, seq % 5 as form, p.name as pn, len(p.domain) as n_domain, p.value_range in (select name from entity_types) as of_entity
  from facts left join predicates p on p.name = predicate and seq % 5 <> 0),
x as (
  select seq, 'predicate.empty' as rule, 'error' as severity from c where form = 0
  union all select seq, 'object.missing', 'error' from c where form = 1
  union all select seq, 'object.unresolved', 'warning' from c where form = 2 or form = 3 and of_entity
  union all select seq, 'schema.unknown_predicate', 'error' from c where form <> 0 and pn is null
  union all select seq, 'schema.domain', 'info' from c where n_domain > 0 and subject_id is not null
  union all select seq, 'own.open_start', 'info' from c where valid_from is null
  union all select seq, 'own.long', 'warning' from c where length(object_json) > 40)
select seq, rule, severity, count(*) as times from x group by all""")
def structural_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as claims with a fault by turns (blank predicate, no object, a mention, plain text), a strict ontology, no registry, and two rules of one's own."""
    form, value = F.col("seq") % 5, decode(F.col("object_json"))
    text = lambda kind: F.struct(F.lit(kind).alias("kind"), F.coalesce(value["text"], F.lit("")).alias("text"), F.lit(None).cast("string").alias("hint"))
    facts = table(spark, folder, "facts")
    claims = facts.select(
        "seq", ref(F.col("subject_id")).alias("subject"), F.when(form == 0, "  ").otherwise(F.col("predicate")).alias("predicate"),
        F.when(form == 2, text("mention")).when(form == 3, text("string")).when(form != 1, value).alias("object"), "valid_from", "valid_to",
        F.expr("CAST(NULL AS MAP<STRING, STRUCT<kind: STRING, text: STRING, hint: STRING>>)").alias("qualifiers"), F.lit(0.9).alias("sure"), F.lit(1).alias("pieces"),
        F.length("object_json").alias("size"),
    )
    ontology = ontology_of(spark, folder)
    ontology.strict = True
    rules = [
        lambda: F.when(F.col("valid_from").isNull(), V.finding("own.open_start", V.INFO, "no start")),
        lambda: F.when(F.col("size") > 40, V.finding("own.long", V.WARNING, "long object")),
    ]
    found = V.validate(claims, ontology, None, rules=rules, weighed=(F.col("sure"), F.col("pieces"))).select("seq", F.explode("findings").alias("f"))
    named = ["predicate.empty", "object.missing", "object.unresolved", "schema.unknown_predicate", "schema.domain", "own.open_start", "own.long"]
    return found.where(F.col("f.rule").isin(named)).groupBy("seq", F.col("f.rule").alias("rule"), F.col("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("times"))


# Conflicts

_CLAIMS = f"""
with f as (select seq, fact_id, subject_id, predicate, object_key, {INSTANT.format(c="valid_from")} as s, {INSTANT.format(c="valid_to")} as e from facts
  where status = 'active' and subject_id is not null and predicate in (select name from predicates where cardinality = 'one')),
k as (select subject_id, predicate, object_key, s, e, min(seq) as seq, arg_min(fact_id, seq) as rep from f group by 1, 2, 3, 4, 5),
pairs as (select a.rep as fact_a, b.rep as fact_b, a.subject_id, a.predicate from k a join k b
  on a.subject_id = b.subject_id and a.predicate = b.predicate and a.seq < b.seq and a.object_key <> b.object_key
  and (a.e is null or b.s is null or a.e > b.s) and (b.e is null or a.s is null or b.e > a.s))
"""


@query(f"{_CLAIMS} select fact_a, fact_b, subject_id, predicate from pairs")
def conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return K.detect_claims(table(spark, folder, "facts"), single_valued(spark, folder)).select("fact_a", "fact_b", "subject_id", "predicate")


@query(f"""{_CLAIMS}, v as (select * from k where object_key is not null and (s is null or e is null or e > s))
select a.rep, a.subject_id, a.predicate, a.object_key, (select count(*) from v b where a.subject_id = b.subject_id and a.predicate = b.predicate and a.object_key <> b.object_key
  and (a.e is null or b.s is null or a.e > b.s) and (b.e is null or a.s is null or b.e > a.s)) as n_rivals from v a""")
def rival_counts(spark: SparkSession, folder: str) -> DataFrame:
    return K.rival_counts(table(spark, folder, "facts"), single_valued(spark, folder)).drop("members")


def _judged(spark: SparkSession, folder: str, policy: str, detect: Callable[[DataFrame, DataFrame], DataFrame] = K.detect_claims) -> DataFrame:
    facts = table(spark, folder, "facts")
    measured = K.scores(facts, table(spark, folder, "evidence"), table(spark, folder, "sources"))
    return K.judged(detect(facts, single_valued(spark, folder)), measured, policy).select("fact_a", "fact_b", "winner")


_SCORES = """, m as (select fact_id, max(confidence) as confidence from facts group by 1),
q as (select fact_id, max(authority) as authority, max(extracted_at) as latest from evidence left join sources on sources.id = source_id group by 1),
z as (select * from m left join q using (fact_id))
select fact_a, fact_b, case when a.{c} > b.{c} then fact_a when b.{c} > a.{c} then fact_b end as winner
from pairs left join z a on a.fact_id = fact_a left join z b on b.fact_id = fact_b"""


@query(_CLAIMS + _SCORES.format(c="confidence"))
def winners_by_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "highest_confidence")


@query(_CLAIMS + _SCORES.format(c="authority"))
def winners_by_authority(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "highest_authority")


@query(_CLAIMS + _SCORES.format(c="latest"))
def winners_by_recency(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "most_recent_evidence")


_FACTS = f"""
with o as (select seq, fact_id, subject_id, predicate, object_key, {INSTANT.format(c="valid_from")} as s, {INSTANT.format(c="valid_to")} as e from facts
  where status = 'active' and subject_id is not null and fact_id is not null and predicate in (select name from predicates where cardinality = 'one')
  qualify row_number() over (partition by fact_id order by seq) = 1),
pairs as (select a.fact_id as fact_a, b.fact_id as fact_b, a.subject_id, a.predicate from o a join o b
  on a.subject_id = b.subject_id and a.predicate = b.predicate and (a.seq < b.seq or a.seq = b.seq and a.fact_id < b.fact_id) and a.object_key <> b.object_key
  and (a.e is null or b.s is null or a.e > b.s) and (b.e is null or a.s is null or b.e > a.s))
"""


@query(f"{_FACTS} select fact_id, arg_min(fact_id, seq) over (partition by subject_id, predicate, object_key, s, e) as rep from o")
def claim_members(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts").where("status = 'active'").join(single_valued(spark, folder), "predicate", "left_semi")
    return K.members_of(facts).select("fact_id", "rep")


@query(f"{_FACTS} select fact_a, fact_b, subject_id, predicate from pairs")
def fact_conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return K.detect(table(spark, folder, "facts"), single_valued(spark, folder)).select("fact_a", "fact_b", "subject_id", "predicate")


@query(f"""{_FACTS}, v as (select * from o where object_key is not null and (s is null or e is null or e > s))
select a.fact_id, a.subject_id, a.predicate, a.object_key, (select count(*) from v b where a.subject_id = b.subject_id and a.predicate = b.predicate and a.object_key <> b.object_key
  and (a.e is null or b.s is null or a.e > b.s) and (b.e is null or a.s is null or b.e > a.s)) as n_rivals from v a""")
def fact_rival_counts(spark: SparkSession, folder: str) -> DataFrame:
    return K.fact_rival_counts(table(spark, folder, "facts"), single_valued(spark, folder))


@query(_FACTS + _SCORES.format(c="confidence"))
def fact_winners_by_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "highest_confidence", K.detect)


@query(_FACTS + _SCORES.format(c="authority"))
def fact_winners_by_authority(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "highest_authority", K.detect)


@query(_FACTS + _SCORES.format(c="latest"))
def fact_winners_by_recency(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "most_recent_evidence", K.detect)


@query()
def settled_by_arrival(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts")
    measured = K.scores(facts, table(spark, folder, "evidence"), table(spark, folder, "sources"))
    return K.settle(facts, single_valued(spark, folder), measured, "highest_confidence")


@query("""with d as (select conflict_id, fact_a as pick from conflicts where winner is null and fact_a is not null),
l as (select distinct fact_b as fact_id from d join conflicts using (conflict_id) where fact_b is not null)
select seq, facts.fact_id, case when l.fact_id is not null and status = 'active' then 'superseded' else status end as status from facts left join l on l.fact_id = facts.fact_id""")
def facts_after_decisions(spark: SparkSession, folder: str) -> DataFrame:
    conflicts = table(spark, folder, "conflicts")
    decisions = conflicts.where("winner is null and fact_a is not null").select("conflict_id", F.col("fact_a").alias("winner"))
    _, facts, _ = K.decide(conflicts, table(spark, folder, "facts"), decisions, F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    return facts.select("seq", "fact_id", "status")


# Exports


@query(f"""select fact_id, subject_id, predicate, {REF} as object_entity_id, case when {REF} is null then object_json end as object_value,
  case when {REF} is null then 'integer' else 'entity' end as object_type, trim(valid_from) as valid_from, trim(valid_to) as valid_to,
  {PRECISION.format(c="valid_from")} as valid_from_precision, {PRECISION.format(c="valid_to")} as valid_to_precision, confidence, status,
  {ISO.format(c="recorded_at")} as recorded_at, {ISO.format(c="superseded_at")} as superseded_at from facts""")
def table_facts(spark: SparkSession, folder: str) -> DataFrame:
    return X.fact_table(table(spark, folder, "facts"))


@query(f"""select fact_id, position, source_id, locator, quote, confidence, extractor, {ISO.format(c="extracted_at")} as extracted_at
from evidence where fact_id in (select fact_id from facts where status = 'active')""")
def table_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return X.evidence_table(table(spark, folder, "facts"), table(spark, folder, "evidence"), include_superseded=False)


@query("""select fact_id, k as key, json_extract_string(qualifiers_json, '$."' || k || '"') as value, 'string' as value_type
from (select fact_id, qualifiers_json, unnest(json_keys(qualifiers_json)) as k from facts)""")
def table_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    return X.qualifier_table(table(spark, folder, "facts"))


@query("select id, label, type, provisional from entities")
def table_entities(spark: SparkSession, folder: str) -> DataFrame:
    return X.entity_table(entities_of(spark, folder))


@query(f"select distinct id as entity_id, unnest({ALIASES}) as alias from entities")
def table_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return X.alias_table(entities_of(spark, folder))


@query(f"""select id, kind, uri, title, {ISO.format(c='retrieved_at')} as retrieved_at, authority from sources
where id in (select source_id from evidence where fact_id in (select fact_id from facts))""")
def table_sources(spark: SparkSession, folder: str) -> DataFrame:
    return X.source_table(A.first_seen_sources(table(spark, folder, "facts"), table(spark, folder, "evidence"), table(spark, folder, "sources")))


@query(f"select conflict_id, fact_a, fact_b, subject_id, predicate, {ISO.format(c='detected_at')} as detected_at, policy, winner from conflicts")
def table_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return X.conflict_table(table(spark, folder, "conflicts"))


@query(f"""select subject_id as source, {REF} as target, fact_id as id, predicate, confidence, valid_from, valid_to, qualifiers_json as qualifiers, coalesce(s.source_ids, '') as source_ids, status
from facts left join (select fact_id, string_agg(source_id, '|' order by position, source_id) as source_ids
  from (select fact_id, source_id, min(position) as position from evidence where source_id is not null group by 1, 2) group by 1) s using (fact_id)
where status = 'active' and {REF} is not null""")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = X.graph_edges(table(spark, folder, "facts"), evidence=table(spark, folder, "evidence"))
    return edges.withColumn("source_ids", F.array_join("source_ids", "|"))


@query(f"""select subject_id as subject, object_json as value, 'integer' as value_type, fact_id as id, predicate, confidence, valid_from, valid_to, qualifiers_json as qualifiers, coalesce(s.source_ids, '') as source_ids, status
from facts left join (select fact_id, string_agg(source_id, '|' order by position, source_id) as source_ids
  from (select fact_id, source_id, min(position) as position from evidence where source_id is not null group by 1, 2) group by 1) s using (fact_id)
where status = 'active' and {REF} is null""")
def graph_statements(spark: SparkSession, folder: str) -> DataFrame:
    statements = X.graph_statements(table(spark, folder, "facts"), evidence=table(spark, folder, "evidence"))
    return statements.withColumn("source_ids", F.array_join("source_ids", "|"))


@query(f"""with ends as (select subject_id as id from facts where status = 'active' and subject_id is not null union select {REF} from facts where status = 'active' and {REF} is not null)
select id, label, type, array_to_string(list_sort({ALIASES}), '|') as aliases, provisional from entities
union all select id, id, null, '', false from ends where id not in (select id from entities)""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = X.graph_nodes(table(spark, folder, "facts"), entities_of(spark, folder))
    return nodes.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""select subject_id, predicate, case when count(*) = 1 then min(object_json) else '[' || string_agg(object_json, ', ' order by seq, fact_id) || ']' end as value
from facts where status = 'active' and {REF} is null group by 1, 2""")
def node_properties(spark: SparkSession, folder: str) -> DataFrame:
    return X.node_properties(table(spark, folder, "facts"))


_TEXT = r"""replace(replace(replace(replace(label, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')"""


@query(f"""
select '<urn:factloom:entity/' || url_encode(id) || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || {_TEXT} || '" .' as line from entities where label is not null
union all select '<urn:factloom:entity/' || url_encode(id) || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:factloom:type/' || url_encode(type) || '> .' from entities where type <> ''
union all select '<urn:factloom:entity/' || url_encode(subject_id) || '> <urn:factloom:predicate/' || url_encode(predicate) || '> ' ||
  case when {REF} is not null then '<urn:factloom:entity/' || url_encode({REF}) || '>' else '"' || object_json || '"^^<http://www.w3.org/2001/XMLSchema#integer>' end || ' .'
from facts where status = 'active' and subject_id is not null""")
def ntriples(spark: SparkSession, folder: str) -> DataFrame:
    return X.ntriples(table(spark, folder, "facts"), table(spark, folder, "entities"))


# Serving


@query("""with claims as (select seq as claim_id, subject_id, predicate, object_key from facts where status = 'superseded' and subject_id is not null),
v as (select subject_id, predicate, object_key, count(distinct fact_id) as n, max(confidence) as best from facts where status = 'active' group by 1, 2, 3),
c as (select claim_id, coalesce(sum(n) filter (v.object_key = claims.object_key), 0) as s,
    coalesce(sum(n) filter (v.object_key <> claims.object_key and predicate in (select name from predicates where cardinality = 'one')), 0) as x,
    max(best) filter (v.object_key = claims.object_key) as confidence
  from claims left join v using (subject_id, predicate) group by 1)
select claim_id, cast(s as bigint) as n_supporting, cast(x as bigint) as n_contradicting, confidence,
  case when s > 0 and x > 0 then 'disputed' when s > 0 then 'supported' when x > 0 then 'contradicted' else 'unknown' end as verdict from c""")
def checked_claims(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts")
    claims = facts.where("status = 'superseded' and subject_id is not null").select(F.col("seq").alias("claim_id"), F.col("subject_id").alias("subject"), "predicate", F.col("object_key").alias("object"))
    return Q.check_claims(claims, facts, single_valued(spark, folder))


@query(f"""with claims as (select seq as claim_id, subject_id, predicate, case when seq % 2 = 0 then 'mention:nobody at all' else object_key end as object_key
  from facts where status = 'superseded' and subject_id is not null),
f as (select * from facts where status = 'active' and coalesce({INSTANT.format(c="valid_from")} <= -2208988800, true) and coalesce({INSTANT.format(c="valid_to")} > -2208988800, true)),
v as (select subject_id, predicate, object_key, count(distinct fact_id) as n, max(confidence) as best from f
  where subject_id in (select id from entities) group by 1, 2, 3),
c as (select claim_id, coalesce(sum(n) filter (v.object_key = claims.object_key), 0) as s,
    coalesce(sum(n) filter (v.object_key <> claims.object_key and predicate in (select name from predicates where cardinality = 'one')), 0) as x,
    max(best) filter (v.object_key = claims.object_key) as confidence
  from claims left join v using (subject_id, predicate) group by 1)
select claim_id, cast(s as bigint) as n_supporting, cast(x as bigint) as n_contradicting, confidence,
  case when s > 0 and x > 0 then 'disputed' when s > 0 then 'supported' when x > 0 then 'contradicted' else 'unknown' end as verdict from c""")
def checked_claims_at(spark: SparkSession, folder: str) -> DataFrame:
    """Claims as of 1900, of which every second one names an entity that nobody bears: every value contradicts it."""
    facts, entities = table(spark, folder, "facts"), entities_of(spark, folder)
    stated = F.when(F.col("seq") % 2 == 0, F.lit("mention:nobody at all")).otherwise(F.col("object_key"))
    claims = facts.where("status = 'superseded' and subject_id is not null").select(F.col("seq").alias("claim_id"), F.col("subject_id").alias("subject"), "predicate", stated.alias("object"))
    return Q.check_claims(claims, facts, single_valued(spark, folder), entities, at="1900")


@query("""select distinct c.seq as claim_id, e.fact_id, e.position, e.source_id from facts c join facts f
  on f.subject_id = c.subject_id and f.predicate = c.predicate and f.object_key = c.object_key and f.status = 'active' join evidence e on e.fact_id = f.fact_id
where c.status = 'superseded'""")
def supporting_evidence(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts")
    claims = facts.where("status = 'superseded' and subject_id is not null").select(F.col("seq").alias("claim_id"), F.col("subject_id").alias("subject"), "predicate", F.col("object_key").alias("object"))
    return Q.supporting_evidence(claims, facts, table(spark, folder, "evidence")).select("claim_id", "fact_id", "position", "source_id").distinct()


@query(f"""
with f as (select * from facts where status = 'active' and confidence >= 0.5),
o as (select fact_id, min(seq) as seq from f group by 1),
c as (select fact_id, source_id, min(position) as position from evidence where source_id is not null group by 1, 2),
n as (select source_id, row_number() over (order by min((seq, position)), source_id) as number from c join o using (fact_id) group by 1),
m as (select fact_id, ' [' || string_agg(cast(number as varchar), ', ' order by position, number) || ']' as marks from c join n using (source_id) group by 1),
d as (select f.*, marks, coalesce(s.label, subject_id, '') as subject_label, coalesce(e.label, {REF}, object_json) as object_label,
    list_concat(list_transform(list_sort(json_keys(qualifiers_json)), lambda k: k || ': ' || json_extract_string(qualifiers_json, '$."' || k || '"')), list_filter([
      case when valid_from is not null and valid_to is not null then 'from ' || trim(valid_from) || ' to ' || trim(valid_to)
        when valid_from is not null then 'from ' || trim(valid_from) when valid_to is not null then 'until ' || trim(valid_to) end,
      'confidence ' || printf('%.2f', confidence)], lambda x: x is not null)) as details
  from f left join entities s on s.id = subject_id left join entities e on e.id = {REF} left join m using (fact_id))
select seq, fact_id, '- ' || subject_label || ' ' || lower(trim(replace(predicate, '_', ' '))) || ' ' || object_label
  || ' (' || array_to_string(details, '; ') || ')' || coalesce(marks, '') as line from d""")
def rendered_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = A.find(table(spark, folder, "facts"), min_confidence=0.5)
    return Q.render_facts(facts, table(spark, folder, "evidence"), entities_of(spark, folder))


@query()
def resolved_titles(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "documents").select(F.regexp_replace("title", "^(On|Letter about|Notes on) |: an entry$", "").alias("text"), F.lit(None).cast("string").alias("hint"))
    return R.resolve(titles, entities_of(spark, folder), ontology_of(spark, folder))


@query("""with e as (select 'part:' || p_partkey as id, p_name as name, trim(regexp_replace(regexp_replace(lower(p_name), '[[:punct:]]', ' ', 'g'), ' +', ' ', 'g')) as norm from part),
m as (select distinct case when p_partkey % 2 = 0 then p_name else upper(p_name) end as text from part),
x as (select text, count(distinct id) as n, min(id) as id from m join e on e.name = text group by 1),
y as (select text, count(distinct id) as n, min(id) as id from m join e on e.norm = trim(regexp_replace(regexp_replace(lower(text), '[[:punct:]]', ' ', 'g'), ' +', ' ', 'g')) group by 1)
select text, case when coalesce(x.n, y.n) = 1 then coalesce(x.id, y.id) end as entity_id, case when x.n is not null then 1.0 when y.n is not null then 0.9 else 0.0 end::double as score,
  coalesce(x.n, y.n, 0) as n_candidates, coalesce(x.n, y.n, 0) > 1 as ambiguous from m left join x using (text) left join y using (text)""")
def resolved_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    entities = part.select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"),
        F.lit(None).cast("string").alias("type"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("aliases"), F.lit(False).alias("provisional"),
    )
    mentions = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("text"), F.lit(None).cast("string").alias("hint"))
    return R.resolve(mentions, entities).drop("hint")


# Names and ids


@query("select distinct predicate, lower(trim(replace(predicate, '_', ' '))) as shown from facts")
def humanized_predicates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("predicate").distinct().withColumn("shown", N.humanized(F.col("predicate")))


@query("""select seq, 'fact:' || substr(sha256(coalesce('ref:' || subject_id, 'none') || chr(31) || predicate || chr(31) || object_key || chr(31) || coalesce(valid_from, 'none') || chr(31) || coalesce(valid_to, 'none') || chr(31)), 1, 16) as id
from facts""")
def claim_ids(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.functions.terms import claim_id

    facts = table(spark, folder, "facts")
    none = F.expr("CAST(NULL AS MAP<STRING, STRUCT<kind: STRING, text: STRING, hint: STRING>>)")
    return facts.select("seq", claim_id(key(ref(F.col("subject_id"))), F.col("predicate"), key(decode(F.col("object_json"))), F.col("valid_from"), F.col("valid_to"), none).alias("id"))


@query(f"""select predicate, min(epoch) as first_second, strftime(to_timestamp(min(epoch)) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as first_instant
from (select predicate, cast({INSTANT.format(c="valid_from")} as bigint) as epoch from facts) group by 1""")
def first_instants(spark: SparkSession, folder: str) -> DataFrame:
    starts = table(spark, folder, "facts").groupBy("predicate").agg(F.min(earliest_second(F.col("valid_from"))).alias("first_second"))
    return starts.withColumn("first_instant", written(F.col("first_second")))
