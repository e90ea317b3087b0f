"""Queries on validity periods (problem 2) and on orphan references (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.temporal import earliest_second, written
from factloom.operators import intervals, orphans
from factloom.operators.orphans import Reference
from factloom.sources.tables import table


def span_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Active facts of span predicates with readable bounds: subject_id, predicate, start, end in seconds."""
    span = table(spark, folder, "predicates").where("temporal = 'span'").select(F.col("name").alias("predicate")).distinct()
    facts = (
        table(spark, folder, "facts")
        .where("status = 'active' and subject_id is not null and predicate is not null")
        .select("subject_id", "predicate", "valid_from", "valid_to")
        .join(span, "predicate", "left_semi")
        .withColumn("start", earliest_second(F.col("valid_from")))
        .withColumn("end", earliest_second(F.col("valid_to")))
    )
    return facts.where(
        "(start is not null or valid_from is null) and (end is not null or valid_to is null)"
    ).select("subject_id", "predicate", "start", "end")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.gaps(span_intervals(spark, folder), ["subject_id", "predicate"])
    return found.select(
        "subject_id", "predicate", written(F.col("gap_from")).alias("gap_from"), written(F.col("gap_to")).alias("gap_to")
    )


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.periods(span_intervals(spark, folder), ["subject_id", "predicate"])
    return found.select(
        "subject_id", "predicate", "period_no",
        written(F.col("start")).alias("period_from"), written(F.col("end")).alias("period_to"),
    )


def references(spark: SparkSession, folder: str) -> list[Reference]:
    """The four referring fields of the store."""
    facts, evidence = table(spark, folder, "facts"), table(spark, folder, "evidence")
    conflicts, sources, entities = (table(spark, folder, t) for t in ("conflicts", "sources", "entities"))
    at_evidence = F.concat_ws("#", "fact_id", F.col("position").cast("string"))
    return [
        Reference("evidence", "fact_id", evidence, "fact_id", at_evidence, "facts", facts, "fact_id", F.col("extracted_at")),
        Reference("evidence", "source_id", evidence, "source_id", at_evidence, "sources", sources, "id", F.col("extracted_at")),
        Reference("conflicts", "fact_a", conflicts, "fact_a", F.col("conflict_id"), "facts", facts, "fact_id", F.col("detected_at")),
        Reference("facts", "subject_id", facts, "subject_id", F.col("fact_id"), "entities", entities, "id", F.col("recorded_at")),
    ]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphans.orphans(references(spark, folder))
    return found.select("ref_table", "ref_field", "row_key", "missing_key").distinct()


def p5_by_period(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.by_period(orphans.orphans(references(spark, folder)), table(spark, folder, "key_log"))


_BOUND = r"""
  case when regexp_full_match(trim({c}), '[0-9]{{4}}') then epoch(try_cast(trim({c}) || '-01-01' as timestamp))
       when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}') then epoch(try_cast(trim({c}) || '-01' as timestamp))
       when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then epoch(try_cast(trim({c}) as timestamp))
       when regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})')
         then epoch(try_cast(substr(trim({c}), 1, 19) as timestamp))
           - case when substr(trim({c}), 20) = 'Z' then 0
                  else (case when substr(trim({c}), 20, 1) = '-' then -1 else 1 end)
                     * (cast(substr(trim({c}), 21, 2) as int) * 3600 + cast(substr(trim({c}), 24, 2) as int) * 60) end
  end"""

_SPANS = f"""
with bounds as (
  select subject_id, predicate, valid_from, valid_to, {_BOUND.format(c="valid_from")} as s, {_BOUND.format(c="valid_to")} as e
  from facts
  where status = 'active' and subject_id is not null
    and predicate in (select name from predicates where temporal = 'span')),
spans as (
  select distinct subject_id, predicate, coalesce(s, -1e15) as s, coalesce(e, 1e15) as e
  from bounds
  where (s is not null or valid_from is null) and (e is not null or valid_to is null)
    and coalesce(e, 1e15) > coalesce(s, -1e15)),
reach as (
  select *, max(e) over (partition by subject_id, predicate order by s, e rows between unbounded preceding and 1 preceding) as before
  from spans)
"""

_WRITTEN = "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ')"

_REFS = """
with refs as (
  select 'evidence' as ref_table, 'fact_id' as ref_field, fact_id || '#' || position as row_key, fact_id as missing_key, extracted_at as seen
  from evidence e where fact_id is not null and not exists (select 1 from facts f where f.fact_id = e.fact_id)
  union all
  select 'evidence', 'source_id', fact_id || '#' || position, source_id, extracted_at
  from evidence e where source_id is not null and not exists (select 1 from sources s where s.id = e.source_id)
  union all
  select 'conflicts', 'fact_a', conflict_id, fact_a, detected_at
  from conflicts c where fact_a is not null and not exists (select 1 from facts f where f.fact_id = c.fact_a)
  union all
  select 'facts', 'subject_id', fact_id, subject_id, recorded_at
  from facts t where subject_id is not null and not exists (select 1 from entities n where n.id = t.subject_id))
"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p5_found": p5_found, "p5_by_period": p5_by_period}

SQL = {
    "p2_found": f"""{_SPANS}
select subject_id, predicate, {_WRITTEN.format(c="before")} as gap_from, {_WRITTEN.format(c="s")} as gap_to
from reach where before < s""",
    "p2_periods": f"""{_SPANS},
numbered as (
  select *, sum(case when before is null or before < s then 1 else 0 end)
    over (partition by subject_id, predicate order by s, e rows unbounded preceding) as period_no
  from reach)
select subject_id, predicate, cast(period_no as int) as period_no,
  case when min(s) > -1e15 then {_WRITTEN.format(c="min(s)")} end as period_from,
  case when max(e) < 1e15 then {_WRITTEN.format(c="max(e)")} end as period_to
from numbered group by subject_id, predicate, period_no""",
    "p5_found": f"{_REFS} select distinct ref_table, ref_field, row_key, missing_key from refs",
    "p5_by_period": f"""{_REFS},
once as (select ref_table, ref_field, row_key, missing_key, min(seen) as seen from refs group by all),
logged as (select key_text, max(cast(change_kind = 'deleted' as int)) as deleted, max(cast(change_kind = 'arrived' as int)) as arrived
  from key_log group by 1)
select ref_table, ref_field, coalesce(strftime(seen at time zone 'UTC', '%Y-%m'), 'unknown') as period,
  count(*) as orphan_rows, count(distinct missing_key) as different_keys,
  cast(sum(coalesce(deleted, 0)) as bigint) as logged_deleted, cast(sum(coalesce(arrived, 0)) as bigint) as logged_arrived
from once left join logged on key_text = missing_key
group by 1, 2, 3""",
}
