"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.llm import mixing, normalform, packing, reading, survivors, variants
from factloom.llm.tokens import sized
from factloom.sources.tables import table


# Problem 1


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "entities"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.pairs_of(p1_clusters(spark, folder))


# Problem 3


def p3_normalized(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "entities").where("label is not null").select(
        F.lit("entities.label").alias("field_name"), F.col("id").alias("row_key"), F.col("label").alias("text")
    )
    quotes = table(spark, folder, "evidence").where("quote is not null").select(
        F.lit("evidence.quote").alias("field_name"),
        F.concat_ws("#", "fact_id", F.col("position").cast("string")).alias("row_key"),
        F.col("quote").alias("text"),
    )
    return normalform.with_form(labels.unionByName(quotes), "text").select("field_name", "row_key", "form", "changed")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_normalized(spark, folder).where("changed").select("field_name", "row_key").distinct()


# Problem 4


def _survivors(spark: SparkSession, folder: str, cardinality: str, temporal: str) -> survivors.Survivors:
    taken = table(spark, folder, "predicates").where((F.col("cardinality") == cardinality) & (F.col("temporal") == temporal))
    return survivors.survivors(
        table(spark, folder, "facts").where("status = 'active'"), table(spark, folder, "evidence"),
        table(spark, folder, "sources"), table(spark, folder, "conflicts"), taken.select(F.col("name").alias("predicate")).distinct(),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.picked(_survivors(spark, folder, "one", "moment"))


def p4_golden(spark: SparkSession, folder: str) -> DataFrame:
    found = _survivors(spark, folder, "one", "moment")
    facts = table(spark, folder, "facts").where("status = 'active'")
    return survivors.golden_records(found, facts, table(spark, folder, "evidence"), table(spark, folder, "sources"))


def p4_many(spark: SparkSession, folder: str) -> DataFrame:
    found = _survivors(spark, folder, "many", "span")
    return found.posteriors.where("truth >= 0.5").select(
        "subject_id", "predicate", F.col("value").alias("object_key"), F.round("truth", 6).alias("truth")
    )


# Problem 6


def _bins(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The kinds of container, a table that a person writes."""
    return [(r["bin_name"], r["capacity_tokens"]) for r in table(spark, folder, "pack_bins").collect()]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    sizes, bins = cut(sized(table(spark, folder, "documents"), "doc_id")), _bins(spark, folder)
    return packing.too_long(packing.pack(sizes, bins), bins)


def p6_assignment(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(sized(table(spark, folder, "documents"), "doc_id"))
    return packing.pack(sizes, _bins(spark, folder)).assignment


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(sized(table(spark, folder, "documents"), "doc_id"))
    return packing.fill(packing.pack(sizes, _bins(spark, folder)))


# Problem 7


def _mixed(spark: SparkSession, folder: str) -> mixing.Mix:
    targets = table(spark, folder, "mix_targets")
    documents = table(spark, folder, "documents").join(targets.select("source").distinct(), "source", "left_semi")
    return mixing.mix(cut(sized(documents, "doc_id", "source")), targets)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).records


def p7_composition(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.composition(_mixed(spark, folder))


# Problem 8


def _leveled(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    model = reading.fit_table(table(spark, folder, "graded_passages"))
    return documents.withColumn("r", reading.reading_level(spark, model, F.col("text")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where("lang = 'en'").where(F.regexp_count("text", F.lit(r"(?U)\S+")) >= 40)
    return _leveled(spark, folder, documents.select("doc_id", "text")).where("r.band >= 4").select("doc_id")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return _leveled(spark, folder, documents).select(
        "doc_id", "lang", "source", F.round("r.level", 6).alias("level"), F.col("r.band").alias("band")
    )


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    return p8_levels(spark, folder).groupBy("lang", "source", "band").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("level"), 4).alias("mean_level")
    )


_P4_SQL = """
with f as (
  select subject_id, predicate, fact_id, max(coalesce(confidence, -1)) as c
  from facts where status = 'active' and subject_id is not null
    and predicate in (select name from predicates where cardinality = 'one' and temporal = 'moment')
  group by all),
m as (
  select f.*, coalesce(a, -1) as a, coalesce(t, timestamptz '0001-01-01') as t
  from f left join (
    select fact_id, max(coalesce(authority, -1)) as a, max(extracted_at) as t
    from evidence left join sources on sources.id = evidence.source_id group by 1) using (fact_id)),
g as (
  select *, count(*) over w as n, max(c) over w as mc, max(a) over w as ma, max(t) over w as mt
  from m window w as (partition by subject_id, predicate)),
w as (
  select subject_id, predicate, min(winner) as lo, max(winner) as hi
  from conflicts where winner is not null group by 1, 2),
r as (select g.*, lo, hi from g left join w using (subject_id, predicate) where n > 1)
select subject_id, predicate, fact_id from r where lo = hi and fact_id = lo
union all
select subject_id, predicate, min(fact_id) from r
where lo is null and c = mc and a = ma and t = mt group by 1, 2 having count(*) = 1
"""

QUERIES = {
    "p1_found": p1_found, "p1_clusters": p1_clusters,
    "p3_found": p3_found, "p3_normalized": p3_normalized,
    "p4_found": p4_found, "p4_golden": p4_golden, "p4_many": p4_many,
    "p6_found": p6_found, "p6_assignment": p6_assignment, "p6_fill": p6_fill,
    "p7_mix": p7_mix, "p7_composition": p7_composition,
    "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile,
}

SQL = {"p4_found": _P4_SQL}
