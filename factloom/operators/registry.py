"""Changes of the entity registry: seq, id, label, type, aliases (array), provisional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "seq long, id string, label string, type string, aliases array<string>, provisional boolean"


def get(entities: DataFrame, entity_id: str) -> DataFrame:
    """The entity of an id, no row if there is none; the id reaches the scan."""
    return entities.where(F.col("id") == entity_id)


def add(entities: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with new entities, and the rows refused: an id that is null, empty, taken or given twice.

    Of several new rows with one id the first (by seq) is taken.
    """
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    first = new.where(~blank).groupBy("id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "id"]), "seq").alias("e")).select("id", "e.*").select(*new.columns)
    good = first.join(entities.select("id"), "id", "left_anti").select(*new.columns)
    refused = new.join(good.select("id", F.col("seq").alias("__seq")), "id", "left").where(F.col("__seq").isNull() | (F.col("seq") != F.col("__seq"))).select(*new.columns)
    return entities.unionByName(good.select(*entities.columns)), refused


def add_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The registry with more ``aliases`` (id, alias); those of unknown ids and null ones have no effect."""
    more = aliases.where("alias is not null").groupBy("id").agg(F.collect_set("alias").alias("__more"))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    merged = F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("__more", none)))
    return entities.join(more, "id", "left").withColumn("aliases", merged).select(*entities.columns)


def confirm(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The registry with the entities of ``ids`` (id) no longer provisional."""
    named = ids.select("id").distinct().withColumn("__sure", F.lit(True))
    sure = F.coalesce(F.col("__sure"), F.lit(False))
    return entities.join(named, "id", "left").withColumn("provisional", F.col("provisional") & ~sure).select(*entities.columns)


def provisional(entities: DataFrame) -> DataFrame:
    return entities.where("provisional")
