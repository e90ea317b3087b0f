"""Orphan references, found by an as-of match against runs of parent keys.

Keys of any text become integers without loss: parent and referring keys are
put together, spread over hash buckets and numbered densely in their order
within the bucket.  The parents' numbers are compressed into runs of
consecutive integers, each reference takes the run that starts at or before it
(as-of), and a reference beyond that run's end has no parent.  Keys compare
exactly as written.

References are reduced to their different keys before the match (with map-side
combine) and meet the orphan keys again over a salted join, so neither a key
nor a source with a third of all rows gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.skew import skew_join

#: Hash buckets; a shuffle task holds many of them, so their number only has to exceed that of tasks by far.
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Reference:
    """One referring field.

    rows: the referring table; key: its field; row_key: text that names a row;
    parents, parent_key: the table and field referred to; domain: a name for
    the parent key, shared by the fields that refer to it; at: time of the row.
    """

    ref_table: str
    ref_field: str
    rows: DataFrame
    key: str
    row_key: Column
    domain: str
    parents: DataFrame
    parent_key: str
    at: Column


def _referring(references: list[Reference]) -> DataFrame:
    parts = [
        r.rows.where(F.col(r.key).isNotNull()).select(
            F.lit(r.ref_table).alias("ref_table"),
            F.lit(r.ref_field).alias("ref_field"),
            r.row_key.alias("row_key"),
            F.col(r.key).alias("missing_key"),
            F.lit(r.domain).alias("domain"),
            r.at.alias("at"),
        )
        for r in references
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def missing_keys(references: list[Reference]) -> DataFrame:
    """The different referred keys without a parent: domain, missing_key."""
    asked = _referring(references).select("domain", F.col("missing_key").alias("key"), F.lit(0).alias("parent")).distinct()
    domains = {r.domain: r for r in references}
    for name, r in domains.items():
        asked = asked.unionByName(
            r.parents.where(F.col(r.parent_key).isNotNull())
            .select(F.lit(name).alias("domain"), F.col(r.parent_key).alias("key"), F.lit(1).alias("parent"))
            .distinct()
        )
    bucket = F.pmod(F.xxhash64("domain", "key"), F.lit(BUCKETS))
    in_bucket = Window.partitionBy("bucket").orderBy("domain", "key")
    coded = asked.withColumn("bucket", bucket).withColumn("code", F.dense_rank().over(in_bucket))
    # Gaps and islands: within a run of parents the code less the parent's rank stays the same.
    ordered = Window.partitionBy("bucket").orderBy("code", F.desc("parent"))
    islands = coded.withColumn(
        "island", F.when(F.col("parent") == 1, F.col("code") - F.sum("parent").over(ordered))
    )
    runs = islands.withColumn(
        "run_end", F.max(F.when(F.col("parent") == 1, F.col("code"))).over(Window.partitionBy("bucket", "island"))
    )
    # As-of: the last run that starts at or before the reference's code.
    preceding = F.last(F.when(F.col("parent") == 1, F.col("run_end")), ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        runs.withColumn("reaches", preceding)
        .where((F.col("parent") == 0) & (F.col("reaches").isNull() | (F.col("code") > F.col("reaches"))))
        .select("domain", F.col("key").alias("missing_key"))
    )


def orphans(references: list[Reference]) -> DataFrame:
    """Every reference to a key that its parent table lacks: ref_table, ref_field, row_key, missing_key, at.

    Null keys refer to nothing and are left out; empty text is a key like any
    other.  Repeated rows come out repeatedly (take ``distinct`` of the fields
    needed).  Without parents every reference is an orphan; without referring
    rows the result is empty.  Extra columns are ignored.
    """
    return skew_join(
        _referring(references), missing_keys(references), ["domain", "missing_key"], F.col("row_key")
    ).select("ref_table", "ref_field", "row_key", "missing_key", "at")


def by_period(found: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Counts per field and month of ``at`` (``unknown`` for null).

    ref_table, ref_field, period, orphan_rows, different_keys, and, given a
    ``log`` (key_text, change_kind), the rows whose key was logged as deleted
    or as arrived.  Rows are counted once per row_key and missing_key.
    """
    rows = found.groupBy("ref_table", "ref_field", "row_key", "missing_key").agg(F.min("at").alias("at"))
    rows = rows.withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))
    kinds = ["deleted", "arrived"]
    if log is not None:
        logged = log.where(F.col("key_text").isNotNull()).groupBy(F.col("key_text").alias("missing_key")).agg(
            *[F.max((F.col("change_kind") == k).cast("int")).alias(k) for k in kinds]
        )
        rows = skew_join(rows, logged, ["missing_key"], F.col("row_key"), "left")
    # keys are counted over their own rows first, so that a hot key is combined on the map side
    keyed = rows.groupBy("ref_table", "ref_field", "period", "missing_key").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in kinds if log is not None],
    )
    return keyed.groupBy("ref_table", "ref_field", "period").agg(
        F.sum("rows").alias("orphan_rows"),
        F.count(F.lit(1)).alias("different_keys"),
        *[F.sum(k).alias(f"logged_{k}") for k in kinds if log is not None],
    )
