"""Facts with their evidence: merging arrivals, pattern queries on two time lines, and claims as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions.temporal import contains, earliest_second
from factloom.functions.terms import encode, key
from factloom.skew import skew_join

EVIDENCE = ["source_id", "locator", "quote", "confidence", "extractor", "extracted_at"]


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """Each different piece of evidence of a fact once, at its first position; all columns may be null."""
    return evidence.groupBy("fact_id", *EVIDENCE).agg(F.min("position").alias("position"))


def combined_confidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Per fact the noisy-or of its different evidence: fact_id, confidence (null if all is unknown), n_evidence.

    Evidence of an unknown or null source has authority 1.  Duplicates count
    once.  Partial products are combined on the map side.
    """
    trust = sources.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max("authority").alias("authority"))
    once = distinct_evidence(evidence.where("fact_id is not null"))
    weighed = skew_join(once, trust, ["source_id"], F.xxhash64("fact_id", "position"), "left")
    return weighed.groupBy("fact_id").agg(
        C.noisy_or(C.weighted(F.col("confidence"), F.col("authority"))).alias("confidence"), F.count(F.lit(1)).alias("n_evidence")
    )


def merge_arrivals(facts: DataFrame) -> DataFrame:
    """One row per fact_id: the fields of its first arrival (smallest seq), and how often it arrived.

    A later arrival adds evidence, but never changes when the fact was recorded,
    revives it or reopens a conflict.  Null ids are left out.
    """
    fields = [c for c in facts.columns if c not in ("fact_id",)]
    first = F.min_by(F.struct(*fields), "seq")
    return (
        facts.where("fact_id is not null").groupBy("fact_id").agg(first.alias("f"), F.count(F.lit(1)).alias("arrivals"))
        .select("fact_id", "f.*", "arrivals")
    )


def find(
    facts: DataFrame,
    subject: str | None = None,
    predicate: str | None = None,
    object_key: str | None = None,
    valid_at: str | None = None,
    as_of: str | Column | None = None,
    min_confidence: float | None = None,
    include_superseded: bool = False,
) -> DataFrame:
    """Facts that match a pattern; None stands for any.

    ``as_of`` (timestamp) takes what was believed then and overrides the status;
    otherwise superseded facts are left out unless asked for.  ``valid_at`` is
    written as a time of any precision and means its first instant; bounds that
    cannot be read count as open.  ``min_confidence`` leaves out unknown ones.
    Every condition is a plain filter, so equality and confidence reach the scan.
    """
    out = facts
    for name, value in (("subject_id", subject), ("predicate", predicate), ("object_key", object_key)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if as_of is not None:
        at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
        out = out.where(F.col("recorded_at").isNotNull() & (F.col("recorded_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))
    elif not include_superseded:
        out = out.where(F.col("status") == "active")
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if valid_at is not None:
        out = out.where(contains(earliest_second(F.col("valid_from")), earliest_second(F.col("valid_to")), earliest_second(F.lit(valid_at))))
    return out


def evidence_of(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The evidence of the given facts with its sources: the rows of ``evidence`` and kind, title, uri and authority (null for an unknown source)."""
    wanted = facts.select("fact_id").distinct()
    known = sources.where("id is not null").select(F.col("id").alias("source_id"), "kind", "title", "uri", "authority")
    rows = skew_join(evidence, wanted, ["fact_id"], F.col("position"), "left_semi")
    return skew_join(rows, known, ["source_id"], F.xxhash64("fact_id", "position"), "left").select(*evidence.columns, "kind", "title", "uri", "authority")


def sources_of(evidence: DataFrame) -> DataFrame:
    """fact_id and ``source_ids``, the different sources of a fact by first position; null sources are left out.

    The array is at most as long as there are sources.
    """
    first = evidence.where("source_id is not null").groupBy("fact_id", "source_id").agg(F.min("position").alias("position"))
    listed = first.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("position", "source_id"))).alias("s"))
    return listed.select("fact_id", F.transform("s", lambda x: x["source_id"]).alias("source_ids"))


def first_seen_sources(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that any fact cites, each with the seq of the first fact and position that do."""
    order = facts.where("fact_id is not null").groupBy("fact_id").agg(F.min("seq").alias("seq"))
    cited = evidence.where("source_id is not null").groupBy("fact_id", "source_id").agg(F.min("position").alias("position"))
    first = cited.join(order, "fact_id").groupBy("source_id").agg(F.min(F.struct("seq", "position")).alias("first"))
    return first.join(sources, F.col("source_id") == sources["id"]).select(sources["*"], F.col("first.seq").alias("first_seq"), F.col("first.position").alias("first_position"))


def facts_of(accepted: DataFrame, recorded_at: Column) -> tuple[DataFrame, DataFrame]:
    """Facts and evidence tables of accepted claims (as :func:`validate` returns them, each with its own seq), in the form of the store.

    Positions of evidence rise with seq, but not by one.
    """
    kept = accepted.where("status = 'accepted'")
    facts = kept.select(
        "seq", "fact_id", F.col("subject.text").alias("subject_id"), "predicate", key(F.col("object")).alias("object_key"),
        encode(F.col("object")).alias("object_json"), "valid_from", "valid_to",
        qualifiers_json(F.col("qualifiers")).alias("qualifiers_json"), "confidence", F.lit("active").alias("status"),
        recorded_at.cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"),
    )
    # positions rise with seq and the place in the claim's evidence; sorted by range, so no fact is numbered in one task
    pieces = kept.select("seq", "fact_id", F.posexplode("evidence").alias("position", "e")).orderBy("seq", "position")
    evidence = pieces.select("fact_id", F.monotonically_increasing_id().alias("position"), "e.*")
    return facts, evidence.select("fact_id", "position", *[c for c in evidence.columns if c not in ("fact_id", "position")])


def qualifiers_json(qualifiers: Column) -> Column:
    """JSON object of a MAP<STRING, TERM>, keys sorted; ``{}`` for null and empty."""
    entries = F.array_sort(F.map_entries(qualifiers))
    parts = F.transform(entries, lambda e: F.concat(encode(F.struct(F.lit("string").alias("kind"), e["key"].alias("text"), F.lit(None).cast("string").alias("hint"))), F.lit(": "), F.coalesce(encode(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ", "), F.lit("")), F.lit("}"))
