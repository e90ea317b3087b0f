"""Text to facts: extract, resolve, validate and shape for the store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.operators import conflicts as K
from factloom.operators import facts as A
from factloom.operators import resolve as R
from factloom.operators import validate as V
from factloom.operators.ontology import Ontology

Extractor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Ingested:
    """results: every claim with its findings; the rest: tables in the form of the store."""

    results: DataFrame
    facts: DataFrame
    evidence: DataFrame
    entities: DataFrame
    conflicts: DataFrame


#: What tells the claims of a run apart, and their order: document, extractor, piece of the text, place in it.
PLACE = ["__document", "__extractor", "chunk_offset", "ordinal"]


def numbered(claims: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Claims with a number that rises in ``order`` (which is unique), as a written table: sorted by range, not in one task."""
    return cut(claims.orderBy(*order).withColumn(name, F.monotonically_increasing_id() + 1))


def run_extractors(documents: DataFrame, extractors: Sequence[Extractor], key: str = "doc_id") -> DataFrame:
    """The claims of all extractors with their place; what a model extractor reports beside claims is left out."""
    found = None
    for i, extractor in enumerate(extractors):
        part = extractor(documents)
        if "kind" in part.columns:
            part = part.where("kind = 'claim'")
        part = part.where("error is null").withColumn("__extractor", F.lit(i)).withColumn("__document", F.col(key))
        if "chunk_offset" not in part.columns:
            part = part.withColumn("chunk_offset", F.lit(0))
        part = part.select(key, "subject", "predicate", "object", "valid_from", "valid_to", "qualifiers", "locator", "quote", "confidence", "extractor", *PLACE)
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no extractor")
    return found


def with_evidence(claims: DataFrame, documents: DataFrame, sources: DataFrame, extracted_at: Column, key: str = "doc_id") -> DataFrame:
    """Claims (of :func:`run_extractors`) with seq in the order of their places, and their evidence as an array of one."""
    origin = documents.select(key, F.col("source").alias("source_id"))
    trust = sources.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max("authority").alias("authority"))
    e = F.struct(
        "source_id", "locator", "quote", F.col("confidence").cast("double").alias("confidence"), "extractor", extracted_at.cast("timestamp").alias("extracted_at"),
        F.col("authority").cast("double").alias("authority"),
    )
    joined = claims.join(origin, key).join(trust, "source_id", "left").withColumn("evidence", F.array(e))
    return numbered(joined.select(key, "subject", "predicate", "object", "evidence", "valid_from", "valid_to", "qualifiers", *PLACE), PLACE).drop(*PLACE)


@dataclass(frozen=True)
class Judged:
    """results: every claim with its findings and verdict; entities: those known and those the claims added."""

    results: DataFrame
    entities: DataFrame


def judge(
    documents: DataFrame, extractors: Sequence[Extractor], sources: DataFrame, entities: DataFrame, ontology: Ontology | None, run_at: Column, create: bool = True, **validation
) -> Judged:
    """Documents (doc_id, unique, of any type; text; source) to resolved and validated claims.

    ``entities``: seq, id, label, type, aliases (array), provisional.  Mentions that no
    entity bears become provisional entities.  Claims are resolved set at a
    time: all of a batch see the same entities and those the batch adds.
    """
    claims = with_evidence(run_extractors(documents, extractors), documents, sources, run_at)
    resolved, fresh = R.resolve_claims(claims, entities, ontology, create)
    known = cut(entities.select("seq", "id", "label", "type", "aliases", "provisional").unionByName(fresh))
    return Judged(cut(V.validate(resolved, ontology, known, **validation)), known)


def ingest(
    documents: DataFrame, extractors: Sequence[Extractor], sources: DataFrame, entities: DataFrame, ontology: Ontology | None, run_at: Column, create: bool = True,
    policy: str = "keep_both", **validation,
) -> Ingested:
    """:func:`judge`, and the accepted claims as facts with their conflicts, settled by ``policy``.

    Nothing is written: :meth:`factloom.factbase.FactBase.ingest` carries
    documents into a store.
    """
    done = judge(documents, extractors, sources, entities, ontology, run_at, create, **validation)
    facts, evidence = A.facts_of(done.results, run_at)
    merged = A.merge_arrivals(facts).drop("confidence", "arrivals").join(A.combined_confidence(evidence, sources).select("fact_id", "confidence"), "fact_id", "left").select(*facts.columns)
    merged = cut(merged)
    single = K.single_valued(documents.sparkSession, ontology)
    if policy == "keep_both":
        pairs = K.judged(K.detect(merged, single), merged.select("fact_id"), policy)
        return Ingested(done.results, merged, evidence, done.entities, K.numbered(pairs, run_at, policy))
    settled = cut(K.settle(merged, single, K.scores(merged, evidence, sources), policy))
    return Ingested(done.results, K.retired(merged, settled, run_at), evidence, done.entities, K.numbered(settled.where("kind = 'conflict'"), run_at, policy))
