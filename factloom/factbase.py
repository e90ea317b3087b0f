"""A base of facts: the tables of a store with the operations on them.

Values are immutable: every change returns a new base.  ``save`` commits it to a
:class:`~factloom.sources.store.Store`, ``load`` reads it back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.operators import conflicts as K
from factloom.operators import facts as A
from factloom.operators import pipeline as P
from factloom.operators.ontology import Ontology
from factloom.operators.registry import ENTITIES
from factloom.sources.backend import Backend

FACTS = "seq long, fact_id string, subject_id string, predicate string, object_key string, object_json string, valid_from string, valid_to string, qualifiers_json string, confidence double, status string, recorded_at timestamp, superseded_at timestamp"
EVIDENCE = "fact_id string, position long, source_id string, locator string, quote string, confidence double, extractor string, extracted_at timestamp"
SOURCES = "id string, kind string, uri string, title string, retrieved_at timestamp, authority double"
CONFLICTS = "seq long, conflict_id string, fact_a string, fact_b string, subject_id string, predicate string, detected_at timestamp, policy string, winner string"


@dataclass(frozen=True)
class FactBase:
    facts: DataFrame
    evidence: DataFrame
    sources: DataFrame
    entities: DataFrame
    conflicts: DataFrame
    ontology: Ontology | None = None
    policy: str = "keep_both"

    @classmethod
    def empty(cls, spark: SparkSession, ontology: Ontology | None = None, policy: str = "keep_both") -> FactBase:
        return cls(*[spark.createDataFrame([], ddl) for ddl in (FACTS, EVIDENCE, SOURCES, ENTITIES, CONFLICTS)], ontology, policy)

    @classmethod
    def load(cls, store: Backend, policy: str = "keep_both") -> FactBase:
        base = cls.empty(store.spark, store.ontology, policy)
        kept = {t: df for t in ("facts", "evidence", "sources", "entities", "conflicts") if (df := store.table(t)) is not None}
        return replace(base, **kept)

    def save(self, store: Backend) -> str:
        return store.commit(facts=self.facts, evidence=self.evidence, sources=self.sources, entities=self.entities, conflicts=self.conflicts)

    def get(self, fact_id: str) -> DataFrame:
        return self.facts.where(F.col("fact_id") == fact_id)

    def find(self, **pattern) -> DataFrame:
        return A.find(self.facts, **pattern)

    def cited_sources(self) -> DataFrame:
        return A.first_seen_sources(self.facts, self.evidence, self.sources)

    def find_conflicts(self, open_only: bool = False) -> DataFrame:
        return self.conflicts.where("winner is null") if open_only else self.conflicts

    def add(self, facts: DataFrame, evidence: DataFrame, at: Column) -> FactBase:
        """Merge facts and their evidence, as :func:`~factloom.operators.facts.facts_of` makes them.

        A fact that is known gains evidence and a new confidence and changes in
        nothing else.  A new fact is recorded at ``at`` (unless it was before),
        made active, and judged by the policy against its active rivals in the
        order of seq.  All evidence of the batch counts when a fact is judged.
        Evidence given before is not stored again.
        """
        last = self.facts.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        low = facts.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
        shifted = facts.withColumn("seq", F.col("seq") - low + last + 1)
        fresh = A.merge_arrivals(shifted).drop("arrivals").join(self.facts.select("fact_id"), "fact_id", "left_anti").withColumns(
            {"recorded_at": F.coalesce(F.col("recorded_at"), at.cast("timestamp")), "status": F.lit("active"), "superseded_at": F.lit(None).cast("timestamp")}
        )
        every = cut(self.evidence.unionByName(self._later(evidence)).groupBy("fact_id", *A.EVIDENCE).agg(F.min("position").alias("position")).select(*self.evidence.columns))
        weight = A.combined_confidence(every, self.sources).select("fact_id", F.col("confidence").alias("__c"))
        merged = cut(
            self.facts.unionByName(fresh.select(*self.facts.columns)).join(weight, "fact_id", "left")
            .withColumn("confidence", F.coalesce("__c", "confidence")).select(*self.facts.columns)
        )
        judged = cut(K.settle(merged, K.single_valued(merged.sparkSession, self.ontology), K.scores(merged, every, self.sources), self.policy, since=last))
        out = K.retired(merged, judged, at)
        made = K.numbered(judged.where("kind = 'conflict'"), at, self.policy, existing=self.conflicts.count())
        return replace(self, facts=out, evidence=every, conflicts=self.conflicts.unionByName(made.select(*self.conflicts.columns)))

    def ingest(self, documents: DataFrame, extractors: Sequence[P.Extractor], at: Column, create: bool = True, **validation) -> tuple[FactBase, DataFrame]:
        """Documents (doc_id, text, source) through extraction, resolution, validation and this store's policy.

        The new base holds the accepted claims as facts and the entities they
        added; the other result is every claim with its findings and verdict.
        """
        done = P.judge(documents, extractors, self.sources, self.entities, self.ontology, at, create, **validation)
        facts, evidence = A.facts_of(done.results, at)
        return replace(self, entities=done.entities).add(facts, evidence, at), done.results

    def _later(self, evidence: DataFrame) -> DataFrame:
        """New evidence with positions after those that its fact has."""
        last = self.evidence.groupBy("fact_id").agg((F.max("position") + 1).alias("__from"))
        return evidence.join(last, "fact_id", "left").withColumn("position", F.col("position") + F.coalesce("__from", F.lit(0))).select(*self.evidence.columns)

    def decide(self, decisions: DataFrame, at: Column) -> tuple[FactBase, DataFrame]:
        """Settle conflicts by hand; the new base and the refused decisions."""
        conflicts, facts, refused = K.decide(self.conflicts, self.facts, decisions, at)
        return replace(self, conflicts=conflicts, facts=facts), refused
