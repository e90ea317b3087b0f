"""What sources and evidence must satisfy before they are taken in; rows that do not come out with their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import in_unit

# The kinds of source.
KINDS = ("document", "api", "human", "model")


def refused_sources(sources: DataFrame) -> DataFrame:
    """id and reasons of sources with an empty or null id, an unknown or null kind, or an authority beyond 0 to 1."""
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("id"), F.lit("")) == "", "empty id"),
            F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"),
            F.when(~in_unit(F.col("authority")), "authority beyond 0 to 1"),
        )
    )
    return sources.select("id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def refused_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """fact_id, position and reasons of evidence without a known source or with a confidence beyond 0 to 1."""
    known = sources.where("id is not null").select(F.col("id").alias("source_id")).distinct().withColumn("__known", F.lit(True))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("source_id").isNull(), "no source").when(F.col("__known").isNull(), "unknown source"),
            F.when(~in_unit(F.col("confidence")), "confidence beyond 0 to 1"),
        )
    )
    return evidence.join(known, "source_id", "left").select("fact_id", "position", reasons.alias("reasons")).where(F.size("reasons") > 0)
