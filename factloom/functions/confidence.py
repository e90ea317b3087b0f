"""Combining the confidence of independent evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(confidence: Column, authority: Column) -> Column:
    """Confidence times the authority of its source; unknown authority is 1, unknown confidence stays unknown."""
    return confidence * F.coalesce(authority, F.lit(1.0))


def noisy_or(weight: Column) -> Column:
    """Aggregate: 1 - prod(1 - weight).  Null weights are skipped; null if all are null.  Combines on the map side."""
    return 1 - F.product(1 - weight)


def noisy_or_array(evidence: Column) -> Column:
    """The same over an array of evidence structs with confidence and authority."""
    known = F.filter(evidence, lambda e: e["confidence"].isNotNull())
    doubt = F.aggregate(known, F.lit(1.0), lambda p, e: p * (1 - weighted(e["confidence"], e["authority"])))
    return F.when(F.size(known) > 0, 1 - doubt)


def in_unit(c: Column) -> Column:
    """Whether a confidence or authority is unknown or within 0 and 1."""
    return c.isNull() | c.between(0.0, 1.0)
