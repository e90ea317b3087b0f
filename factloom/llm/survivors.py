"""One surviving record per group of rival facts, by a latent two-sided quality model.

Every source has a sensitivity (how often it states a value that is true) and a
specificity (how often it stays silent on a value that is false).  Both are
inferred together with the truth of every value by expectation-maximisation.
So are those of five raters, which speak for the facts that a recorded winner
names, that lead their group in all of confidence, authority and date, or in one of the
three: how far any of them is to be trusted is not given but learnt.  As they
depend on one another, they are asked in that order until one has an answer: a
recorded decision was made in view of the measures and of what the sources
state, so where there is one it alone is asked and the sources are judged by it;
and a fact that leads in all three leads in each.

Groups whose survivor is on record, or whose best fact is beyond dispute, anchor
the model: their values keep truth 1 or 0 while it learns.  Every value then
gets a posterior from what its sources and raters say, so that fields of many
values keep each value judged true and single-valued fields keep the likeliest;
for the anchored groups too there is the pick of the model alone (``picked``).

A source is taken to have seen every value of the groups in which it states
any.  A row per value holds the numbers of the sources that state it and of
those that saw its group, both sets bounded by the number of sources.  So the
expectation is a projection of that row and the maximisation a sum per source;
no round moves more than a row per source and task.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.skew import even_join, hot_keys

GROUP = ["subject_id", "predicate"]
#: Rounds of expectation-maximisation.
ROUNDS = 6
#: Most rows of the table of sources; more are an error.  Each has a quality of its own, and sources missing from it share one.
MOST_SOURCES = 100_000
#: Raters, numbered before the sources; number 0 is for sources missing from the table.
RATERS = ["winner", "leader", "confidence", "authority", "latest"]
WINNER = 1
#: Beta priors as pseudo-counts: of true values stated and unstated, of false values stated and unstated.
TRUE_STATED, TRUE_SILENT, FALSE_STATED, FALSE_SILENT = 6.0, 4.0, 2.0, 8.0


@dataclass(frozen=True)
class Survivors:
    """facts: every candidate with its measures; posteriors: per value; quality: per source number; best: the survivors."""

    facts: DataFrame
    posteriors: DataFrame
    quality: list[tuple[float, float]]
    best: DataFrame


def _known(number: Column) -> Column:
    """Unknown and not-a-number count lowest."""
    return F.when(number.isNull() | F.isnan(number), F.lit(float("-inf"))).otherwise(number)


def _known_sources(sources: DataFrame) -> DataFrame:
    """source_id, authority (the best of its rows) and number of every source in the table."""
    trust = sources.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max(_known(F.col("authority"))).alias("authority"))
    # one task, of at most MOST_SOURCES rows
    return trust.withColumn("number", F.row_number().over(Window.orderBy("source_id")) + len(RATERS))


def candidates(facts: DataFrame, evidence: DataFrame, known: DataFrame, conflicts: DataFrame, predicates: DataFrame) -> DataFrame:
    """The facts to compare, each once: group columns, fact_id, value, confidence, authority, latest, the numbers of its sources, and whether a winner names it."""
    once = (
        facts.where("subject_id is not null and fact_id is not null")
        .select(*GROUP, "fact_id", F.col("object_key").alias("value"), _known(F.col("confidence")).alias("confidence"))
        .join(predicates, "predicate", "left_semi")
        .groupBy("fact_id", *GROUP)
        .agg(F.min(F.coalesce("value", F.lit(""))).alias("value"), F.max("confidence").alias("confidence"))
    )
    winners = conflicts.where("winner is not null").select(F.col("winner").alias("fact_id"), *GROUP, F.lit(True).alias("named")).distinct()
    once = once.join(winners, ["fact_id", *GROUP], "left").withColumn("named", F.col("named").isNotNull())
    # combined per fact and source before anything moves, so a hot source or fact is small by then
    stated = (
        evidence.where("fact_id is not null").select("fact_id", "source_id", "extracted_at")
        .groupBy("fact_id", "source_id").agg(F.max(F.unix_micros("extracted_at")).alias("latest"))
    )
    measured = (
        stated.join(known, "source_id", "left")
        .groupBy("fact_id")
        .agg(
            F.max("authority").alias("authority"), F.max("latest").alias("latest"),
            # at most as many as there are known sources, and 0 for all others
            F.collect_set(F.when(F.col("source_id").isNotNull(), F.coalesce("number", F.lit(0)))).alias("stated_by"),
        )
    )
    return once.join(measured, "fact_id", "left").withColumns(
        {
            "authority": _known(F.col("authority")),
            "latest": F.coalesce("latest", F.lit(-(1 << 62))),
            "stated_by": F.coalesce("stated_by", F.expr("CAST(array() AS ARRAY<INT>)")),
        }
    )


def groups(measured: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Groups of two or more facts, with the fact on record (``recorded``) or beyond dispute (``dominant``), else null.

    A dominant fact alone has at once the highest confidence, the highest
    authority and the latest evidence.  It is then the greatest by the three in
    turn; whether it is alone shows in the first and last of a digest among the
    greatest.
    """
    named = (
        conflicts.where("winner is not null and subject_id is not null and predicate is not null")
        .groupBy(*GROUP).agg(F.min("winner").alias("low"), F.max("winner").alias("high"))
    )
    digest = F.md5("fact_id")
    mirrored = F.translate(digest, "0123456789abcdef", "fedcba9876543210")
    measures = ["confidence", "authority", "latest"]
    summed = measured.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_facts"), F.max("named").alias("has_winner"), *[F.max(c).alias(f"top_{c}") for c in measures],
        F.max(F.struct(*measures, digest.alias("digest"), "fact_id")).alias("last"), F.max(F.struct(*measures, mirrored.alias("digest"), "fact_id")).alias("first"),
    ).where("n_facts > 1")
    leads = F.lit(True)
    for c in measures:
        leads = leads & (F.col(f"last.{c}") == F.col(f"top_{c}"))
    alone = leads & (F.col("first.fact_id") == F.col("last.fact_id"))
    return summed.join(named, GROUP, "left").select(
        *GROUP, "n_facts", "has_winner", leads.alias("has_leader"), *[f"top_{c}" for c in measures],
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("recorded"),
        F.when(F.col("low").isNull() & alone, F.col("last.fact_id")).alias("dominant"),
    )


def _view(quality: list[tuple[float, float]]) -> Column:
    """Expectation: truth of a value from its row and the sensitivity and specificity of each number."""
    said = [math.log(sensitivity / (1 - specificity)) - math.log((1 - sensitivity) / specificity) for sensitivity, specificity in quality]
    silent = [math.log((1 - sensitivity) / specificity) for sensitivity, specificity in quality]
    # one constant each, however many sources there are
    constant = lambda weights: F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = lambda numbers, weights: F.aggregate(
        F.col(numbers), F.lit(0.0), lambda acc, i: acc + F.element_at(constant(weights), i + 1)
    )
    decided = F.when(F.array_contains("stated_by", F.lit(WINNER)), said[WINNER]).otherwise(0.0) + silent[WINNER]
    weighed = F.when(F.array_contains("seen_by", F.lit(WINNER)), decided).otherwise(total("stated_by", said) + total("seen_by", silent))
    logit = F.ln(1 / F.greatest(F.col("n_values") - 1.0, F.lit(0.5))) + weighed
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(50.0)), F.lit(-50.0))))


def _truth(quality: list[tuple[float, float]]) -> Column:
    """The view of the model, and the truth of anchored values."""
    return F.coalesce(F.col("anchor"), _view(quality))


def _quality(values: DataFrame, quality: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Maximisation: one row per source number, summed on the map side."""
    judged = values.select("stated_by", "seen_by", _truth(quality).alias("truth"))
    flags = F.transform("seen_by", lambda i: F.struct(i.alias("number"), F.array_contains("stated_by", i).alias("stated")))
    sums = (
        judged.select("truth", F.explode(flags).alias("s")).groupBy("s.number")
        .agg(
            F.sum("truth").alias("true"), F.sum(1 - F.col("truth")).alias("false"),
            F.sum(F.when(F.col("s.stated"), F.col("truth")).otherwise(0.0)).alias("hits"),
            F.sum(F.when(F.col("s.stated"), 1 - F.col("truth")).otherwise(0.0)).alias("alarms"),
        )
    )
    out = list(quality)
    for r in sums.collect():  # a row per rater and known source at most, and one for the rest
        out[r["number"]] = (
            (r["hits"] + TRUE_STATED) / (r["true"] + TRUE_STATED + TRUE_SILENT),
            1 - (r["alarms"] + FALSE_STATED) / (r["false"] + FALSE_STATED + FALSE_SILENT),
        )
    return out


def survivors(
    facts: DataFrame, evidence: DataFrame, sources: DataFrame, conflicts: DataFrame, predicates: DataFrame, rounds: int = ROUNDS, withheld: Column | None = None
) -> Survivors:
    """Infer the quality of sources and raters and the survivor of every group of rival facts.

    ``facts`` are those to compare (already filtered by status), ``predicates``
    has the names to take.  A group is the two or more different fact_id that
    share subject_id (not null) and predicate.  ``best`` has one row per group:
    group columns, fact_id, value, truth, basis (recorded, dominant or model) and
    picked, the fact that the model alone prefers.  The survivor of a clear group
    is its anchor; elsewhere it is the pick of the model: the likeliest value,
    then the fact named by a winner, the one that leads, confidence, authority,
    latest evidence, and the smallest fact_id.  ``withheld`` (of the group
    columns) keeps the anchors of some groups from the model, to measure it.

    Null confidence, authority and dates count lowest; evidence of null sources
    counts for its date, not for quality; sources missing from ``sources`` share
    one quality and count once for a value; a null value is one value, empty text;
    facts without evidence take part.  Repeated rows of a fact count once with
    their highest confidence.  Empty tables give empty results.  Extra columns
    are ignored.  More than ``MOST_SOURCES`` sources are an error.

    Jobs run while the result is built: tables are written and every round of
    expectation-maximisation collects a row per source.
    """
    known = cut(_known_sources(sources))
    n_sources = known.count()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; raise the bound")
    measured = cut(candidates(facts, evidence, known, conflicts, predicates))
    grouped = cut(groups(measured, conflicts))
    hot = hot_keys(grouped, GROUP, "n_facts")
    leads = {c: F.col(c) == F.col(f"top_{c}") for c in ("confidence", "authority", "latest")}
    leader = leads["confidence"] & leads["authority"] & leads["latest"]
    asked = ~F.col("has_winner") & ~F.col("has_leader")
    says = {"winner": F.col("named"), "leader": ~F.col("has_winner") & leader, **{c: asked & on_top for c, on_top in leads.items()}}
    votes = F.array_compact(F.array(*[F.when(says[r], F.lit(i)) for i, r in enumerate(RATERS, 1)]))
    placed = even_join(measured, grouped, GROUP, F.col("fact_id"), hot).withColumns({
        "basis": F.when(F.col("fact_id") == F.col("recorded"), "recorded").when(F.col("fact_id") == F.col("dominant"), "dominant"),
        "leader": leader, "stated_by": F.array_union("stated_by", votes),
    })
    order = F.struct(
        (~F.col("named")).alias("o0"), (~F.col("leader")).alias("o1"), (-F.col("confidence")).alias("o2"), (-F.col("authority")).alias("o3"),
        (-F.col("latest")).alias("o4"), F.col("fact_id").alias("o5"),
    )
    listed = placed.select(*GROUP, "value", "fact_id", "basis", order.alias("order"), F.explode_outer("stated_by").alias("number"))
    values = listed.groupBy(*GROUP, "value").agg(
        F.min(F.struct("order", "fact_id")).alias("first"), F.collect_set("number").alias("stated_by"),
        F.max(F.struct("basis", "fact_id")).alias("clear"),  # at most one fact of a group has a basis, and nulls are least
    )
    seen = values.select(*GROUP, "value", F.col("clear.basis").isNotNull().alias("clear"), F.posexplode_outer("stated_by").alias("at", "number")).groupBy(*GROUP).agg(
        F.collect_set("number").alias("seen_by"), F.max("clear").alias("group_clear"),
        F.sum((F.coalesce("at", F.lit(0)) == 0).cast("int")).alias("n_values"),
    )
    shown = F.col("group_clear") if withheld is None else F.col("group_clear") & ~withheld
    table = cut(even_join(values, seen, GROUP, F.col("value"), hot).withColumn("anchor", F.when(shown, F.col("clear.basis").isNotNull().cast("double"))))
    quality = [(0.7, 0.8)] * (1 + len(RATERS) + n_sources)
    for _ in range(rounds):
        quality = _quality(table, quality)
    posterior = table.withColumns({"view": _view(quality), "truth": _truth(quality)})
    preferred = F.struct((-F.col("view")).alias("r0"), F.col("first.order").alias("r1"))
    best = (
        posterior.groupBy(*GROUP)
        .agg(
            F.min_by(F.struct(F.col("first.fact_id").alias("fact_id"), "value", F.col("view").alias("truth")), preferred).alias("p"),
            F.max(F.struct(F.col("clear.basis").alias("basis"), F.col("clear.fact_id").alias("fact_id"), "value")).alias("c"),
        )
        .select(
            *GROUP, *[F.when(F.col("c.basis").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in ("fact_id", "value")],
            F.when(F.col("c.basis").isNotNull(), 1.0).otherwise(F.col("p.truth")).alias("truth"), F.coalesce("c.basis", F.lit("model")).alias("basis"),
            F.col("p.fact_id").alias("picked"),
        )
    )
    return Survivors(measured, posterior.select(*GROUP, "value", "truth"), quality, best)


def picked(found: Survivors) -> DataFrame:
    """subject_id, predicate and fact_id: what the model picks in the clear groups, checked against what makes them clear.

    The model ranks the facts of every group by itself, whatever anchors it; a
    pick that is not the fact on record or beyond dispute is no survivor and
    is left out.
    """
    return found.best.where("basis <> 'model' and picked = fact_id").select(*GROUP, F.col("picked").alias("fact_id"))


def golden_records(found: Survivors, facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The survivors with each field filled from the best of the facts that state the surviving value.

    Validity and qualifiers come from the fact with the highest confidence that
    has them, the quote with its locator from the evidence of the highest
    confidence times authority (unknown authority 1), ties by latest date and
    then by text.  A field that no fact of the group has stays null.
    """
    kept = found.best.select(*GROUP, F.col("fact_id").alias("survivor"), "value", "truth", "basis")
    members = found.facts.select(*GROUP, "value", "fact_id").join(kept, [*GROUP, "value"])
    rows = members.join(
        facts.select("fact_id", "object_json", "valid_from", "valid_to", "qualifiers_json", "confidence", "recorded_at"), "fact_id"
    )
    rank = F.struct(_known(F.col("confidence")), (F.col("fact_id") == F.col("survivor")), F.col("recorded_at"), F.col("fact_id"))
    filled = rows.groupBy(*GROUP, "survivor", "value", "truth", "basis").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in ("object_json", "valid_from", "valid_to")],
        F.max_by("qualifiers_json", F.when(F.col("qualifiers_json") != "{}", rank)).alias("qualifiers_json"),
        F.max("confidence").alias("confidence"),
    )
    trust = sources.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max("authority").alias("authority"))
    quoted = (
        evidence.where("quote is not null and fact_id is not null")
        .select("fact_id", "source_id", "quote", "locator", "confidence", "extracted_at")
        .join(members.select("fact_id").distinct(), "fact_id", "left_semi")
    )
    quoted = quoted.join(trust, "source_id", "left")
    weight = F.struct(
        (_known(F.col("confidence")) * F.coalesce("authority", F.lit(1.0))).alias("w"), F.col("extracted_at"), F.col("quote"), F.col("locator")
    )
    per_fact = quoted.groupBy("fact_id").agg(F.max(weight).alias("w"))
    quotes = members.join(per_fact, "fact_id").groupBy(*GROUP).agg(F.max("w").alias("w")).select(*GROUP, F.col("w.quote").alias("quote"), F.col("w.locator").alias("locator"))
    return filled.withColumnRenamed("survivor", "fact_id").join(quotes, GROUP, "left")
