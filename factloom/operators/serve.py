"""Serving: cited lines for prompts, and checking claims against facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.names import humanized
from factloom.functions.temporal import contains, earliest_second, stripped
from factloom.functions.terms import decode
from factloom.operators.resolve import resolve
from factloom.skew import skew_join

SUPPORTED, CONTRADICTED, DISPUTED, UNKNOWN = "supported", "contradicted", "disputed", "unknown"


@F.pandas_udf(T.StringType())
def _by_binary_value(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def two_places(x: Column) -> Column:
    """Two decimals, ties by the binary value.

    Only what reads as a tie, such as 0.285, needs a look at its binary value in
    Python; anything else rounds the same from its digits.
    """
    tie = x.cast("string").rlike(r"^-?[0-9]+\.[0-9]{2}5$")
    return F.when(tie, _by_binary_value(F.when(tie, x))).when(x.isNotNull() & ~F.isnan(x), F.format_string("%.2f", x))


def _labelled(rows: DataFrame, entities: DataFrame, id_: str, label: str) -> DataFrame:
    labels = entities.where("id is not null").groupBy(F.col("id").alias(id_)).agg(F.min("label").alias(label))
    return skew_join(rows, labels, [id_], F.col("seq"), "left").withColumn(label, F.coalesce(label, id_))


def citations(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_id and its number by first appearance over the facts in order of seq and their evidence by position.

    Only the different sources are ranked, after each was reduced to where it
    first appears.
    """
    order = facts.groupBy("fact_id").agg(F.min("seq").alias("seq"))
    cited = evidence.where("source_id is not null").groupBy("fact_id", "source_id").agg(F.min("position").alias("position"))
    first = cited.join(order, "fact_id").groupBy("source_id").agg(F.min(F.struct("seq", "position")).alias("first"))
    return first.select("source_id", F.row_number().over(Window.orderBy("first.seq", "first.position", "source_id")).alias("number"))


def render_facts(facts: DataFrame, evidence: DataFrame, entities: DataFrame, humanize: bool = True, cite: bool = True) -> DataFrame:
    """seq, fact_id and ``line`` of every fact given, with details and, if ``cite``, the numbers of its sources.

    Take the facts to render from :func:`find`; each is one line.  Unknown
    entities show their id, unknown confidence is left out.
    """
    shown = facts.withColumn("t", decode(F.col("object_json"))).withColumn("object_id", F.when(F.col("t.kind") == "ref", F.col("t.text")))
    shown = _labelled(_labelled(shown, entities, "subject_id", "subject_label"), entities, "object_id", "object_label")
    qualifiers = F.array_sort(F.map_entries(F.from_json("qualifiers_json", "map<string,string>")))
    start, end = stripped(F.col("valid_from")), stripped(F.col("valid_to"))
    period = (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("from "), start, F.lit(" to "), end))
        .when(start.isNotNull(), F.concat(F.lit("from "), start)).when(end.isNotNull(), F.concat(F.lit("until "), end))
    )
    details = F.concat(
        F.coalesce(F.transform(qualifiers, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), F.expr("CAST(array() AS ARRAY<STRING>)")),
        F.array_compact(F.array(period, F.concat(F.lit("confidence "), two_places(F.col("confidence"))), F.when(F.col("status") != "active", "superseded"))),
    )
    lines = shown.withColumn("details", details).select(
        "seq", "fact_id",
        F.concat(
            F.lit("- "), F.coalesce("subject_label", F.lit("")), F.lit(" "), humanized(F.col("predicate")) if humanize else F.col("predicate"), F.lit(" "),
            F.coalesce("object_label", "t.text", F.lit("")), F.when(F.size("details") > 0, F.concat(F.lit(" ("), F.array_join("details", "; "), F.lit(")"))).otherwise(""),
        ).alias("line"),
    )
    if not cite:
        return lines
    numbers = citations(facts, evidence)
    of_fact = (
        skew_join(evidence.where("source_id is not null").groupBy("fact_id", "source_id").agg(F.min("position").alias("position")), numbers, ["source_id"], F.col("fact_id"))
        .groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("position", "number"))).alias("n"))
    )
    marks = F.concat(F.lit(" ["), F.array_join(F.transform("n", lambda x: x["number"].cast("string")), ", "), F.lit("]"))
    return lines.join(of_fact, "fact_id", "left").select("seq", "fact_id", F.concat("line", F.coalesce(marks, F.lit(""))).alias("line"))


def source_lines(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """number and ``line`` of every cited source: title or id, and its address."""
    return citations(facts, evidence).join(sources, F.col("source_id") == sources["id"], "left").select(
        "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.coalesce("title", "source_id"), F.when(F.col("uri").isNotNull(), F.concat(F.lit(" - "), "uri")).otherwise("")).alias("line"),
    )


#: Most lines of a text for a prompt.
MOST_LINES = 100_000


def render_text(lines: DataFrame, sources: DataFrame, most: int = MOST_LINES) -> str:
    """The rendered facts and the list of their sources as one text for a prompt; empty for no facts.

    More than ``most`` lines of either are an error, not cut off: take fewer facts, or write the lines as a table.
    """
    parts = [df.orderBy(*order).select("line").limit(most + 1).collect() for df, order in ((lines, ("seq", "fact_id")), (sources, ("number",)))]
    if max(map(len, parts)) > most:
        raise ValueError(f"more than {most} lines for one text")
    facts, cited = ([r["line"] for r in part] for part in parts)
    return "\n".join(facts + (["", "Sources:", *cited] if facts and cited else []))


def _asked(claims: DataFrame, entities: DataFrame | None) -> DataFrame:
    """claim_id, subject_id, predicate and ``keys``, the object keys that would support the claim."""
    asked = claims.select("claim_id", "subject", "predicate", "object")
    # a name is text or an entity; a mention is nothing but the entity it names
    named_text, mentioned = F.col("object").startswith("name:"), F.col("object").startswith("mention:")
    text = F.when(named_text | mentioned, F.regexp_replace("object", "^(?:name|mention):", ""))
    keys = F.when(named_text, F.array(F.concat(F.lit("str:"), text), F.concat(F.lit("ref:"), text))).when(mentioned, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array("object"))
    if entities is None:
        return asked.select("claim_id", F.col("subject").alias("subject_id"), "predicate", keys.alias("keys"))
    known = entities.select(F.col("id").alias("subject")).distinct().withColumn("is_id", F.lit(True))
    mentions = asked.select(F.col("subject").alias("text")).unionByName(asked.select(text.alias("text"))).distinct().withColumn("hint", F.lit(None).cast("string"))
    named = resolve(mentions, entities).select("text", "entity_id")
    asked = asked.withColumn("text", text).join(known, "subject", "left").join(named.select(F.col("text").alias("subject"), F.col("entity_id").alias("named")), "subject", "left")
    meant = asked.join(named.withColumnRenamed("entity_id", "meant"), "text", "left")
    return meant.select(
        "claim_id", F.when(F.col("is_id"), F.col("subject")).otherwise(F.col("named")).alias("subject_id"), "predicate",
        F.array_compact(F.concat(keys, F.array(F.concat(F.lit("ref:"), "meant")))).alias("keys"),
    )


def _believed(facts: DataFrame, at: Column | str | None) -> DataFrame:
    active = facts.where("status = 'active'")
    if at is None:
        return active
    moment = earliest_second(F.lit(at)) if isinstance(at, str) else at
    return active.where(contains(earliest_second(F.col("valid_from")), earliest_second(F.col("valid_to")), moment))


def supporting_evidence(claims: DataFrame, facts: DataFrame, evidence: DataFrame, entities: DataFrame | None = None, at: Column | str | None = None) -> DataFrame:
    """claim_id, and the evidence of every active fact that supports the claim, each fact once."""
    believed = _believed(facts, at).select("subject_id", "predicate", "object_key", "fact_id").distinct()
    hits = _asked(claims, entities).join(believed, ["subject_id", "predicate"]).where(F.array_contains("keys", F.col("object_key"))).select("claim_id", "fact_id").distinct()
    return hits.join(evidence, "fact_id").select("claim_id", *evidence.columns)


def check_claims(claims: DataFrame, facts: DataFrame, single_valued: DataFrame, entities: DataFrame | None = None, at: Column | str | None = None) -> DataFrame:
    """Verdict on each claim: supported, contradicted (single-valued predicate with other values only), disputed (both) or unknown.

    ``claims``: claim_id, subject (id, or a name if ``entities`` are given),
    predicate, object (a key such as ``ref:x`` or ``int:1``; ``name:x`` is a text that
    matches as string, as entity id and, with ``entities``, as the entity it
    names; ``mention:x`` matches as that entity only, so one that names none
    is contradicted by every value).  Adds verdict, n_supporting, n_contradicting and confidence, the best
    of the supporting facts.  Names never create entities; an ambiguous or
    unknown subject gives unknown.  ``at`` limits the facts to those valid then.
    """
    asked, believed = _asked(claims, entities), _believed(facts, at)
    # facts are reduced to the different values per subject and predicate before they meet the claims
    values = believed.groupBy("subject_id", "predicate", "object_key").agg(F.countDistinct("fact_id").alias("n"), F.max("confidence").alias("best"))
    single = single_valued.select("predicate").distinct().withColumn("single", F.lit(True))
    met = asked.join(values, ["subject_id", "predicate"], "left").join(single, "predicate", "left")
    hit = F.array_contains("keys", F.col("object_key"))
    miss = ~hit & F.coalesce(F.col("single"), F.lit(False))
    verdict = (
        F.when((F.col("n_supporting") > 0) & (F.col("n_contradicting") > 0), DISPUTED).when(F.col("n_supporting") > 0, SUPPORTED)
        .when(F.col("n_contradicting") > 0, CONTRADICTED).otherwise(UNKNOWN)
    )
    counted = met.groupBy("claim_id").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_supporting"),
        F.coalesce(F.sum(F.when(miss, F.col("n"))), F.lit(0)).alias("n_contradicting"),
        F.max(F.when(hit, F.col("best"))).alias("confidence"),
    )
    return counted.withColumn("verdict", verdict)
