"""Mentions to entities: a tiered equi-join that never guesses.

A name index has one row per name and type with the number of entities and the
smallest id, so that a label shared by a third of all entities stays one row.
A mention takes the best tier in which a type-compatible entity bears its name
(exact, else normalised); one entity resolves it, several leave it ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import entity_id, normalize
from factloom.functions.terms import term
from factloom.operators.ontology import Ontology
from factloom.skew import skew_join

# Scores of the two tiers.
EXACT, NORMALIZED = 1.0, 0.9


def entity_names(entities: DataFrame) -> DataFrame:
    """entity_id, type, name of every label and alias, stripped; null names are left out."""
    names = F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.expr("CAST(array() AS ARRAY<STRING>)"))))
    return (
        entities.select(F.col("id").alias("entity_id"), "type", F.explode(names).alias("name"))
        .where("name is not null").withColumn("name", F.btrim("name", F.lit(" \t\n\r")))
    )


def aliases_of(json: Column) -> Column:
    """Alias array of a JSON list; of text that is no valid JSON an empty array."""
    return F.coalesce(F.filter(F.from_json(json, "array<string>", {"allowSingleQuotes": "false"}), lambda a: a.isNotNull()), F.expr("CAST(array() AS ARRAY<STRING>)"))


def _index(names: DataFrame, key: Column) -> DataFrame:
    return (
        names.select(key.alias("key"), "type", "entity_id").distinct()
        .groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("id"))
    )


def _fits(matched: DataFrame, ontology: Ontology | None) -> DataFrame:
    """Rows whose entity type admits the hint: no hint, no type, equal, or a subtype."""
    plain = F.col("hint").isNull() | F.col("type").isNull() | (F.col("type") == F.col("hint"))
    if ontology is None:
        return matched.where(plain)
    below = sorted(f"{t}>{a}" for t in ontology.types for a in ontology.ancestors(t))
    return matched.where(plain | F.concat("type", F.lit(">"), "hint").isin(below))


def candidates(mentions: DataFrame, entities: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """Every entity a mention may mean at its best tier: text, hint, entity_id, score, one row each."""
    found = resolve(mentions, entities, ontology).where("n_candidates > 0").select("text", "hint", "score")
    names = entity_names(entities).withColumn("norm", normalize(F.col("name")))
    exact = found.where(F.col("score") == EXACT).join(names, F.btrim("text", F.lit(" \t\n\r")) == names["name"])
    near = found.where(F.col("score") == NORMALIZED).withColumn("key", normalize(F.col("text"))).join(names, F.col("key") == names["norm"]).drop("key")
    return _fits(exact.unionByName(near), ontology).select("text", "hint", F.col("entity_id"), "score").distinct()


def resolve(mentions: DataFrame, entities: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """Resolve the different mentions of ``mentions`` (text, hint).

    Returns text, hint, entity_id (null unless exactly one entity fits), score
    (0 for none), n_candidates, ambiguous.  Null texts are left out; a blank
    text resolves to nothing; punctuation alone matches punctuation alone.
    """
    asked = mentions.select("text", "hint").where("text is not null").distinct().select(
        "text", "hint", F.btrim("text", F.lit(" \t\n\r")).alias("exact"), normalize(F.col("text")).alias("norm")
    )
    names = entity_names(entities)
    tiers = []
    for tier, key in (("exact", F.col("name")), ("norm", normalize(F.col("name")))):
        hits = asked.join(_index(names, key).withColumnRenamed("key", tier), tier)
        tiers.append(
            _fits(hits, ontology).groupBy("text", "hint").agg(F.sum("n").alias(f"{tier}_n"), F.min("id").alias(f"{tier}_id"))
        )
    same = lambda t: (F.col("text") == t["text2"]) & F.col("hint").eqNullSafe(t["hint2"])
    out = asked
    for t in tiers:
        t = t.withColumnRenamed("text", "text2").withColumnRenamed("hint", "hint2")
        out = out.join(t, same(t), "left").drop("text2", "hint2")
    n = F.coalesce("exact_n", "norm_n", F.lit(0))
    return out.select(
        "text", "hint",
        F.when(n == 1, F.coalesce("exact_id", "norm_id")).alias("entity_id"),
        F.when(F.col("exact_n").isNotNull(), EXACT).when(F.col("norm_n").isNotNull(), NORMALIZED).otherwise(0.0).alias("score"),
        n.cast("long").alias("n_candidates"),
        (n > 1).alias("ambiguous"),
    )


def provisional(unresolved: DataFrame, entities: DataFrame) -> DataFrame:
    """New entities for mentions that no entity bears: id, label, type, aliases, provisional, and the normalised name ``norm``.

    ``unresolved`` has text, hint and seq.  Mentions of one normalised name and
    hint become one entity, labelled as first seen; blank mentions none.  An id
    that is taken gets the lowest free suffix from -2 on, in order of seq.
    Within one batch, mentions of one name with different hints make one
    entity per hint.
    """
    fresh = (
        unresolved.withColumn("label", F.btrim("text", F.lit(" \t\n\r"))).where("label <> ''").withColumn("norm", normalize(F.col("label")))
        .groupBy("norm", "hint").agg(F.min("seq").alias("seq"), F.min_by("label", F.struct("seq", "label")).alias("label"))
        .withColumn("base", entity_id(F.col("norm"), normalize(F.col("hint"))))
        .withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("seq", "label")))
    )
    numbered = F.regexp_extract("id", r"^(.*)-([0-9]{1,9})$", 1)
    number = F.regexp_extract("id", r"^(.*)-([0-9]{1,9})$", 2).try_cast("int")
    taken = (
        entities.select("id", F.explode(F.array(F.struct(F.col("id").alias("base"), F.lit(1).alias("n")), F.struct(numbered.alias("base"), number.alias("n")))).alias("t"))
        .select("t.*").where("base <> '' and n is not null and (n >= 2 or base is not null)").distinct()
        .join(fresh.select("base").distinct(), "base", "left_semi")
        # free numbers below the i-th taken one
        .withColumn("free", F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n")))
    )
    pushed = (
        fresh.join(taken, ["base"]).where("free < rank").groupBy("base", "rank").agg(F.count(F.lit(1)).alias("skip"))
    )
    return (
        fresh.join(pushed, ["base", "rank"], "left")
        .withColumn("n", F.col("rank") + F.coalesce("skip", F.lit(0)))
        .select(
            "seq", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("id"),
            "label", F.col("hint").alias("type"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("aliases"), F.lit(True).alias("provisional"), "norm",
        )
    )


def _typed(claims: DataFrame, ontology: Ontology | None) -> DataFrame:
    """Subject and object as mentions with the hint that applies; references and literals as they are."""
    if ontology is None:
        single, target, entity_range = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
        claims = claims.withColumns({"__domain": single, "__range": target, "__entity": entity_range})
    else:
        spark = claims.sparkSession
        p = ontology.predicate_table(spark).select(
            "predicate", F.when(F.size("domain") == 1, F.col("domain")[0]).alias("__domain"),
            F.when(F.col("range_kind") == "entity", F.col("range_name")).alias("__range"), (F.col("range_kind") == "entity").alias("__entity"),
        )
        claims = claims.join(p, "predicate", "left")
    s, o = F.col("subject"), F.col("object")
    subject = F.when(s["kind"].isin("mention", "string"), term("mention", s["text"], F.coalesce(s["hint"], F.col("__domain")))).otherwise(s)
    is_entity = (o["kind"] == "mention") | ((o["kind"] == "string") & F.coalesce(F.col("__entity"), F.lit(False)))
    object_ = F.when(is_entity, term("mention", o["text"], F.coalesce(o["hint"], F.col("__range")))).otherwise(o)
    return claims.withColumns({"subject": subject, "object": object_}).drop("__domain", "__range", "__entity")


def resolve_claims(
    claims: DataFrame, entities: DataFrame, ontology: Ontology | None = None, create: bool = True, resolver: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Claims with subject and object resolved to references, and the new provisional entities.

    ``claims`` has seq (unique), subject and object as terms, and predicate.
    The subject is always an entity; the object is one if it is a mention, or a
    string where the predicate's range is an entity type.  What stays
    unresolved stays a mention with its hint.  ``resolver`` takes the place of the
    built-in tiers: given text and hint it returns them with entity_id (null for
    none), and then nothing is created.
    """
    typed = _typed(claims, ontology)
    pairs = typed.select("seq", F.explode(F.array("subject", "object")).alias("t")).where("t.kind = 'mention'").select("seq", F.col("t.text").alias("text"), F.col("t.hint").alias("hint"))
    if resolver is not None:
        create = False
        found = resolver(pairs.select("text", "hint").distinct())
    else:
        found = resolve(pairs, entities, ontology)
    fresh = None
    links = found.select("text", "hint", "entity_id")
    if create:
        none = pairs.join(found.where("n_candidates = 0").select("text", F.col("hint").alias("hint2")), "text").where(F.col("hint").eqNullSafe(F.col("hint2"))).drop("hint2")
        fresh = provisional(none, entities)
        made = fresh.select(F.col("norm").alias("norm2"), F.col("type").alias("hint2"), F.col("id").alias("made"))
        links = (
            found.withColumn("norm", normalize(F.col("text")))
            .join(made, (F.col("norm") == F.col("norm2")) & F.col("hint").eqNullSafe(F.col("hint2")) & (F.col("n_candidates") == 0), "left")
            .select("text", "hint", F.coalesce("entity_id", "made").alias("entity_id"))
        )
    out = typed
    for side in ("subject", "object"):
        link = links.select(F.col("text").alias("__text"), F.coalesce("hint", F.lit("")).alias("__hint"), F.col("entity_id").alias("__id"))
        keyed = out.withColumns({
            "__text": F.when(F.col(side)["kind"] == "mention", F.col(side)["text"]), "__hint": F.coalesce(F.col(side)["hint"], F.lit("")),
        })
        out = skew_join(keyed, link, ["__text", "__hint"], F.col("seq"), "left")
        out = out.withColumn(side, F.when(F.col("__id").isNotNull(), term("ref", F.col("__id"))).otherwise(F.col(side))).drop("__text", "__hint", "__id")
    empty = entities.select("seq", "id", "label", "type", "aliases", "provisional").limit(0)
    return out, (fresh.drop("norm") if fresh is not None else empty)
