"""Validation of claims: structure, time, ontology, custom rules, confidence.

Every rule is a column expression; the findings of a claim are an array of
(rule, severity, message), null rules dropped, in the order of the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions.temporal import earliest_second, is_naive
from factloom.functions.terms import claim_id, key
from factloom.operators.ontology import Ontology
from factloom.skew import skew_join

ERROR, WARNING, INFO = "error", "warning", "info"
ACCEPTED, REJECTED, REVIEW = "accepted", "rejected", "needs_review"


def finding(rule: str, severity: str | Column, message: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(message).alias("message"))


def _structure(n_evidence: Column | None) -> list[Column]:
    s, o = F.col("subject"), F.col("object")
    rules = [
        F.when(F.coalesce(F.btrim("predicate"), F.lit("")) == "", finding("predicate.empty", ERROR, "the predicate is empty")),
        F.when(s.isNull() | (s["kind"] != "ref"), finding("subject.unresolved", WARNING, F.concat(F.lit("unresolved subject "), F.coalesce(s["text"], F.lit(""))))),
        F.when(o.isNull(), finding("object.missing", ERROR, "the object is missing")),
        F.when(o["kind"] == "mention", finding("object.unresolved", WARNING, F.concat(F.lit("unresolved object "), o["text"]))),
    ]
    if n_evidence is not None:
        rules.append(F.when(F.coalesce(n_evidence, F.lit(0)) <= 0, finding("provenance.missing", ERROR, "no evidence")))
    return rules


#: Read once per claim and dropped again: the bounds' first second, whether they lack a zone, and whether they cannot be read.
_BOUNDS = {"valid_from": "__from", "valid_to": "__to"}


def _with_bounds(claims: DataFrame) -> DataFrame:
    columns = {}
    for bound, name in _BOUNDS.items():
        c = F.col(bound)
        columns |= {f"{name}_at": earliest_second(c), f"{name}_naive": F.coalesce(is_naive(c), F.lit(False))}
    return claims.withColumns(columns)


def _time() -> list[Column]:
    naive, unread = [], []
    for bound, name in _BOUNDS.items():
        naive.append(F.when(F.col(f"{name}_naive"), finding("time.naive", ERROR, F.concat(F.lit(f"{bound} has no time zone: "), bound))))
        lost = F.col(bound).isNotNull() & ~F.col(f"{name}_naive") & F.col(f"{name}_at").isNull()
        unread.append(F.when(lost, finding("time.invalid", ERROR, F.concat(F.lit(f"{bound} is no time: "), bound))))
    empty = ~F.col("__from_naive") & ~F.col("__to_naive") & (F.col("__to_at") <= F.col("__from_at"))
    return [*naive, *unread, F.when(empty, finding("time.empty_interval", ERROR, "valid_to is not after valid_from"))]


def _type_check(role: str, rule: str, id_: Column, type_: Column, known: Column, allowed: Column, registry: bool) -> Column:
    if not registry:
        return finding(rule, INFO, f"type of the {role} not checked")
    return (
        F.when(~known, finding(f"{role}.unknown_entity", WARNING, F.concat(F.lit("no such entity: "), id_)))
        .when(type_.isNull(), finding(rule, WARNING, F.concat(F.lit("entity without a type: "), id_)))
        .when(~F.array_contains(allowed, type_), finding(rule, ERROR, F.concat(F.lit("wrong type "), type_, F.lit(" of "), id_)))
    )


def _ontology(strict: bool, registry: bool) -> list[Column]:
    s, o = F.col("subject"), F.col("object")
    defined = F.col("cardinality").isNotNull()
    literal = F.col("range_kind") == "literal"
    entity = F.col("range_kind") == "entity"
    fits = (
        F.when(F.col("range_name") == "number", o["kind"].isin("integer", "number"))
        .otherwise(o["kind"] == F.col("range_name"))
    )
    concrete = o.isNotNull() & (o["kind"] != "mention")
    return [
        F.when(~defined & (F.coalesce(F.btrim("predicate"), F.lit("")) != ""), finding("schema.unknown_predicate", ERROR if strict else INFO, F.concat(F.lit("undefined predicate "), "predicate"))),
        F.when(defined & (F.col("temporal") == "moment") & F.col("valid_to").isNotNull(), finding("schema.moment_with_end", ERROR, "a moment has no end")),
        F.when(defined & (F.size("domain") > 0) & (s["kind"] == "ref"), _type_check("subject", "schema.domain", s["text"], F.col("s_type"), F.col("s_known"), F.col("domain_types"), registry)),
        F.when(literal & concrete & ~fits, finding("schema.range", ERROR, F.concat(F.lit("not a "), "range_name", F.lit(": "), o["text"]))),
        F.when(entity & (o["kind"] == "ref"), _type_check("object", "schema.range", o["text"], F.col("o_type"), F.col("o_known"), F.col("range_types"), registry)),
        F.when(entity & (o["kind"] == "string"), finding("object.unresolved", WARNING, F.concat(F.lit("unresolved object "), o["text"]))),
        F.when(entity & concrete & ~o["kind"].isin("ref", "string"), finding("schema.range", ERROR, F.concat(F.lit("not an entity: "), o["text"]))),
    ]


def validate(
    claims: DataFrame,
    ontology: Ontology | None = None,
    entities: DataFrame | None = None,
    rules: Sequence[Callable[[], Column]] = (),
    accept_at: float = 0.5,
    reject_below: float = 0.2,
    require_evidence: bool = True,
    combine: Callable[[Column], Column] = C.noisy_or_array,
    weighed: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Add confidence, findings, status and, on acceptance, fact_id.

    ``claims``: seq, subject and object (terms), predicate, evidence
    (ARRAY<STRUCT> with confidence and authority), valid_from, valid_to (text),
    qualifiers (MAP<STRING, TERM>).  ``rules`` build columns that are null or a
    :func:`finding`.  ``combine`` makes the confidence of the evidence array;
    ``weighed`` gives confidence and number of pieces of evidence instead, where
    they were aggregated before and no array need be built.

    Any error rejects, else any warning asks for review, else the claim is
    accepted; unknown confidence is only noted.  Null columns give the findings
    that say so; nothing raises on data.
    """
    if reject_below > accept_at:
        raise ValueError("reject_below must not exceed accept_at")
    out = _with_bounds(claims)
    n_evidence = weighed[1] if weighed else F.size("evidence")
    found = _structure(n_evidence if require_evidence else None) + _time()
    if ontology is not None:
        out = out.join(ontology.predicate_table(claims.sparkSession), "predicate", "left")
        if entities is not None:
            # one aggregate of the entities, whose exchange both sides use
            types = entities.where("id is not null").groupBy("id").agg(F.min("type").alias("type"))
            for side, name in (("s", "subject"), ("o", "object")):
                of_side = types.select(F.col("id").alias(f"{side}_id"), F.col("type").alias(f"{side}_type"), F.lit(True).alias(f"{side}_known"))
                out = out.withColumn(f"{side}_id", F.when(F.col(name)["kind"] == "ref", F.col(name)["text"]))
                out = skew_join(out, of_side, [f"{side}_id"], F.col("seq"), "left").withColumn(f"{side}_known", F.coalesce(F.col(f"{side}_known"), F.lit(False)))
        else:
            out = out.withColumns({f"{s}_{n}": F.lit(None).cast(t) for s in "so" for n, t in (("type", "string"), ("known", "boolean"))})
        found += _ontology(ontology.strict, entities is not None)
    found += [rule() for rule in rules]
    out = out.withColumn("confidence", weighed[0] if weighed else combine(F.col("evidence")))
    c = F.col("confidence")
    found += [
        F.when(c.isNull(), finding("confidence.unknown", INFO, "confidence is unknown")),
        F.when(c < reject_below, finding("confidence.too_low", ERROR, F.concat(F.lit("confidence "), F.round(c, 4).cast("string")))),
        F.when((c >= reject_below) & (c < accept_at), finding("confidence.below_accept", WARNING, F.concat(F.lit("confidence "), F.round(c, 4).cast("string")))),
    ]
    out = out.withColumn("findings", F.filter(F.array(*found), lambda f: f.isNotNull()))
    has = lambda s: F.exists("findings", lambda f: f["severity"] == s)
    out = out.withColumn("status", F.when(has(ERROR), REJECTED).when(has(WARNING), REVIEW).otherwise(ACCEPTED))
    out = out.withColumn(
        "fact_id",
        F.when(F.col("status") == ACCEPTED, claim_id(key(F.col("subject")), F.col("predicate"), key(F.col("object")), F.col("valid_from"), F.col("valid_to"), F.col("qualifiers"))),
    )
    helpers = ["domain", "domain_types", "range_name", "range_kind", "range_types", "cardinality", "temporal", *[f"{s}_{n}" for s in "so" for n in ("id", "type", "known")], *[f"{n}_{k}" for n in _BOUNDS.values() for k in ("at", "naive")]]
    return out.drop(*helpers)


def reasons(findings: Column) -> Column:
    """Messages of the findings that are no mere notes, in order."""
    return F.transform(F.filter(findings, lambda f: f["severity"] != INFO), lambda f: f["message"])
