"""Exports: normalised tables, a property graph, and RDF triples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.temporal import precision, stripped
from factloom.functions.terms import decode, value_type
from factloom.operators.facts import first_seen_sources, sources_of
from factloom.skew import skew_join


def _kept(facts: DataFrame, include_superseded: bool) -> DataFrame:
    return facts if include_superseded else facts.where("status = 'active'")


def _iso(t: Column) -> Column:
    """ISO text of an instant in UTC, whatever the session's zone."""
    whole = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("+00:00"))


def fact_table(facts: DataFrame, include_superseded: bool = True) -> DataFrame:
    """Facts with the object split into entity id, or value and type, and the precision of the bounds."""
    t = decode(F.col("object_json"))
    is_ref = F.coalesce(F.col("t.kind") == "ref", F.lit(False))
    return _kept(facts, include_superseded).withColumn("t", t).select(
        "fact_id", "subject_id", "predicate",
        F.when(is_ref, F.col("t.text")).alias("object_entity_id"), F.when(~is_ref, F.col("t.text")).alias("object_value"), value_type(F.col("t")).alias("object_type"),
        stripped(F.col("valid_from")).alias("valid_from"), stripped(F.col("valid_to")).alias("valid_to"),
        precision(F.col("valid_from")).alias("valid_from_precision"), precision(F.col("valid_to")).alias("valid_to_precision"),
        "confidence", "status", _iso(F.col("recorded_at")).alias("recorded_at"), _iso(F.col("superseded_at")).alias("superseded_at"),
    )


def evidence_table(facts: DataFrame, evidence: DataFrame, include_superseded: bool = True) -> DataFrame:
    """Evidence of the exported facts."""
    kept = _kept(facts, include_superseded).select("fact_id").distinct()
    return skew_join(evidence, kept, ["fact_id"], F.col("position"), "left_semi").select(
        "fact_id", "position", "source_id", "locator", "quote", "confidence", "extractor", _iso(F.col("extracted_at")).alias("extracted_at")
    )


def qualifier_table(facts: DataFrame, include_superseded: bool = True) -> DataFrame:
    """fact_id, key, value and value_type of every qualifier; JSON that is no object has none."""
    entries = F.from_json("qualifiers_json", "map<string,string>")
    raw = _kept(facts, include_superseded).select("fact_id", "qualifiers_json", F.explode(entries).alias("key", "plain"))
    # the text of strings comes without its quotes from the map, so their type is read from the document
    is_text = F.get_json_object(F.concat(F.lit("["), "qualifiers_json", F.lit("]")), "$[0]").isNotNull() & F.col("plain").isNotNull() & ~F.col("plain").rlike(r"^(-?[0-9][0-9.eE+-]*|true|false|\{.*\}|\[.*\])$")
    t = decode(F.when(~is_text, F.col("plain")))
    return raw.withColumn("t", t).select(
        "fact_id", "key", F.when(is_text, F.col("plain")).otherwise(F.coalesce("t.text", "plain")).alias("value"),
        F.when(is_text, "string").otherwise(value_type(F.col("t"))).alias("value_type"),
    )


def entity_table(entities: DataFrame) -> DataFrame:
    return entities.select("id", "label", "type", "provisional")


def alias_table(entities: DataFrame) -> DataFrame:
    """entity_id and alias, each alias of an entity once, in order of both."""
    return entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct("aliases")).alias("alias")).orderBy("entity_id", "alias")


def source_table(sources: DataFrame) -> DataFrame:
    """The sources given; :func:`~factloom.operators.facts.first_seen_sources` has those that are cited."""
    return sources.select("id", "kind", "uri", "title", _iso(F.col("retrieved_at")).alias("retrieved_at"), "authority")


def conflict_table(conflicts: DataFrame) -> DataFrame:
    return conflicts.select("conflict_id", "fact_a", "fact_b", "subject_id", "predicate", _iso(F.col("detected_at")).alias("detected_at"), "policy", "winner")


#: What an edge or statement tells of its fact, beside its ends.
_ABOUT = ["predicate", "confidence", "valid_from", "valid_to"]


def _described(facts: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Facts with ``source_ids``, the different sources of their evidence by first position; without ``evidence`` there are none."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    if evidence is None:
        return facts.withColumn("source_ids", none)
    return skew_join(facts, sources_of(evidence), ["fact_id"], F.col("seq"), "left").withColumn("source_ids", F.coalesce("source_ids", none))


def _about() -> list[Column]:
    return [F.col("fact_id").alias("id"), *map(F.col, _ABOUT), F.col("qualifiers_json").alias("qualifiers"), F.col("source_ids"), F.col("status")]


def graph_edges(facts: DataFrame, include_superseded: bool = False, evidence: DataFrame | None = None) -> DataFrame:
    """Facts between entities: source, target, id, predicate, confidence, bounds, qualifiers, source_ids (of ``evidence``), status."""
    refs = _kept(facts, include_superseded).withColumn("t", decode(F.col("object_json"))).where("t.kind = 'ref'")
    return _described(refs, evidence).select(F.col("subject_id").alias("source"), F.col("t.text").alias("target"), *_about())


def graph_statements(facts: DataFrame, include_superseded: bool = False, evidence: DataFrame | None = None) -> DataFrame:
    """Facts with a plain value, with all that is known of them."""
    plain = _kept(facts, include_superseded).withColumn("t", decode(F.col("object_json"))).where("t.kind is null or t.kind <> 'ref'")
    return _described(plain, evidence).select(F.col("subject_id").alias("subject"), F.col("t.text").alias("value"), value_type(F.col("t")).alias("value_type"), *_about())


def graph_nodes(facts: DataFrame, entities: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Entities, and a stub (its id as label) for every subject or object that is none."""
    kept = _kept(facts, include_superseded)
    ends = kept.select(F.col("subject_id").alias("id")).unionByName(graph_edges(kept, True).select(F.col("target").alias("id"))).where("id is not null").distinct()
    known = entities.select("id", "label", "type", F.coalesce(F.array_sort("aliases"), F.expr("CAST(array() AS ARRAY<STRING>)")).alias("aliases"), "provisional")
    stubs = ends.join(known, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("type"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("aliases"), F.lit(False).alias("provisional"))
    return known.unionByName(stubs)


def node_properties(facts: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Plain values folded per subject and predicate: the JSON of one value, or of the list of several in the order of seq.

    Repeated values are kept.  Values gather per subject and predicate, as a
    property is one value of one node.
    """
    t = _kept(facts, include_superseded).withColumn("t", decode(F.col("object_json"))).where("t.kind is null or t.kind <> 'ref'")
    listed = t.groupBy("subject_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("seq", "fact_id", "object_json"))).alias("v"))
    many = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: F.coalesce(x["object_json"], F.lit("null"))), ", "), F.lit("]"))
    return listed.select("subject_id", "predicate", F.when(F.size("v") == 1, F.col("v")[0]["object_json"]).otherwise(many).alias("value"))


def tables(facts: DataFrame, evidence: DataFrame, sources: DataFrame, entities: DataFrame, conflicts: DataFrame, include_superseded: bool = True) -> dict[str, DataFrame]:
    """All seven normalised tables by name; the sources are those that any fact cites, and with the conflicts the same either way."""
    return {
        "entities": entity_table(entities), "aliases": alias_table(entities), "sources": source_table(first_seen_sources(facts, evidence, sources)), "facts": fact_table(facts, include_superseded),
        "evidence": evidence_table(facts, evidence, include_superseded), "qualifiers": qualifier_table(facts, include_superseded), "conflicts": conflict_table(conflicts),
    }


@dataclass(frozen=True)
class Graph:
    """A property graph; plain values are folded into ``properties`` (simple) or kept as ``statements`` (full)."""

    nodes: DataFrame
    edges: DataFrame
    properties: DataFrame | None
    statements: DataFrame | None

    def to_dict(self) -> dict[str, list[dict]]:
        """The parts as lists of dictionaries; for graphs that fit the driver."""
        parts = {n: getattr(self, n) for n in ("nodes", "edges", "properties", "statements")}
        return {n: [r.asDict(recursive=True) for r in part.collect()] for n, part in parts.items() if part is not None}

    def write(self, folder: str) -> None:
        """Each part as a Parquet table of ``folder``."""
        for name in ("nodes", "edges", "properties", "statements"):
            if (part := getattr(self, name)) is not None:
                part.write.parquet(f"{folder}/{name}")


def graph(facts: DataFrame, entities: DataFrame, mode: str = "simple", include_superseded: bool = False, evidence: DataFrame | None = None) -> Graph:
    """Nodes and edges, and plain values as properties (``simple``) or statements (``full``); ``evidence`` gives edges and statements their sources."""
    if mode not in ("simple", "full"):
        raise ValueError("mode must be simple or full")
    simple = mode == "simple"
    return Graph(
        graph_nodes(facts, entities, include_superseded), graph_edges(facts, include_superseded, evidence),
        node_properties(facts, include_superseded) if simple else None, None if simple else graph_statements(facts, include_superseded, evidence),
    )


# Names of RDF and XML Schema, and the datatypes by kind of value and precision of time.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"
XSD = "http://www.w3.org/2001/XMLSchema#"
DATATYPES = {"boolean": "boolean", "integer": "integer", "number": "double"}
TIME_DATATYPES = {"year": "gYear", "month": "gYearMonth", "day": "date", "instant": "dateTime"}


def _iri(base: str, kind: str, name: Column) -> Column:
    """Percent-encoded with no character spared but letters, digits and ``_.-~``."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"<{base}{kind}/"), encoded, F.lit(">"))


def _quoted(text: Column) -> Column:
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _literal(t: Column) -> Column:
    typed = lambda name: F.concat(_quoted(t["text"]), F.lit(f"^^<{XSD}{name}>"))
    out = F.when(t["kind"] == "string", _quoted(t["text"]))
    for kind, name in DATATYPES.items():
        out = out.when(t["kind"] == kind, typed(name))
    for p, name in TIME_DATATYPES.items():
        out = out.when((t["kind"] == "time") & (precision(t["text"]) == p), typed(name))
    return out.otherwise(_quoted(F.coalesce(t["text"], F.lit("null"))))


def ntriples(facts: DataFrame, entities: DataFrame, base: str = "urn:factloom:") -> DataFrame:
    """``line``: label and type of every entity, and one triple per active fact; null subjects make none."""
    subject = _iri(base, "entity", F.col("id"))
    labels = entities.where("id is not null and label is not null").select(F.concat_ws(" ", subject, F.lit(RDFS_LABEL), _quoted(F.col("label")), F.lit(".")).alias("line"))
    types = entities.where("id is not null and type <> ''").select(F.concat_ws(" ", subject, F.lit(RDF_TYPE), _iri(base, "type", F.col("type")), F.lit(".")).alias("line"))
    t = facts.where("status = 'active' and subject_id is not null and predicate is not null").withColumn("t", decode(F.col("object_json")))
    value = F.when(F.col("t.kind") == "ref", _iri(base, "entity", F.col("t.text"))).otherwise(_literal(F.col("t")))
    triples = t.select(F.concat_ws(" ", _iri(base, "entity", F.col("subject_id")), _iri(base, "predicate", F.col("predicate")), value, F.lit(".")).alias("line"))
    return labels.unionByName(types).unionByName(triples)
