"""Claim values as one tagged column, their identity keys and their JSON form.

A term is STRUCT<kind, text, hint>: kind is ref, mention, string, integer,
number, boolean, time or json; text is the canonical text (entity id, mention,
digits, true/false, ISO time, JSON); hint is the type of a mention.  Values of
different kinds are different claims even if they read the same.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text", "hint")])
TERM_DDL = "STRUCT<kind: STRING, text: STRING, hint: STRING>"

# How the kinds are named in identity keys and in exports.
KEY_PREFIX = {"ref": "ref", "mention": "mention", "string": "str", "integer": "int", "number": "float", "boolean": "bool", "time": "time", "json": "json"}
VALUE_TYPE = {"ref": "entity", "mention": "mention", "string": "string", "integer": "integer", "number": "number", "boolean": "boolean", "time": "time", "json": "json"}


def term(kind: Column | str, text: Column, hint: Column | None = None) -> Column:
    """A term column; null text gives a null term."""
    made = F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.cast("string").alias("text"),
        (hint if hint is not None else F.lit(None)).cast("string").alias("hint"),
    )
    return F.when(text.isNotNull(), made)


def ref(id_: Column) -> Column:
    return term("ref", id_)


def mention(text: Column, hint: Column | None = None) -> Column:
    return term("mention", text, hint)


def literal(value: Any) -> tuple[str, str, None] | None:
    """The term of a Python value; None for None."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("boolean", "true" if value else "false", None)
    if isinstance(value, int):
        return ("integer", str(value), None)
    if isinstance(value, float):
        return ("number", repr(value), None)
    if isinstance(value, str):
        return ("string", value, None)
    if isinstance(value, (date, datetime)):
        return ("time", value.isoformat(), None)
    if isinstance(value, (list, tuple, dict)):
        return ("json", json.dumps(value, sort_keys=True, default=str), None)
    raise TypeError(f"no claim value: {type(value).__name__}")


def _mapped(kind: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[kind]


def key(t: Column) -> Column:
    """Identity key such as ``ref:place:boston`` or ``int:1706``; ``none`` for null."""
    return F.coalesce(F.concat(_mapped(t["kind"], KEY_PREFIX), F.lit(":"), t["text"]), F.lit("none"))


def value_type(t: Column) -> Column:
    return F.coalesce(_mapped(t["kind"], VALUE_TYPE), F.lit("json"))


def encode(t: Column) -> Column:
    """JSON text with tags for references and times; null for null."""
    tagged = lambda tag: F.to_json(F.struct(t["text"].alias(tag)))
    quote = lambda: F.regexp_replace(F.to_json(F.struct(t["text"].alias("v"))), r"^\{\"v\":|\}$", "")
    kind = t["kind"]
    return (
        F.when(kind == "ref", tagged("$ref")).when(kind == "mention", tagged("$mention")).when(kind == "time", tagged("$time"))
        .when(kind == "string", quote()).when(t.isNotNull(), t["text"])
    )


def decode(text: Column) -> Column:
    """The term of tagged JSON text; null for null, for JSON null and for text that is no JSON."""
    tags = F.from_json(text, "`$ref` STRING, `$mention` STRING, `$time` STRING, `$date` STRING, `$datetime` STRING, `$dict` STRING")
    trimmed = F.btrim(text)
    whole = F.get_json_object(F.concat(F.lit("["), trimmed, F.lit("]")), "$[0]")
    when = F.coalesce(tags["$time"], tags["$date"], tags["$datetime"])
    return (
        F.when(trimmed.isNull() | (trimmed == "null") | whole.isNull(), F.lit(None))
        .when(trimmed.rlike(r"^\{") & tags["$ref"].isNotNull(), term("ref", tags["$ref"]))
        .when(trimmed.rlike(r"^\{") & tags["$mention"].isNotNull(), term("mention", tags["$mention"]))
        .when(trimmed.rlike(r"^\{") & when.isNotNull(), term("time", when))
        .when(trimmed.rlike(r"^\{") & tags["$dict"].isNotNull(), term("json", tags["$dict"]))
        .when(trimmed.rlike(r"^-?[0-9]+$"), term("integer", trimmed))
        .when(trimmed.rlike(r"^-?[0-9][0-9.eE+-]*$"), term("number", trimmed))
        .when(trimmed.isin("true", "false"), term("boolean", trimmed))
        .when(trimmed.rlike(r'^"'), term("string", whole))
        .otherwise(term("json", whole))
    )


def claim_id(subject: Column, predicate: Column, object_: Column, valid_from: Column, valid_to: Column, qualifiers: Column) -> Column:
    """A stable id of what is claimed, without its evidence: ``fact:`` and 16 hex digits.

    subject and object are keys, the bounds ISO text or null, qualifiers a
    MAP<STRING, TERM> (null counts as empty).  Equal claims have equal ids
    whatever the order of their qualifiers.
    """
    details = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(F.coalesce(qualifiers, F.expr(f"CAST(map() AS MAP<STRING, {TERM_DDL}>)")))),
            lambda e: F.concat(e["key"], F.lit("="), key(e["value"])),
        ),
        "\x1f",
    )
    parts = F.concat_ws("\x1f", subject, predicate, object_, F.coalesce(valid_from, F.lit("none")), F.coalesce(valid_to, F.lit("none")), details)
    return F.concat(F.lit("fact:"), F.substring(F.sha2(parts, 256), 1, 16))
