"""Entity types with single inheritance, predicates, and their tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The names of plain values in ranges, and the choices of a predicate.
LITERALS = ("string", "integer", "number", "boolean", "time")
CARDINALITIES = ("one", "many")
TEMPORALS = ("span", "moment")


@dataclass(frozen=True)
class EntityType:
    name: str
    parent: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Predicate:
    """domain: types a subject may have (none: any); range: a type, a literal name or None for anything."""

    name: str
    domain: tuple[str, ...] = ()
    range: str | None = None
    cardinality: str = "many"
    temporal: str = "span"
    description: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "domain", tuple([self.domain] if isinstance(self.domain, str) else self.domain))  # one type may be given as text
        if self.cardinality not in CARDINALITIES or self.temporal not in TEMPORALS:
            raise ValueError(f"{self.name!r}: cardinality is one of {CARDINALITIES} and temporal one of {TEMPORALS}")

    @property
    def range_kind(self) -> str | None:
        return None if self.range is None else "literal" if self.range in LITERALS else "entity"


@dataclass
class Ontology:
    """What may be claimed; ``strict`` refuses predicates that are not defined."""

    types: dict[str, EntityType] = field(default_factory=dict)
    predicates: dict[str, Predicate] = field(default_factory=dict)
    strict: bool = False

    def add_type(self, entity_type: EntityType) -> EntityType:
        name, parent = entity_type.name, entity_type.parent
        if name in self.types:
            raise ValueError(f"type {name!r} is defined already")
        if name in LITERALS:
            raise ValueError(f"{name!r} names a plain value")
        if parent is not None and parent not in self.types:
            raise ValueError(f"define {parent!r} before its subtype {name!r}")
        self.types[name] = entity_type
        return entity_type

    def add_predicate(self, predicate: Predicate) -> Predicate:
        if predicate.name in self.predicates:
            raise ValueError(f"predicate {predicate.name!r} is defined already")
        used = [*predicate.domain, *([predicate.range] if predicate.range_kind == "entity" else [])]
        if unknown := [t for t in used if t not in self.types]:
            raise ValueError(f"predicate {predicate.name!r} uses undefined types {unknown}")
        self.predicates[predicate.name] = predicate
        return predicate

    def predicate(self, name: str) -> Predicate | None:
        return self.predicates.get(name)

    def ancestors(self, name: str) -> tuple[str, ...]:
        """The type itself and its parents up to the root; an undefined type has none."""
        known = self.types.get(name)
        return (name,) if known is None or known.parent is None else (name, *self.ancestors(known.parent))

    def is_a(self, name: str, ancestor: str) -> bool:
        return ancestor in self.ancestors(name)

    def is_any(self, name: str, candidates: Iterable[str]) -> bool:
        return not set(candidates).isdisjoint(self.ancestors(name))

    def to_dict(self) -> dict:
        return {
            "strict": self.strict,
            "entity_types": [asdict(t) for t in self.types.values()],
            "predicates": [asdict(p) | {"domain": list(p.domain)} for p in self.predicates.values()],
        }

    @classmethod
    def from_dict(cls, data: dict) -> Ontology:
        out = cls(strict=bool(data.get("strict")))
        for t in data.get("entity_types", ()):
            out.add_type(EntityType(**t))
        for p in data.get("predicates", ()):
            out.add_predicate(Predicate(**p))
        return out

    def to_json(self, **options) -> str:
        return json.dumps(self.to_dict(), **options)

    @classmethod
    def from_json(cls, text: str) -> Ontology:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_tables(cls, predicates: DataFrame, entity_types: DataFrame, strict: bool = False) -> Ontology:
        """From the tables that declare it: predicates (name, domain, value_range, cardinality, temporal) and types (name, parent)."""
        out = cls(strict=strict)
        waiting = {r["name"]: r["parent"] for r in entity_types.collect()}
        while waiting:
            ready = [n for n, p in waiting.items() if p is None or p in out.types]
            if not ready:
                raise ValueError(f"types without a defined parent: {sorted(waiting)}")
            for name in ready:
                out.add_type(EntityType(name, waiting.pop(name)))
        for r in predicates.collect():
            out.add_predicate(Predicate(r["name"], tuple(r["domain"] or ()), r["value_range"], r["cardinality"], r["temporal"]))
        return out

    def closure(self, spark: SparkSession) -> DataFrame:
        """type_name and each of its ancestors, itself included."""
        rows = [(t, a) for t in self.types for a in self.ancestors(t)]
        return spark.createDataFrame(rows, "type_name string, ancestor string")

    def predicate_table(self, spark: SparkSession) -> DataFrame:
        """One row per predicate, with ``allowed``: every type or subtype its domain admits, and likewise for its range."""
        below = lambda names: sorted(t for t in self.types if self.is_any(t, names))
        rows = [
            (p.name, list(p.domain), below(p.domain), p.range, p.range_kind, below([p.range]) if p.range_kind == "entity" else [], p.cardinality, p.temporal)
            for p in self.predicates.values()
        ]
        return spark.createDataFrame(
            rows,
            "predicate string, domain array<string>, domain_types array<string>, range_name string, range_kind string, range_types array<string>, cardinality string, temporal string",
        )
