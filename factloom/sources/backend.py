"""What a place for the tables of a store must offer, one in memory, and a registry of entities that writes through to either."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.lineage import cut
from factloom.operators import registry as G
from factloom.operators.ontology import Ontology

TABLES = ("facts", "evidence", "sources", "entities", "conflicts")


class Backend(ABC):
    """Holds the tables of one store; a subclass says how a table is read and how a set of tables replaces the current one at once."""

    spark: SparkSession
    ontology: Ontology | None

    @abstractmethod
    def table(self, name: str) -> DataFrame | None:
        """A table as last committed, None before that; KeyError for a name not in ``TABLES``."""

    @abstractmethod
    def commit(self, **tables: DataFrame) -> str:
        """Replace the given tables, all or none, and keep the others; returns a name for the new state."""


class MemoryStore(Backend):
    """Tables of one session, kept as written copies in the shared folder, so that lost executors cost nothing."""

    def __init__(self, spark: SparkSession, ontology: Ontology | None = None) -> None:
        self.spark, self.ontology = spark, ontology
        self._tables: dict[str, DataFrame] = {}
        self._commits = 0

    def table(self, name: str) -> DataFrame | None:
        if name not in TABLES:
            raise KeyError(name)
        return self._tables.get(name)

    def commit(self, **tables: DataFrame) -> str:
        if unknown := set(tables) - set(TABLES):
            raise KeyError(f"no tables {sorted(unknown)}")
        self._tables = self._tables | {name: cut(df) for name, df in tables.items()}
        self._commits += 1
        return f"commit-{self._commits}"


class Registry:
    """The entities of a backend: read when opened, written with every change."""

    def __init__(self, backend: Backend) -> None:
        self.backend = backend
        held = backend.table("entities")
        self.entities = held if held is not None else backend.spark.createDataFrame([], G.ENTITIES)

    def get(self, entity_id: str) -> DataFrame:
        return G.get(self.entities, entity_id)

    def __contains__(self, entity_id: str) -> bool:
        return not self.get(entity_id).isEmpty()

    def __len__(self) -> int:
        return self.entities.count()

    def provisional(self) -> DataFrame:
        return G.provisional(self.entities)

    def add(self, new: DataFrame) -> DataFrame:
        """Add entities; returns the rows refused (see :func:`~factloom.operators.registry.add`)."""
        entities, refused = G.add(self.entities, new)
        refused = cut(refused)
        self._put(lambda _: entities)
        return refused

    def add_aliases(self, aliases: DataFrame) -> None:
        self._put(lambda held: G.add_aliases(held, aliases))

    def confirm(self, ids: DataFrame) -> None:
        self._put(lambda held: G.confirm(held, ids))

    def _put(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.backend.commit(entities=change(self.entities))
        self.entities = self.backend.table("entities")
