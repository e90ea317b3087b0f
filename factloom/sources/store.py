"""A fact store in a folder: immutable snapshots of its tables and a pointer to the current one.

A commit writes all tables into a new snapshot and then replaces the pointer
in one rename, so readers see the old state or the new, never a mixture, and a
failed commit leaves nothing behind that counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ontology import Ontology
from factloom.sources.backend import TABLES, Backend

FORMAT = "1"
#: Columns that queries filter by; files are sorted by them so that Parquet statistics skip row groups.
SORTED_BY = {"facts": ["predicate", "subject_id"], "evidence": ["fact_id"], "entities": ["id"], "conflicts": ["subject_id"], "sources": ["id"]}


class Store(Backend):
    """Open or create a store; ``ontology`` is kept in it and restored when opened without one."""

    def __init__(self, spark: SparkSession, folder: str, ontology: Ontology | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self._read("CURRENT")
        if meta is not None:
            if meta["format"] != FORMAT:
                raise ValueError(f"store format {meta['format']!r} is not {FORMAT!r}")
            self.snapshot: str | None = meta["snapshot"]
            self.ontology = ontology or (Ontology.from_dict(meta["ontology"]) if meta["ontology"] else None)
        else:
            self.snapshot, self.ontology = None, ontology

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame | None:
        """A table of the current snapshot; None if it was never committed."""
        if name not in TABLES:
            raise KeyError(name)
        if self.snapshot is None or not self._fs.exists(self._path(f"{self.snapshot}/{name}")):
            return None
        return self.spark.read.parquet(f"{self.folder}/{self.snapshot}/{name}")

    def commit(self, **tables: DataFrame) -> str:
        """Write a new snapshot with ``tables``; those not given are taken from the current one.  Returns its name."""
        if unknown := set(tables) - set(TABLES):
            raise KeyError(f"no tables {sorted(unknown)}")
        name = f"snapshot-{uuid.uuid4().hex}"
        try:
            for t in TABLES:
                df = tables.get(t)
                if df is None:
                    df = self.table(t)
                if df is not None:
                    keys = [F.col(c) for c in SORTED_BY[t]]
                    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.folder}/{name}/{t}")
        except BaseException:
            self._fs.delete(self._path(name), True)
            raise
        self._point(name)
        return name

    def _point(self, snapshot: str) -> None:
        meta = {"format": FORMAT, "snapshot": snapshot, "ontology": self.ontology.to_dict() if self.ontology else None}
        fresh = self._path(f"CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(fresh)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = overwrite
        context.rename(fresh, self._path("CURRENT"), kinds)
        self.snapshot = snapshot


def upsert(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; ``new`` has each key once."""
    return new if old is None else old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)
