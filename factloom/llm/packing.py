"""Packing documents whole into containers of a few permitted capacities.

Variable-capacity best fit, longest first: a piece goes into the open container
with the least room that still holds it; if none does, the permitted capacity
of least cost is opened; in the end every container shrinks to the cheapest
capacity that holds its contents.

The plan depends on sizes alone.  The sizes are counted in a histogram, which
has at most as many entries as the largest capacity, whatever the number of
documents, and the plan is made from it for runs of equal containers at once.
It says for the k-th piece of each size into which container it goes and where.
The pieces take these places in parallel: they are numbered within their size,
in salted parts, so a size shared by a third of all documents is no hot spot.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that one task numbers at a time.
PART = 500_000


@dataclass(frozen=True)
class Run:
    """``count`` containers from ``first`` on that have the same contents."""

    first: int
    count: int
    capacity: int


class Plan:
    """Places for a histogram of sizes; ``costs`` maps each permitted capacity to the cost of a container."""

    def __init__(self, histogram: Mapping[int, int], costs: Mapping[int, float]) -> None:
        self.costs = dict(costs)
        self.rooms: list[int] = []  # the different rooms left, ascending
        self.open: dict[int, list[Run]] = {}
        self.places: list[tuple[int, int, int, int, int]] = []  # size, rank from, container from, start, count
        self.containers = 0
        for size in sorted(histogram, reverse=True):
            self._place(size, histogram[size])
        self._downsize()

    def _put(self, room: int, run: Run) -> None:
        if room not in self.open:
            insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append(run)

    def _take(self, room: int, most: int) -> Run:
        runs = self.open[room]
        run = runs.pop()
        if run.count > most:
            runs.append(Run(run.first + most, run.count - most, run.capacity))
            run = Run(run.first, most, run.capacity)
        if not runs:
            del self.open[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def _place(self, size: int, count: int) -> None:
        rank = 0
        while rank < count:
            at = bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                run = self._take(room, count - rank)
            else:
                capacity = min((c for c in self.costs if c >= size), key=lambda c: (self.costs[c], c))
                # a new container takes this size until it is full, before the next is opened
                run, room = Run(self.containers, -(-(count - rank) // (capacity // size)), capacity), capacity
                self.containers += run.count
            self.places.append((size, rank, run.first, run.capacity - room, run.count))
            rank += run.count
            self._put(room - size, run)

    def _downsize(self) -> None:
        """The final capacity of each run of containers: ``self.final`` has (first, count, capacity, used)."""
        self.final = sorted(
            (run.first, run.count, min((c for c in self.costs if c >= run.capacity - room), key=lambda c: (self.costs[c], c)), run.capacity - room)
            for room, runs in self.open.items()
            for run in runs
        )


@dataclass(frozen=True)
class Packing:
    """assignment: the pieces in their containers; containers: runs of equal containers with capacity and contents."""

    assignment: DataFrame
    containers: DataFrame


def _pieces(sized: DataFrame, key: str, largest: int) -> DataFrame:
    """One row per document, or several for a document longer than the largest container."""
    n = F.ceil(F.col("tokens") / largest).cast("int")
    return (
        sized.where("tokens > 0")
        .select(key, "tokens", n.alias("n_pieces"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .select(
            key, "piece", "n_pieces",
            F.least(F.lit(largest).cast("long"), F.col("tokens") - F.col("piece").cast("long") * largest).alias("size"),
        )
    )


def pack(sized: DataFrame, bins: Sequence[tuple[str, int]], key: str = "doc_id", costs: Mapping[str, float] | None = None) -> Packing:
    """Assign every document with tokens to containers of the kinds ``bins`` (name, capacity).

    ``sized`` has ``key`` (unique) and ``tokens``; take one that is already
    written, for it is read twice.  A container costs its capacity unless
    ``costs`` names another figure.  Only documents longer than the largest
    capacity are divided, into full pieces and a rest.

    assignment: key, piece, n_pieces, size, container, start (token offset in
    the container), bin_name.  Documents of zero or null tokens need no
    container and are left out; negative or zero capacities are an error; ties
    are placed in the order of the key.  An empty table gives an empty result.
    """
    if not bins or min(c for _, c in bins) < 1:
        raise ValueError("a container needs a capacity of at least one token")
    spark = sized.sparkSession
    name_of = {c: n for n, c in sorted(bins, reverse=True)}
    pieces = _pieces(sized, key, max(name_of))
    # at most as many rows as the largest capacity
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, {c: (costs or {}).get(n, c) for c, n in name_of.items()})

    salts = max(1, -(-max(histogram.values(), default=1) // PART))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    offsets = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "size", "salt",
        F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "piece")) - 1)
        .join(offsets, ["size", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )

    # the plan's places: their number follows from the capacities, not from the documents
    table = np.array(sorted(plan.places), dtype=np.int64).reshape(-1, 5)
    final = np.array(plan.final, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table, final))

    @F.pandas_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("start", T.LongType()), T.StructField("capacity", T.LongType())]))
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        places, runs = shared.value
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(size), dtype=np.int64)
        for one in np.unique(size):
            low, high = np.searchsorted(places[:, 0], [one, one + 1])
            mine = size == one
            at[mine] = low + np.searchsorted(places[low:high, 1], rank[mine], side="right") - 1
        container = places[at, 2] + rank - places[at, 1]
        run = np.searchsorted(runs[:, 0], container, side="right") - 1
        return pd.DataFrame({"container": container, "start": places[at, 3], "capacity": runs[run, 2]})

    names = F.create_map(*[F.lit(x) for c, n in name_of.items() for x in (c, n)])
    assignment = (
        ranked.withColumn("p", place("size", "rank"))
        .select(key, "piece", "n_pieces", "size", "p.*")
        .withColumn("bin_name", names[F.col("capacity").cast("int")])
        .drop("capacity")
    )
    containers = spark.createDataFrame(
        [(name_of[c], int(first), int(n), int(c), int(used)) for first, n, c, used in plan.final],
        "bin_name string, first long, containers long, capacity long, used long",
    )
    return Packing(assignment, containers)


def too_long(packing: Packing, bins: Sequence[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """bin_name and ``key``: for each kind of container the documents that a packing could not put whole into one of that kind.

    Read off the places the packing gave: a document whose pieces lie in several
    containers is too long for every kind; one whose container stayed of a larger
    kind than the one in question, even after downsizing, may be, and its size
    settles that.  Kinds of equal capacity each get their rows; documents
    without tokens get none.
    """
    capacities = F.create_map(*[F.lit(x) for n, c in bins for x in (n, c)])
    placed = packing.assignment.groupBy(key).agg(
        F.min("container").alias("first"), F.max("container").alias("last"), F.max(capacities[F.col("bin_name")]).alias("room"), F.sum("size").alias("tokens"),
    )
    kinds = placed.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("bin_name"), F.lit(c).alias("capacity")) for n, c in bins])).alias("k"))
    return kinds.where(
        ((F.col("first") < F.col("last")) | (F.col("room") > F.col("k.capacity"))) & (F.col("tokens") > F.col("k.capacity"))
    ).select("k.bin_name", key)


def fill(packing: Packing) -> DataFrame:
    """Per kind of container: how many, their capacity and contents in tokens, and the share of room used."""
    return packing.containers.groupBy("bin_name").agg(
        F.sum("containers").alias("containers"),
        F.sum(F.col("containers") * F.col("capacity")).alias("capacity"),
        F.sum(F.col("containers") * F.col("used")).alias("used"),
    ).withColumn("share_used", F.col("used") / F.col("capacity"))

