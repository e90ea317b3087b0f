"""Continuous periods and gaps of the intervals of each group.

Starts and ends are ranked independently of each other within a group.  The
next start s(i+1) lies beyond the i-th end e(i) exactly when as many intervals
have ended by e(i) as have begun, so a gap runs from e(i) to s(i+1), and the
boundaries that are left over pair up to the continuous periods.

Ranks are not taken in one task per group.  Equal boundaries are first counted
(with map-side combine), then ranked within a group's *day*, of which there
are at most 86,400 different seconds, and the days' totals are summed over the
at most 3.7 million days of a group.  Both bounds hold for any data, so a
group with a third of all rows is spread like every other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.temporal import AFTER_ALL, BEFORE_ALL
from factloom.lineage import cut
from factloom.skew import skew_join

#: Stand-ins for open bounds; they lie outside every valid second.
NO_START, NO_END = BEFORE_ALL, AFTER_ALL


def _ranked_boundaries(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Per group, kind (0 start, 1 end) and second ``t``: its count ``n`` and the rank ``upto`` of the last of them."""
    keys = list(keys)
    boundaries = intervals.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.coalesce(F.col(start), F.lit(NO_START)).alias("t")),
                F.struct(F.lit(1).alias("kind"), F.coalesce(F.col(end), F.lit(NO_END)).alias("t")),
            )
        ).alias("b"),
    )
    group = [f"k{i}" for i in range(len(keys))] + ["kind"]
    # written once: starts and ends, their ranks and the days' totals all read it
    counted = cut(
        boundaries.select(*group[:-1], "b.*")
        .groupBy(*group, "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("day", F.floor(F.col("t") / 86400))
    )
    in_day = Window.partitionBy(*group, "day").orderBy("t")
    days = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counted.groupBy(*group, "day").agg(F.sum("n").alias("of_day"))
        .withColumn("before", F.coalesce(F.sum("of_day").over(days), F.lit(0)))
        .drop("of_day")
    )
    return (
        counted.withColumn("in_day", F.sum("n").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
        .join(before, [*group, "day"])
        .select(*group, "t", "n", (F.col("before") + F.col("in_day")).alias("upto"))
    )


def _cuts(ranked: DataFrame, group: Sequence[str]) -> DataFrame:
    """Gaps: the end run whose last rank is i beside the start run whose first rank is i + 1, where the start is later."""
    ends = ranked.where("kind = 1").select(*group, F.col("upto").alias("rank"), F.col("t").alias("gap_from"))
    starts = ranked.where("kind = 0").select(*group, (F.col("upto") - F.col("n")).alias("rank"), F.col("t").alias("gap_to"))
    return ends.join(starts, [*group, "rank"]).where("gap_to > gap_from")


def gaps(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The stretches between the first start and the last end of each group that no interval covers.

    ``start`` and ``end`` are seconds (BIGINT), half-open, null for unbounded.
    Returns ``keys``, gap_from, gap_to, one row per gap.

    Rows whose end is not after their start count as no interval and are left
    out.  Null keys form no group.  Repeated rows, ties, touching and nested
    intervals leave no gap; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    valid = intervals.where(
        (F.coalesce(F.col(end), F.lit(NO_END)) > F.coalesce(F.col(start), F.lit(NO_START)))
    ).dropna(subset=list(keys))
    group = [f"k{i}" for i in range(len(keys))]
    cuts = _cuts(_ranked_boundaries(valid, keys, start, end), group)
    return cuts.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], "gap_from", "gap_to")


def periods(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The continuous periods of each group: ``keys``, period_no, start, end; null where unbounded.

    Period k runs from the k-th to the k-th of the boundaries at gaps: its start
    is the group's first start or a gap's end, its end the next gap's start or
    the group's last end.  Edge cases are those of :func:`gaps`.
    """
    valid = intervals.where(
        (F.coalesce(F.col(end), F.lit(NO_END)) > F.coalesce(F.col(start), F.lit(NO_START)))
    ).dropna(subset=list(keys))
    group = [f"k{i}" for i in range(len(keys))]
    cuts = _cuts(_ranked_boundaries(valid, keys, start, end), group)
    outer = valid.groupBy(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)]).agg(
        F.min(F.coalesce(F.col(start), F.lit(NO_START))).alias("first"),
        F.max(F.coalesce(F.col(end), F.lit(NO_END))).alias("last"),
    )
    begin = _numbered(cuts.select(*group, F.col("gap_to").alias("t")).unionByName(outer.select(*group, F.col("first").alias("t"))), group)
    stop = _numbered(cuts.select(*group, F.col("gap_from").alias("t")).unionByName(outer.select(*group, F.col("last").alias("t"))), group)
    paired = begin.withColumnRenamed("t", "start").join(stop.withColumnRenamed("t", "end"), [*group, "period_no"])
    return paired.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], "period_no",
        F.when(F.col("start") > NO_START, F.col("start")).alias("start"), F.when(F.col("end") < NO_END, F.col("end")).alias("end"),
    )


def _numbered(times: DataFrame, group: Sequence[str]) -> DataFrame:
    """The different times of each group with period_no, their rank: counted within a day and carried over by the days' totals."""
    placed = times.withColumn("day", F.floor(F.col("t") / 86400))
    days = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*group, "day").agg(F.count(F.lit(1)).alias("n")).select(*group, "day", F.coalesce(F.sum("n").over(days), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, "day").orderBy("t"))
    return placed.withColumn("place", within).join(carried, [*group, "day"]).select(*group, "t", (F.col("place") + F.col("before")).cast("int").alias("period_no"))


def overlap_counts(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", name: str = "n_overlapping") -> DataFrame:
    """The rows of ``intervals`` with the number of intervals of their group that share an instant with them, themselves included.

    No pairs are formed: an interval meets all that have begun before its end,
    less those that have ended by its start.  Both counts are running sums over
    the group's different boundaries, taken within days as in :func:`gaps`.

    Rows with a null key or whose end is not after their start are left out;
    null bounds are open; repeated rows count each.
    """
    columns = intervals.columns
    group = [f"__k{i}" for i in range(len(keys))]
    valid = (
        intervals.dropna(subset=list(keys)).withColumns(dict(zip(group, map(F.col, keys), strict=True)))
        .withColumns({"__s": F.coalesce(F.col(start), F.lit(NO_START)), "__e": F.coalesce(F.col(end), F.lit(NO_END))}).where("__e > __s")
    )
    both = F.explode(F.array(F.struct(F.col("__s").alias("t"), F.lit(1).alias("b"), F.lit(0).alias("c")), F.struct(F.col("__e").alias("t"), F.lit(0).alias("b"), F.lit(1).alias("c"))))
    counted = cut(
        valid.select(*group, both.alias("x")).select(*group, "x.*").groupBy(*group, "t").agg(F.sum("b").alias("begun"), F.sum("c").alias("ended"))
        .withColumn("day", F.floor(F.col("t") / 86400))
    )
    days = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.groupBy(*group, "day").agg(F.sum("begun").alias("b"), F.sum("ended").alias("c")).select(
        *group, "day", *[F.coalesce(F.sum(x).over(days), F.lit(0)).alias(f"{x}_before") for x in "bc"]
    )
    upto = Window.partitionBy(*group, "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.withColumns({"b": F.sum("begun").over(upto), "c": F.sum("ended").over(upto)}).join(carried, [*group, "day"]).select(
        *group, "t", (F.col("b") + F.col("b_before") - F.col("begun")).alias("began_before"), (F.col("c") + F.col("c_before")).alias("ended_by")
    )
    at_end = sums.select(*group, F.col("t").alias("__e"), "began_before")
    at_start = sums.select(*group, F.col("t").alias("__s"), "ended_by")
    spread = F.col("__s")
    met = skew_join(skew_join(valid, at_end, [*group, "__e"], spread), at_start, [*group, "__s"], F.col("__e"))
    return met.select(*columns, (F.col("began_before") - F.col("ended_by")).alias(name))
