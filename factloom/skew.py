"""Joins and numbering that stay even when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
SALTS = 16


def salted_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join many rows to a table with few rows per key, spreading every key.

    ``rows`` get a salt from ``spread`` (a column that varies within a key) and
    ``per_key`` is repeated once per salt, so a key's rows meet in ``salts``
    tasks.  Keys compare by SQL equality; null keys never match (with ``left``
    they are kept).  ``how`` may be inner, left, left_semi or left_anti.
    """
    salted = rows.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn(SALT, F.explode(F.expr(f"sequence(0, {salts - 1})")))
    return salted.join(repeated, [*keys, SALT], how).drop(SALT)


def skew_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join whose hot keys are split at run time, where the next step needs no order by the same keys.

    With adaptive execution Spark measures the shuffled partitions and divides
    those that are far larger than the rest, without repeating anything else;
    and it broadcasts a side that turns out small.  In a session without it the
    join is salted instead.  Keys and ``how`` as for :func:`salted_join`.
    """
    conf = rows.sparkSession.conf
    adaptive = all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled"))
    return rows.join(per_key, list(keys), how) if adaptive else salted_join(rows, per_key, keys, spread, how)


def by_shuffle(side: DataFrame) -> DataFrame:
    """``side`` for a join that sorts and shuffles both sides, whatever size Spark takes them to have.

    Spark takes a scan to be as large as its compressed file, and exploded rows
    as large as what they are made from.  A side that is a hundred times larger
    then counts as small, and the driver collects it for a broadcast.
    """
    return side.hint("merge")


#: Rows from which a key counts as hot, and the most keys treated so: any other key has at most a thousandth of all rows.
HOT, MOST_HOT = 50_000, 1_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str) -> list[tuple]:
    """The keys with the most rows, of a table with the rows per key in column ``n``: at most ``MOST_HOT``."""
    top = counts.where(F.col(n) >= HOT).orderBy(F.desc(n)).limit(MOST_HOT)
    return [tuple(r) for r in top.select(*keys).collect()]


def even_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Column, hot: list[tuple], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """:func:`salted_join` that salts only the keys in ``hot`` (from :func:`hot_keys`) and so repeats no others."""
    if not hot:
        return rows.join(per_key, list(keys), how)
    schema = rows.select(*keys).schema
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot, schema).withColumn("__hot", F.lit(True)))  # at most MOST_HOT rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")
    salted = rows.join(listed, list(keys), "left").withColumn(SALT, salt).drop("__hot")
    repeated = per_key.join(listed, list(keys), "left").withColumn(
        SALT, F.explode(F.when(F.col("__hot"), F.expr(f"sequence(0, {salts - 1})")).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    return salted.join(repeated, [*keys, SALT], how).drop(SALT)
