"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in a random order and laid end to end, as often
as its quota needs; the line is cut where the quota ends, and documents from
around the cut fill what a long document there left open.  The line of
tokens is then divided into blocks.  A tree deals the blocks out: at every node
the numbers of blocks per source are split between the left and right half of
the output shards by one draw without replacement, so every shard gets an exact
quota of each source.  The blocks of a source are permuted, the shards take
disjoint ranges of them, and each shard orders its records by a random key.

Only totals per source and mix and the quotas reach the driver, one row per row
of the targets.  Positions in a source's line are running sums, taken within
buckets of the random key and carried over by the buckets' totals, so one large
source is spread like many.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.lineage import cut

#: Documents of a source that one task sums up at a time.
PART = 200_000
#: Output shards at least, tokens of a shard at most (while the table allows it), and blocks that make one up on average.
SHARDS, SHARD_TOKENS, BLOCKS = 16, 1 << 26, 64
#: Most rows of the targets, and most cells (shards times targets) of the table that is sent to the executors: 8 MB.
MOST_TARGETS, MOST_CELLS = 10_000, 1 << 20
#: Length of line on either side of a cut, as a multiple of what is missing there, from which fillers are taken.
AHEAD = 64


@dataclass(frozen=True)
class Quota:
    """What one source gives to one mix."""

    mix_name: str
    source: str
    target_share: float
    max_repeats: int
    documents: int
    available: int
    tokens: int


@dataclass(frozen=True)
class Mix:
    """records: one row per use of a document; quotas: the plan they follow."""

    records: DataFrame
    quotas: list[Quota]


def quotas(targets: list, totals: dict[str, tuple[int, int]], total_tokens: int | None = None) -> list[Quota]:
    """Tokens that each source owes to each mix.

    The size asked for is ``total_tokens``, or as many tokens as the sources of
    the mix have together.  Every source owes its share of that size, relative to
    the weights of the sources that have tokens; one too small for it is repeated
    up to its cap and owes no more than that gives.  No source shrinks the part of another.
    """
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = sorted((t for t in targets if t["mix_name"] == mix), key=lambda t: t["source"])
        usable = {t["source"]: t["weight"] for t in rows if totals.get(t["source"], (0, 0))[1] > 0 and t["weight"] > 0 and t["max_repeats"] > 0}
        whole, stated = sum(usable.values()), sum(r["weight"] for r in rows)
        size = sum(totals[s][1] for s in usable) if total_tokens is None else total_tokens
        for t in rows:
            n, have = totals.get(t["source"], (0, 0))
            share = usable.get(t["source"], 0.0) / whole if whole else 0.0
            owed = min(int(size * share + 0.5), max(t["max_repeats"], 0) * have)
            out.append(Quota(mix, t["source"], t["weight"] / stated if stated else 0.0, t["max_repeats"], n, have, owed))
    return out


def split(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas (shards x sources) whose columns sum to ``blocks``, by recursive halving."""
    if shards == 1:
        return blocks.reshape(1, -1)
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(blocks, int(blocks.sum()) * left // shards, method="marginals")
    return np.vstack([split(drawn, left, rng), split(blocks - drawn, shards - left, rng)])


def permuted(numbers: np.ndarray, n: int, keys: Iterable[int]) -> np.ndarray:
    """A pseudo-random permutation of 0 .. n-1 at ``numbers``: rounds of a balanced network, walked on until below n."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            mixed = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)



def _fillers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the documents around one cut those that fill what is missing: first those not yet used so often, longest first."""
    missing, at, out = int(rows["short"].iloc[0]), 0, []
    for row in rows.sort_values(["again", "tokens", "doc_id"], ascending=[True, False, True]).itertuples():
        if row.tokens <= missing - at:
            out.append((row.mix_name, row.source, row.doc_id, row.tokens, at))
            at += row.tokens
            if at == missing:
                break
    return pd.DataFrame(out, columns=["mix_name", "source", "doc_id", "tokens", "at"])


def _table(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """A table with at most one row per target: small by the check of their number, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, ddl))


def _line(used: DataFrame, largest: int, seed: int) -> DataFrame:
    """doc_id, source, tokens and start: the place of every document in its source's line."""
    parts = max(1, -(-largest // PART))
    keyed = used.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn(
        "part", F.floor((F.shiftrightunsigned("key", 1).cast("double") / 2.0**63) * parts).cast("int")
    )
    offsets = keyed.groupBy("source", "part").agg(F.sum("tokens").alias("t")).select(
        "source", "part",
        F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("upto", F.sum("tokens").over(inside)).join(offsets, ["source", "part"]).select(
        "doc_id", "source", "tokens", (F.col("upto") + F.col("before") - F.col("tokens")).alias("start")
    )


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, shards: int = SHARDS) -> Mix:
    """Compose every mix of ``targets`` (mix_name, source, weight, max_repeats) from ``sized`` documents.

    ``sized`` has doc_id (unique), source and tokens, and is read twice: take a
    written table.  Jobs run while the result is built: totals, the line of
    documents and its fillers.  records: mix_name, source, doc_id, repetition
    (from 1), tokens, shard, shuffle_key; a shard in the order of shuffle_key is
    ready for use.

    A document enters whole.  Where a source's quota ends within a document, the
    documents around the cut that fit into what is missing and may be used once
    more fill it, those behind it first, longest first; then the one document left whose size comes nearest to the rest is
    added if that brings the source nearer to its quota.  So no source is further
    from its quota than half of the document at which its line is cut.  No
    document is used more than max_repeats times.

    Documents without tokens, of no source or of a source that no mix names are
    left out; sources without documents contribute nothing; repeated target
    rows count with their summed weight and smallest cap; empty tables give an
    empty result.  More than ``MOST_TARGETS`` targets are an error.
    """
    spark = sized.sparkSession
    wanted = (
        targets.where("mix_name is not null and source is not null")
        .groupBy("mix_name", "source")
        .agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    )
    rows = wanted.limit(MOST_TARGETS + 1).collect()  # the table of targets, which a person writes
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets; raise the bound")
    fill = f"mix_name string, source string, doc_id {sized.schema['doc_id'].dataType.simpleString()}, tokens long, at long"
    named = _table(spark, [(s,) for s in sorted({r["source"] for r in rows})], "source string")
    used = sized.where("tokens > 0").join(named, "source", "left_semi").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    totals = {r["source"]: (r["n"], r["t"]) for r in used.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    plan = quotas(rows, totals, total_tokens)
    line = cut(_line(used, max((n for n, _ in totals.values()), default=1), seed))

    # each document is used ``full`` times, those before the cut at ``rest`` once more, and fillers one time above that
    owing = {(q.mix_name, q.source): q for q in plan if q.tokens > 0}
    owed = _table(spark, [(m, s, q.tokens // q.available, q.tokens % q.available, q.max_repeats) for (m, s), q in owing.items()], "mix_name string, source string, full long, rest long, cap long")
    fits = F.col("start") + F.col("tokens") <= F.col("rest")
    placed = line.join(owed, "source")
    before = {tuple(r)[:2]: r["t"] for r in placed.where(fits).groupBy("mix_name", "source").agg(F.sum("tokens").alias("t")).collect()}
    short = {k: q.tokens % q.available - before.get(k, 0) for k, q in owing.items()}
    missing = lambda: _table(spark, [(*k, n) for k, n in short.items() if n > 0], "mix_name string, source string, short long")
    allowed = ~fits | (F.col("full") + 2 <= F.col("cap"))
    around = placed.join(missing(), ["mix_name", "source"]).where(allowed & (F.col("tokens") <= F.col("short")) & (F.abs(F.col("start") - F.col("rest")) < F.col("short") * AHEAD))
    # a group is no longer than 2 * AHEAD + 1 times the document at the cut
    filled = cut(around.select("mix_name", "source", "doc_id", "tokens", "short", fits.alias("again")).groupBy("mix_name", "source").applyInPandas(_fillers, fill))
    for r in filled.groupBy("mix_name", "source").agg(F.sum("tokens").alias("t")).collect():
        short[r["mix_name"], r["source"]] -= r["t"]
    near = F.abs(F.col("tokens") - F.col("short"))
    last = (
        placed.where(allowed).join(missing(), ["mix_name", "source"]).where(near < F.col("short"))
        .join(filled.select("mix_name", "doc_id"), ["mix_name", "doc_id"], "left_anti")
        .groupBy("mix_name", "source").agg(F.min(F.struct(near.alias("near"), fits.alias("again"), "doc_id", "tokens")).alias("x")).select("mix_name", "source", "x.doc_id", "x.tokens").collect()
    )
    for r in last:
        short[r["mix_name"], r["source"]] -= r["tokens"]
    at_end = [(r["mix_name"], r["source"], r["doc_id"], r["tokens"], owing[r["mix_name"], r["source"]].tokens) for r in last]
    extra = filled.unionByName(spark.createDataFrame(at_end, fill)).select("mix_name", "doc_id", "at")

    # what every source gives, in blocks, dealt out to the shards of each mix
    given: list[tuple] = []
    ranges: dict[tuple[str, str], tuple[int, tuple[int, ...], np.ndarray]] = {}
    for name in sorted({m for m, _ in owing}):
        own = {s: q.tokens - short[m, s] for (m, s), q in owing.items() if m == name and q.tokens > short[m, s]}
        if not own:
            continue
        size = sum(own.values())
        n_shards = max(shards, min(-(-size // SHARD_TOKENS), MOST_CELLS // len(owing)))
        block = max(1, size // (n_shards * BLOCKS))
        numbers = np.array([-(-t // block) for t in own.values()], dtype=np.int64)
        rng = np.random.default_rng([seed, *name.encode()])
        for (source, _), n, column in zip(own.items(), numbers.tolist(), split(numbers, n_shards, rng).T, strict=True):
            q = owing[name, source]
            ranges[name, source] = (n, tuple(rng.integers(1, 1 << 62, 4).tolist()), np.cumsum(column))
            given.append((name, source, q.tokens // q.available, q.tokens % q.available, q.available, before.get((name, source), 0), block, n))
    shared = spark.sparkContext.broadcast(ranges)  # at most MOST_CELLS numbers

    @F.pandas_udf(T.IntegerType())
    def shard(mix_name: pd.Series, source: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(block), dtype=np.int32)
        rows = pd.DataFrame({"m": mix_name, "s": source, "b": block})
        for (m, s), part in rows.groupby(["m", "s"], sort=False):
            n, keys, upto = shared.value[m, s]
            out[part.index] = np.searchsorted(upto, permuted(part["b"].to_numpy(np.int64), n, keys), side="right")
        return pd.Series(out)

    giving = _table(spark, given, "mix_name string, source string, full long, rest long, available long, before long, block long, blocks long")
    # fillers and last documents stand behind those before the cut
    place = F.when(F.col("at").isNotNull() & (F.col("repetition") == F.col("uses")), F.col("full") * F.col("available") + F.col("before") + F.col("at")).otherwise(
        (F.col("repetition") - 1) * F.col("available") + F.col("start")
    )
    records = (
        line.join(giving, "source").join(extra, ["mix_name", "doc_id"], "left")
        .withColumn("uses", (F.col("full") + fits.cast("long") + F.col("at").isNotNull().cast("long")).cast("int")).where("uses > 0")
        .withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("uses"))))
        .withColumn("in_block", F.least(F.floor(place / F.col("block")), F.col("blocks") - 1))
        .select(
            "mix_name", "source", "doc_id", "repetition", "tokens",
            shard("mix_name", "source", "in_block").alias("shard"),
            F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "repetition").alias("shuffle_key"),
        )
    )
    return Mix(records, plan)


def composition(mixed: Mix) -> DataFrame:
    """Per mix and source: the target share, and the tokens, share, documents and repeats reached."""
    planned = _table(
        mixed.records.sparkSession, [(q.mix_name, q.source, q.target_share, q.max_repeats, q.documents, q.tokens) for q in mixed.quotas],
        "mix_name string, source string, target_share double, max_repeats long, documents long, quota long",
    )
    reached = mixed.records.groupBy("mix_name", "source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repetition").alias("repeats")
    )
    of_mix = Window.partitionBy("mix_name")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return planned.join(reached, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", "max_repeats", "documents", "quota",
        zero("records").alias("records"), zero("repeats").alias("repeats"), zero("tokens").alias("tokens"),
        (zero("tokens") / F.greatest(F.sum(zero("tokens")).over(of_mix), F.lit(1))).alias("actual_share"),
    )
