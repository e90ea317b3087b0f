"""Linking records whose names are spellings of one person, organisation or place.

Suffix blocking.  Every name is taken apart into its core and the rest.  The
suffixes of each core above a minimum length are indexed, and those of its
mirror image, so that one slip anywhere leaves a long fragment in common.
Every suffix stands together with another field, the initials of the rest.  A
block that is still overly common is refined again by the letters at the far
end of the core, and only then discarded.  Pairs are compared by
longest-common-subsequence ratio and by whether the rest of the names
contradict.

Discarding loses no pair one slip apart (a letter more, less, another, or two
neighbours swapped): the different cores of such blocks, and cores too short for
two fragments, meet by what is left when one letter is taken out, a key that any
two such cores have in common.  Cores that differ by a letter moved further are
linked if they share a fragment that is kept.

Joins are shuffled whatever size Spark takes their sides to have: the fragments
of a core are many times larger than the file that they are made from.

Records that say the same are one node from the start, so copies cost nothing.
A record that leaves open what tells others apart (an initial, no middle name,
no region) is linked only if the others agree on it.
"""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.lineage import cut
from factloom.llm import names
from factloom.llm.components import components
from factloom.skew import by_shuffle, skew_join

#: Letters of the shortest suffix indexed.
SHORTEST = 4
#: Members up to which a block is compared whole.
COMMON = 64

_READ = T.StructType([T.StructField("record", T.StringType()), T.StructField("cores", T.ArrayType(T.StringType())), T.StructField("refined", T.ArrayType(T.StringType())), T.StructField("rest", T.StringType())])


#: A word is common if it stands in one of so many different names of its kind, and in this many at least.
COMMON_SHARE, COMMON_LEAST = 1_000, 20

_WORDS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_WORDS)
def _words(types: pd.Series, labels: pd.Series, alias_lists: pd.Series) -> pd.Series:
    out = []
    for t, label, listed in zip(types, labels, alias_lists, strict=True):
        read = [(names.KINDS[t], n) for n in [label or "", *names.aliases(listed)] if n.strip()]
        out.append([(kind, hash_of(n), sorted(set(words))) for kind, n in read if (words := names.words_in(kind, n))])
    return pd.Series(out)


def hash_of(name: str) -> int:
    """A number of 64 bits for a name as it is folded."""
    return int.from_bytes(blake2b(names.fold(name).encode(), digest_size=8).digest(), signed=True)


def learn(entities: DataFrame) -> names.Lexicon:
    """The common words of each kind of name, from all records whose type tells the kind.

    Equal names count once, so copies make no word common.  What is collected is
    bounded: a name has few words, and a word must stand in a
    ``COMMON_SHARE``-th of the names.  A small table teaches little; give
    :func:`variants` a lexicon then.
    """
    typed = entities.where(F.col("type").isin(*names.KINDS)).select("type", "label", "aliases_json")
    read = typed.select(F.explode(_words("type", "label", "aliases_json")).alias("n")).select("n.*").distinct()
    counted = cut(read.select("kind", F.explode(F.array_append("words", "")).alias("word")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")))
    whole = {r["kind"]: r["n"] for r in counted.where("word = ''").collect()}
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(max(COMMON_LEAST, n / COMMON_SHARE))) for k, n in whole.items()], F.lit(0.0))
    found: dict[str, dict[str, float]] = {}
    for r in counted.where((F.col("word") != "") & (F.col("n") >= least)).collect():
        found.setdefault(r["kind"], {})[r["word"]] = r["n"] / whole[r["kind"]]
    return names.Lexicon(**found)


def read_names(entities: DataFrame, key: str, lexicon: names.Lexicon) -> DataFrame:
    """``key``, record (text; null if no name can be read), cores, refined and rest of every entity."""
    shared = entities.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(_READ)
    def read(types: pd.Series, labels: pd.Series, aliases: pd.Series) -> pd.DataFrame:
        reader, out = shared.value.reader, []
        for t, label, alias in zip(types, labels, aliases, strict=True):
            r = reader.record(t, label, alias)
            out.append((r.dump(), sorted({names.skeleton(c) for c in r.cores}), names.refinements(r), r.rest()) if r else (None, [], [], None))
        return pd.DataFrame(out, columns=["record", "cores", "refined", "rest"])

    return entities.select(key, read("type", "label", "aliases_json").alias("r")).select(key, "r.*")


_JUDGED = T.StructType([T.StructField(n, T.StringType()) for n in ("first", "middle", "region")] + [T.StructField("agree", T.BooleanType())])


@F.pandas_udf(_JUDGED)
def _judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Whether two records agree, and what each leaves open that the other says, as ``a says;b says``."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = names.load(x), names.load(y)
        if not names.agree(p, q):
            out.append((None, None, None, False))
        else:
            out.append((*[f"{s};{t}" for s, t in zip(names.missing(p, q), names.missing(q, p), strict=True)], True))
    return pd.DataFrame(out, columns=["first", "middle", "region", "agree"])


def _index(nodes: DataFrame) -> DataFrame:
    """Fragments of the cores: block, node, core, next letter inwards, and the two letters at the far end."""
    whole = nodes.select("node", F.explode("refined").alias("refined"), "cores").select("node", "refined", F.explode("cores").alias("core"))
    sides = whole.select(
        "node", "refined", "core",
        F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("core").alias("text")), F.struct(F.lit("p").alias("side"), F.reverse("core").alias("text")))).alias("x"),
    ).select("node", "refined", "core", "x.*", F.length("core").alias("n"))
    cuts = sides.withColumn("size", F.explode(F.sequence(F.least(F.lit(SHORTEST), F.col("n")), F.col("n"))))
    return cuts.select(
        F.xxhash64("refined", "side", F.substring(F.col("text"), F.col("n") - F.col("size") + 1, F.col("size"))).alias("block"),
        "node", "core",
        F.when(F.col("size") < F.col("n"), F.substring(F.col("text"), F.col("n") - F.col("size"), F.lit(1))).otherwise("").alias("inner"),
        F.substring("text", 1, 2).alias("far"),
        (F.col("size") >= F.col("n") - 3).alias("nearly_whole"),
    )


def _sized(index: DataFrame) -> DataFrame:
    """The index with the number of members of each block; blocks of one are gone."""
    sizes = index.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return skew_join(index, by_shuffle(sizes), ["block"], F.col("node"))


#: One slip of a core is at most two plain edits; -1 stands for more.
_NEAR = "levenshtein(a.core, b.core, 2) >= 0"


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a < b) that share a block and whose cores are near, each once."""
    first = cut(_sized(_index(nodes)))
    again = cut(_sized(first.where(F.col("members") > COMMON).drop("members").withColumn("block", F.xxhash64("block", "far"))))
    blocks = first.where(F.col("members") <= COMMON).unionByName(again.where(F.col("members") <= COMMON))
    # a pair meets in the block of its longest common fragment: there the next letters differ, or a core ends
    within = (
        blocks.alias("a").join(by_shuffle(blocks.alias("b")), "block")
        .where("a.node < b.node and (a.inner <> b.inner or a.inner = '')").where(_NEAR)
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    )
    # refining splits a pair whose slip lies in the far letters; such a pair shares nearly the whole core
    common = F.col("members") > COMMON
    discarded = again.where(common).select("node", "core").unionByName(first.where(common & F.col("nearly_whole")).select("node", "core"))
    short = nodes.select("node", F.explode("cores").alias("core")).where(F.length("core") <= 2 * SHORTEST)  # at 2 * SHORTEST a swap in the middle leaves SHORTEST - 1 letters at either end
    return within.unionByName(_by_deletion(nodes, discarded.unionByName(short).distinct())).distinct()


def _by_deletion(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs of the nodes in ``taken`` (node, core) whose cores are at most one slip apart.

    Nodes that say the same but for other cores are compared with the first of
    them only; the first ones of equal or near cores are compared with each other.
    """
    named = taken.join(by_shuffle(nodes.select("node", "refined", "rest")), "node").select("node", "core", "rest", F.explode("refined").alias("refined"))
    hubs = cut(named.groupBy("refined", "core", "rest").agg(F.min("node").alias("hub")))
    starred = named.join(by_shuffle(hubs), ["refined", "core", "rest"]).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    without = F.transform(F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring("core", F.lit(1), i - 1), F.substring(F.col("core"), i + 1, F.length("core"))))
    keys = hubs.select("hub", F.explode(F.array_distinct(F.concat(F.array("core"), without))).alias("left"), "refined").select("hub", F.xxhash64("refined", "left").alias("key")).distinct()
    met = keys.alias("x").join(by_shuffle(keys.alias("y")), "key").where("x.hub < y.hub").select(F.col("x.hub").alias("a"), F.col("y.hub").alias("b"))
    return starred.unionByName(met)


def _links(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that agree, without those of a record that leaves open what its neighbours differ in."""
    named = by_shuffle(nodes.select("node", "record"))
    with_a = skew_join(pairs, named.select(F.col("node").alias("a"), F.col("record").alias("ra")), ["a"], F.col("b"))
    both = skew_join(with_a, named.select(F.col("node").alias("b"), F.col("record").alias("rb")), ["b"], F.col("a"))
    agreed = cut(both.withColumn("j", _judge("ra", "rb")).where("j.agree").select("a", "b", "j.first", "j.middle", "j.region"))
    said = ["first", "middle", "region"]
    halves = [
        agreed.select(F.col(me).alias("u"), F.col(other).alias("v"), *[F.split(c, ";").getItem(i).alias(c) for c in said])
        for i, (me, other) in enumerate((("a", "b"), ("b", "a")))
    ]
    directed = halves[0].unionByName(halves[1])
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    open_ = directed.groupBy("u").agg(*[(F.min(filled(c)) != F.max(filled(c))).alias(f"open_{c}") for c in said])
    doubtful = F.lit(False)
    for c in said:
        doubtful = doubtful | (F.coalesce(F.col(f"open_{c}"), F.lit(False)) & (F.col(c) != ""))
    refused = skew_join(directed, by_shuffle(open_), ["u"], F.col("v")).where(doubtful).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return agreed.select("a", "b").join(by_shuffle(refused), ["a", "b"], "left_anti")


def variants(entities: DataFrame, lexicon: names.Lexicon | None = None) -> DataFrame:
    """id and cluster (the smallest seq of its records) of every record that has another spelling or copy.

    Takes id, seq (both unique), type, label and aliases_json.  Null labels and
    aliases, aliases that are no valid JSON and names in any form are read as
    far as they go; a record without a readable name is linked to none, so is
    one of empty text.  An empty table gives an empty result; extra columns are
    ignored.  ``lexicon`` has the common words of names; by default they are
    learnt from the table (:func:`learn`).  Jobs run while the result is built.
    """
    records = cut(read_names(entities.where("id is not null").select("id", "seq", "type", "label", "aliases_json"), "id", lexicon or learn(entities)))
    seqs = by_shuffle(entities.select("id", "seq"))
    read = records.where("record is not null").select("id", "record").join(seqs, "id")
    nodes = cut(
        records.where("record is not null").join(seqs, "id").groupBy("record")
        .agg(F.min("seq").alias("node"), F.first("cores").alias("cores"), F.first("refined").alias("refined"), F.first("rest").alias("rest"))
    )
    members = cut(skew_join(read, by_shuffle(nodes.select("record", "node")), ["record"], F.col("id")).select("id", "node"))
    clusters = components(_links(nodes, candidate_pairs(nodes)))
    placed = members.join(by_shuffle(clusters), "node", "left").select("id", F.coalesce("component", "node").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return skew_join(placed, by_shuffle(sizes), ["cluster"], F.col("id")).select("id", "cluster", "size")


def pairs_of(clustered: DataFrame) -> DataFrame:
    """Every pair of ids of a cluster, id_a < id_b: as many as the clusters' sizes imply."""
    left = clustered.select(F.col("id").alias("id_a"), "cluster")
    right = clustered.select(F.col("id").alias("id_b"), "cluster")
    return skew_join(left, by_shuffle(right), ["cluster"], F.col("id_a")).where("id_a < id_b").select("id_a", "id_b")
