import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing


def test_split_keeps_every_block():
    rng = np.random.default_rng(1)
    blocks = np.array([5, 0, 400, 33])
    dealt = mixing.split(blocks, 7, rng)
    assert dealt.shape == (7, 4) and (dealt.sum(0) == blocks).all() and (dealt >= 0).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 3


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(i, "big", rng.randrange(5, 60)) for i in range(1_500)] + [(2_000 + i, "mid", rng.randrange(5, 60)) for i in range(300)] + [(3_000 + i, "tiny", 50) for i in range(10)]
    return [*rows, (4_000, None, 9), (4_001, "other", 9), (4_002, "big", 0), (4_003, "mid", None)]


TARGETS = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 8), ("m", "none", 0.5, 3), ("n", "tiny", 1.0, 3)]


@pytest.mark.parametrize("part", [20, 200_000])
def test_shares_caps_and_shards(spark, corpus, part, monkeypatch):
    monkeypatch.setattr(mixing, "PART", part)
    sized = spark.createDataFrame(corpus, "doc_id long, source string, tokens long").repartition(3)
    mixed = mixing.mix(sized, spark.createDataFrame(TARGETS, "mix_name string, source string, weight double, max_repeats long"))
    rows = mixed.records.collect()
    assert len({(r["mix_name"], r["doc_id"], r["repetition"]) for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= {d for d, s, t in corpus if s in ("big", "mid", "tiny") and t}
    caps = {(m, s): c for m, s, _, c in TARGETS}
    assert all(r["repetition"] <= caps[r["mix_name"], r["source"]] for r in rows)
    got = {(r["mix_name"], r["source"]): r for r in mixing.composition(mixed).collect()}
    # the small source gives all its cap allows and takes nothing from the others; each of them is at its quota
    have = sum(t for _, s, t in corpus if s in ("big", "mid", "tiny") and t)
    for source, share in (("big", 0.5), ("mid", 0.3)):
        assert got["m", source]["quota"] == int(have * share + 0.5) and abs(got["m", source]["tokens"] - got["m", source]["quota"]) <= 2
    assert got["m", "tiny"]["tokens"] == 4_000 and got["m", "tiny"]["repeats"] == 8
    assert got["m", "none"]["tokens"] == 0 and got["n", "tiny"]["tokens"] == 500 and got["m", "none"]["records"] == 0
    sums = {}
    for r in rows:
        sums[r["mix_name"], r["source"]] = sums.get((r["mix_name"], r["source"]), 0) + r["tokens"]
    assert sums == {k: r["tokens"] for k, r in got.items() if r["tokens"]}
    assert all(abs(r["actual_share"] - r["tokens"] / sum(t for (m, _), t in sums.items() if m == k[0])) < 1e-12 for k, r in got.items())
    per_shard = mixed.records.where("mix_name = 'm'").groupBy("shard").agg(F.sum("tokens").alias("t")).collect()
    assert len(per_shard) == mixing.SHARDS and max(r["t"] for r in per_shard) < 2 * min(r["t"] for r in per_shard)
    assert sorted(map(tuple, mixing.mix(sized.repartition(5), spark.createDataFrame(TARGETS, "mix_name string, source string, weight double, max_repeats long")).records.collect())) == sorted(map(tuple, rows))


def test_a_larger_total_reports_what_was_reached(spark, corpus):
    sized = spark.createDataFrame(corpus, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS[:3], "mix_name string, source string, weight double, max_repeats long")
    got = {r["source"]: r for r in mixing.composition(mixing.mix(sized, targets, total_tokens=30_000)).collect()}
    assert got["tiny"]["tokens"] == 4_000 and got["big"]["tokens"] == pytest.approx(15_000, abs=30)


def test_a_long_document_at_the_cut_is_filled_up(spark):
    rows = [(i, "few", t) for i, t in enumerate([900, 40, 800, 30, 20, 1_000, 10, 700])] + [(100, "other", 3_500)]
    targets = spark.createDataFrame([("m", "few", 0.25, 1), ("m", "other", 0.75, 2)], "mix_name string, source string, weight double, max_repeats long")
    for seed in range(3):
        got = {r["source"]: r for r in mixing.composition(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets, seed=seed)).collect()}
        assert got["few"]["quota"] == 1_750 and abs(got["few"]["tokens"] - 1_750) <= 150 and got["other"]["repeats"] in (1, 2)


def test_a_permutation_takes_every_number_once():
    for n in (1, 2, 3, 64, 1_000, 4_097):
        at = mixing.permuted(np.arange(n), n, (3, 1 << 61, 77, 5))
        assert sorted(at.tolist()) == list(range(n))
    assert np.abs(np.diff(mixing.permuted(np.arange(4_096), 4_096, (3, 9, 77, 5)))).mean() > 1_000


def test_more_targets_than_the_bound_are_an_error(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_TARGETS", 3)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(corpus, "doc_id long, source string, tokens long"), spark.createDataFrame(TARGETS, "mix_name string, source string, weight double, max_repeats long"))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, weight double, max_repeats long")
    assert mixing.mix(none, targets).records.count() == 0 and mixing.composition(mixing.mix(none, targets)).count() == 5
    assert mixing.mix(none, targets.limit(0)).records.count() == 0


def test_nulls_copies_and_clashing_columns(spark, corpus):
    """Columns that the operator makes itself may be there already; null targets and rows are left out, repeated targets count together."""
    sized = spark.createDataFrame([*corpus, (None, "big", 5)], "doc_id long, source string, tokens long")
    for extra in ("mix_name", "full", "rest", "start", "key", "part", "block", "at", "again", "short", "uses", "repetition"):
        sized = sized.withColumn(extra, F.lit("x"))
    rows = [("m", "big", 0.25, 1), ("m", "big", 0.25, 3), ("m", "mid", 0.5, None), ("m", None, 1.0, 1), (None, "big", 1.0, 1), ("m", "tiny", None, 2)]
    targets = spark.createDataFrame(rows, "mix_name string, source string, weight double, max_repeats long").withColumn("tokens", F.lit(1))
    got = {(r["mix_name"], r["source"]): r for r in mixing.composition(mixing.mix(sized, targets)).collect()}
    assert set(got) == {("m", "big"), ("m", "mid"), ("m", "tiny")} and got["m", "big"]["target_share"] == 0.5 and got["m", "big"]["repeats"] == 1
    assert got["m", "mid"]["tokens"] == 0 and got["m", "tiny"]["tokens"] == 0  # no repeat allowed, no weight
