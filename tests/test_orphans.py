import random

from pyspark.sql import functions as F

from factloom.operators.orphans import Reference, by_period, orphans

ROWS = "row_key string, key string, at timestamp, domain string"


def refer(rows, parents, name="f", domain="d"):
    return Reference("t", name, rows, "key", F.col("row_key"), domain, parents, "id", F.col("at").cast("timestamp"))


def test_random_keys_match_a_set(spark):
    rng = random.Random(4)
    keys = [f"k{i}" for i in range(300)] + ["", " k1", "K1", "k1 ", "ключ"]
    for share in (0.0, 0.5, 0.98):
        parents = [k for k in keys if rng.random() < share]
        rows = [(f"r{i}", rng.choice([*keys, None, "k0", "k0", "k0"]), None, "x") for i in range(2_000)]
        df, have = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(p, 1) for p in parents] + [(None, 2)], "id string, domain int")
        got = {(r["row_key"], r["missing_key"]) for r in orphans([refer(df, have)]).collect()}
        assert got == {(r, k) for r, k, _, _ in rows if k is not None and k not in parents}


def test_domains_are_apart(spark):
    rows = spark.createDataFrame([("r", "a", None, "x")], ROWS)
    here, there = (spark.createDataFrame([(k,)], "id string") for k in ("a", "b"))
    found = orphans([refer(rows, here, "f", "one"), refer(rows, there, "g", "two")]).collect()
    assert [(r["ref_field"], r["missing_key"]) for r in found] == [("g", "a")]


def test_periods_and_log(spark):
    rows = spark.createDataFrame([("r1", "a", "2024-01-05", "x"), ("r1", "a", "2024-01-05", "x"), ("r2", "b", None, "x")], "row_key string, key string, at string, domain string")
    none = spark.createDataFrame([], "id string")
    log = spark.createDataFrame([("a", "deleted"), ("a", "arrived"), (None, "arrived")], "key_text string, change_kind string")
    got = {tuple(r) for r in by_period(orphans([refer(rows, none)]), log).collect()}
    assert got == {("t", "f", "2024-01", 1, 1, 1, 1), ("t", "f", "unknown", 1, 1, 0, 0)}


def test_empty(spark):
    assert orphans([refer(spark.createDataFrame([], ROWS), spark.createDataFrame([], "id string"))]).count() == 0
