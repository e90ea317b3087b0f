import pytest
from pyspark.sql import functions as F

from factloom import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_joins_are_plain_joins(spark, how, adaptive, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i in range(200) for k in ["hot"] * 2 + [f"k{i % 7}", None]], "k string, v long")
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3), (None, 4)], "k string, w long")
    want = sorted(map(str, rows.join(other, "k", how).collect()))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", adaptive)
    try:
        assert sorted(map(str, skew.skew_join(rows, other, ["k"], F.col("v"), how).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    monkeypatch.setattr(skew, "HOT", 100)
    hot = skew.hot_keys(rows.where("k is not null").groupBy("k").count(), ["k"], "count")
    assert hot == [("hot",)]
    assert sorted(map(str, skew.even_join(rows, other, ["k"], F.col("v"), hot, how).collect())) == want
