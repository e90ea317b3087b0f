from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions import names as N
from factloom.functions import temporal as T
from factloom.functions import terms as V

TIMES = [
    ("1706", "year", (1706, 1, 1)), (" 1706-01 ", "month", (1706, 1, 1)), ("1706-01-17", "day", (1706, 1, 17)), ("1000-02-03", "day", (1000, 2, 3)),
    ("2024-02-29T12:30:15Z", "instant", (2024, 2, 29, 12, 30, 15)), ("2024-01-01T01:00:00+02:00", "instant", (2023, 12, 31, 23)),
    ("2023-02-29", "day", None), ("2024-13", "month", None), ("0000", "year", None), ("c. 1706", None, None), ("", None, None), (None, None, None),
    ("2024-01-01T12:00:00", "instant", None), ("2024-01-01T25:00:00Z", "instant", None), ("17060117", None, None),
]


def test_times(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TIMES], "t string")
    got = df.select("t", T.precision(F.col("t")), T.earliest_second(F.col("t")), T.written(T.earliest_second(F.col("t")))).collect()
    for (text, shape, at), r in zip(TIMES, got, strict=True):
        second = int(datetime(*at, tzinfo=timezone.utc).timestamp()) if at else None
        assert (r[1], r[2]) == (shape, second), text
        if at:
            assert r[3] == datetime(*at, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    assert spark.range(1).select(T.is_naive(F.lit("2024-01-01T12:00:00"))).first()[0]


def test_intervals_are_half_open(spark):
    row = spark.range(1).select(
        T.contains(F.lit(1), F.lit(5), F.lit(1)), T.contains(F.lit(1), F.lit(5), F.lit(5)), T.contains(F.lit(None), F.lit(5), F.lit(-9)),
        T.overlaps(F.lit(1), F.lit(5), F.lit(5), F.lit(None)), T.overlaps(F.lit(1), F.lit(None), F.lit(4), F.lit(6)),
    ).first()
    assert list(row) == [True, False, True, False, True]


def test_noisy_or(spark):
    df = spark.createDataFrame([("a", 0.6, None), ("a", 0.5, None), ("a", None, 0.9), ("b", None, None), ("c", 0.5, 0.9)], "k string, c double, a double")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(C.noisy_or(C.weighted(F.col("c"), F.col("a"))).alias("v")).collect()}
    assert got["a"] == pytest.approx(0.8) and got["b"] is None and got["c"] == pytest.approx(0.45)
    arrays = df.groupBy("k").agg(F.collect_list(F.struct(F.col("c").alias("confidence"), F.col("a").alias("authority"))).alias("e"))
    again = {r["k"]: r["v"] for r in arrays.select("k", C.noisy_or_array(F.col("e")).alias("v")).collect()}
    assert again["a"] == pytest.approx(0.8) and again["b"] is None
    assert spark.range(1).select(C.noisy_or_array(F.expr("CAST(array() AS ARRAY<STRUCT<confidence: DOUBLE, authority: DOUBLE>>)"))).first()[0] is None


def test_names(spark):
    texts = ["Ben  Franklin.", "Straße", "ben franklin", "_A_ $5", "...", "", None, "Ｆｕｌｌ", "O’Neil-Smith"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(N.normalize(F.col("t"))).collect()]
    assert got == [None if t is None else N.normalized(t) for t in texts]
    assert got[0] == "ben franklin" and got[1] == "strasse" and got[4] == ""
    row = spark.range(1).select(N.entity_id(F.lit("ben franklin"), F.lit("person")), N.entity_id(F.lit(""), F.lit(None).cast("string")), N.humanized(F.lit("BORN_IN")), N.predicate_name(F.lit(" born in! "))).first()
    assert list(row) == ["person:ben-franklin", "entity", "born in", "BORN_IN"]


def test_terms_round_trip(spark):
    values = ['{"$ref": "p:1"}', '"a \\"b\\" é"', "1706", "-2.5", "true", '{"$time": "1706-01"}', '[1,2]', "null", None, "not json"]
    df = spark.createDataFrame([(v,) for v in values], "j string").withColumn("t", V.decode(F.col("j")))
    got = [(r[0], r[1]) for r in df.select(V.key(F.col("t")), V.value_type(F.col("t"))).collect()]
    assert got[:7] == [("ref:p:1", "entity"), ('str:a "b" é', "string"), ("int:1706", "integer"), ("float:-2.5", "number"), ("bool:true", "boolean"), ("time:1706-01", "time"), ("json:[1,2]", "json")]
    assert [k for k, _ in got[7:]] == ["none"] * 3
    again = df.where("t is not null").select("t", V.decode(V.encode(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in again)
    keys = {V.literal(v)[0] for v in (1, 1.0, True, "1")}
    assert keys == {"integer", "number", "boolean", "string"} and V.literal(None) is None
    with pytest.raises(TypeError):
        V.literal(object())


def test_claim_ids_ignore_the_order_of_qualifiers(spark):
    q = "map('{}', named_struct('kind', 'string', 'text', 'x', 'hint', CAST(NULL AS STRING)), '{}', named_struct('kind', 'string', 'text', 'y', 'hint', CAST(NULL AS STRING)))"
    one, two = (F.expr(q.format(*k).replace("'x'", "'v'").replace("'y'", "'v'")) for k in (("a", "b"), ("b", "a")))
    ids = spark.range(1).select(*[V.claim_id(F.lit("ref:a"), F.lit("P"), F.lit("int:1"), F.lit(None).cast("string"), F.lit(None).cast("string"), x) for x in (one, two)]).first()
    assert ids[0] == ids[1] and ids[0].startswith("fact:") and len(ids[0]) == 21
