from factloom.sources.store import Store
from factloom.streaming.ingest import into_store, windowed_confidence

SCHEMA = "fact_id string, seq long, predicate string, subject_id string, status string"


def test_stream_upserts_once(spark, tmp_path):
    source, store = f"file://{tmp_path}/in", Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([("a", 1, "P", "s", "active"), ("b", 2, "P", "s", "active")], SCHEMA).write.parquet(source)
    run = lambda: into_store(spark.readStream.schema(SCHEMA).parquet(source), store, "facts", "fact_id", f"file://{tmp_path}/state").awaitTermination(120)
    run()
    spark.createDataFrame([("b", 3, "P", "s", "superseded")], SCHEMA).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(tuple(r) for r in store.table("facts").select("fact_id", "status").collect()) == [("a", "active"), ("b", "superseded")]


def test_windowed_confidence(spark, tmp_path):
    rows = [("a", 0.6, "2024-01-01 10:00:00"), ("a", 0.5, "2024-01-01 11:00:00"), ("a", None, "2024-01-02 11:00:00")]
    source = f"file://{tmp_path}/evidence"
    df = spark.createDataFrame(rows, "fact_id string, confidence double, t string").selectExpr("fact_id", "confidence", "CAST(t AS TIMESTAMP) AS extracted_at")
    df.write.parquet(source)
    stream = windowed_confidence(spark.readStream.schema(df.schema).parquet(source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["n_evidence"], r["confidence"]) for r in spark.table("windows").collect())
    assert got[0] == (1, None) and got[1][0] == 2 and abs(got[1][1] - 0.8) < 1e-9
