import pytest
from pyspark.sql import functions as F

from factloom import lineage


def test_cut_keeps_rows_and_types_and_release_deletes(spark):
    df = spark.createDataFrame([(1, "a", [1, None]), (None, None, None)], "a long, b string, c array<int>")
    copy = lineage.cut(df.withColumn("d", F.current_timestamp()))
    assert sorted(map(str, copy.select("a", "b", "c").collect())) == sorted(map(str, df.collect())) and [f.dataType for f in copy.schema][:3] == [f.dataType for f in df.schema]
    assert "Scan parquet" in copy._jdf.queryExecution().toString() or "FileScan parquet" in copy._jdf.queryExecution().toString()
    empty = lineage.cut(df.limit(0))
    assert empty.count() == 0 and empty.columns == df.columns
    assert lineage.release(spark) >= 2 and lineage.release(spark) == 0
    with pytest.raises(Exception):
        copy.count()


def test_a_cluster_needs_the_setting(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
    assert lineage.shared_dir(spark).startswith("file:")
