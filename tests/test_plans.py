"""What the plans of the queries must look like, whatever the data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from factloom.operators import facts as A
from factloom.sources.tables import table

DATA = "/root/testdata/sf0.001"
CORE = sorted(n for m in entry._modules() if not m.__name__.startswith("factloom.llm") for n in m.QUERIES)

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", CORE)
def test_no_query_joins_all_with_all(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_conditions_and_columns_reach_the_scan(spark):
    found = A.find(table(spark, DATA, "facts"), subject="s", predicate="BORN_IN", object_key="ref:x", min_confidence=0.5).select("fact_id")
    text = plan(found)
    for condition in ("EqualTo(subject_id,s)", "EqualTo(predicate,BORN_IN)", "EqualTo(object_key,ref:x)", "GreaterThanOrEqual(confidence,0.5)", "EqualTo(status,active)"):
        assert condition in text
    read = text[text.index("ReadSchema: ") :]
    assert "valid_from" not in read and "object_json" not in read


def test_belief_time_reaches_the_scan(spark):
    text = plan(A.find(table(spark, DATA, "facts"), as_of="2024-03-01T00:00:00Z").select("fact_id"))
    assert "LessThanOrEqual(recorded_at" in text


def test_confidence_combines_before_the_shuffle(spark):
    text = plan(entry.queries()["stocked_by"](spark, DATA))
    assert "partial_product" in text and text.count("Exchange") == 1


FOUND = {
    "p2_found": ["subject_id string", "predicate string", "gap_from string", "gap_to string"],
    "p5_found": ["ref_table string", "ref_field string", "row_key string", "missing_key string"],
}


@pytest.mark.parametrize("name", FOUND)
def test_found_cases_have_the_stated_columns_and_no_repeats(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert [" ".join(c) for c in df.dtypes] == FOUND[name]
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
