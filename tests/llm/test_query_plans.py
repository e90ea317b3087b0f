from pathlib import Path

import pytest

import __spark_entry__ as entry
from factloom.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_joins_all_with_all(spark, name):
    df = entry.queries()[name](spark, DATA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert len(df.take(1)) == 1


FOUND = {
    "p1_found": ["id_a string", "id_b string"], "p3_found": ["field_name string", "row_key string"],
    "p4_found": ["subject_id string", "predicate string", "fact_id string"], "p6_found": ["bin_name string", "doc_id bigint"], "p8_found": ["doc_id bigint"],
}


@pytest.mark.parametrize("name", FOUND)
def test_found_cases_have_the_stated_columns_and_no_repeats(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert [" ".join(c) for c in df.dtypes] == FOUND[name]
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
    if name == "p1_found":
        assert all(r["id_a"] < r["id_b"] for r in rows)
