import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_queries_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_run_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
print('ROWS', e.entry(s).count(), e.queries()['resolved_titles'](s, {str(DATA)!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
