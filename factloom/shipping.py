"""Making the package importable where the executors' Python runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent

_shipped: set[str] = set()


def ship(spark: SparkSession) -> bool:
    """Send the package to the executors of this session, once, unless their ``PYTHONPATH`` has it.  Returns whether it was sent.

    Spark's own file server hands the archive out, so executors need no common folder for it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return False
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="factloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(ROOT, f"{folder}/tree/{ROOT.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{ROOT.name}", "zip", f"{folder}/tree"))
    return True
