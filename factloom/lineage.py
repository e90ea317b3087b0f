"""Cutting lineage so that lost executors never cost a whole job.

``cut`` writes a DataFrame as a compressed table into the shared folder that
the cluster names in ``spark.checkpoint.dir`` and reads it back.  Unlike a
local checkpoint the copy does not live on any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Only a session whose master is ``local`` may lack the setting; it gets a
    temporary folder that is removed at exit.  Elsewhere a missing setting is
    an error, since a folder of one machine would not survive that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return a scan of the copy.

    The columns, types and rows are unchanged; row order is not kept.  The copy
    stays until :func:`release`, for a result may be read from it again.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all copies that this process made; results that were not yet written are lost.  Returns their number."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
