"""Tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation.

    The tables stand in a folder named by the application and go with :func:`release`.
    """
    path = f"{_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application staged, once its results are written.  Results read from them end too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
