"""A folder of files as a working tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ignore_pattern

#: Folders that are never part of a tree.
ALWAYS = (".git/", "target/")


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, state: str | None = None) -> DataFrame:
    """(path, content, mtime_ns, size) of the files under ``root`` that no rule of ``ignore`` names.

    Rules are globs in the style of ignore files, see ``ignore_pattern``; ``state`` is the
    repository's own folder, relative to ``root``.  Paths are relative.  Spark's readers leave
    out names that begin with a dot or an underscore; add such files as rows of their own.
    Contents are read only by plans that use them.
    """
    rules = [*ALWAYS, *([f"/{state.strip('/')}/"] if state else []), *(ignore or [])]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    base = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    relative = F.substring(at, len(base) + 2, 1 << 30)
    mtime = (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    tree = files.select(relative.alias("path"), "content", mtime, F.col("length").alias("size"))
    return tree.where(~F.col("path").rlike(ignore_pattern(rules)))


def ignore_rules(spark: SparkSession, path: str) -> list[str]:
    """The lines of an ignore file, hidden or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
