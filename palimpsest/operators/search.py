"""Search by regular expression with context, as column expressions and one window."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines as split_lines
from ..model import InvalidInput


def checked(pattern: str, ignore_case: bool = False) -> str:
    """The pattern, if the engine that will run it accepts it and it has no look-around or back references."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError) as e:
        raise InvalidInput(f"bad pattern: {e}") from e
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise InvalidInput("look-around and back references are not supported")
    return ("(?i)" if ignore_case else "") + pattern


def numbered_lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no from 1, line) of texts that are valid and not binary."""
    t = texts.where(F.is_valid_utf8(text) & ~F.contains(F.substring(text, 1, 1024), F.lit("\x00")))
    return t.select(path, F.posexplode(split_lines(F.col(text))).alias("k", "line")).select(path, (F.col("k") + 1).alias("line_no"), "line")


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    return lines.where(F.col("line").rlike(checked(pattern, ignore_case)))


def grep_files(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    return grep(lines, pattern, ignore_case).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def grep_context(lines: DataFrame, pattern: str, context: int = 2, ignore_case: bool = False) -> DataFrame:
    """(path, line_no, line, is_match, new_block): matches with ``context`` lines each side, each line once.

    ``new_block`` marks a line that does not follow the line before it.
    """
    near = W.partitionBy("path").orderBy("line_no").rowsBetween(-context, context)
    hit = lines.withColumn("is_match", F.col("line").rlike(checked(pattern, ignore_case)))
    shown = hit.withColumn("shown", F.max("is_match").over(near)).where("shown").drop("shown")
    before = F.lag("line_no").over(W.partitionBy("path").orderBy("line_no"))
    return shown.withColumn("new_block", F.coalesce(F.col("line_no") - before > 1, F.lit(True)))


def match_spans(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(path, line_no, nth, start, end, text): every match of every line, in code points from 0, end exclusive.

    Lengths of the matches and of what lies between them, added up along the line.
    """
    p = F.lit(checked(pattern, ignore_case))
    found = lines.where(F.col("line").rlike(checked(pattern, ignore_case))).select("path", "line_no", F.regexp_extract_all("line", p, F.lit(0)).alias("m"), F.split("line", checked(pattern, ignore_case), -1).alias("gap"))
    each = found.select("path", "line_no", F.posexplode(F.arrays_zip("gap", "m")).alias("nth", "x"))
    gone = F.length("x.gap") + F.coalesce(F.length("x.m"), F.lit(0))
    end = F.sum(gone).over(W.partitionBy("path", "line_no").orderBy("nth"))
    spans = each.withColumn("end", end).where("x.m is not null")
    return spans.select("path", "line_no", "nth", (F.col("end") - F.length("x.m")).alias("start"), "end", F.col("x.m").alias("text"))
