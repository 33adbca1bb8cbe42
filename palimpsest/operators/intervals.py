"""Half-open line ranges; one of width zero is an insertion point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Two wide ranges share a line; a point touches a range at either end; two points are equal."""
    point1, point2 = s1 == e1, s2 == e2
    return (
        F.when(point1 & point2, s1 == s2)
        .when(point1, (s2 <= s1) & (s1 <= e2))
        .when(point2, (s1 <= s2) & (s2 <= e1))
        .otherwise((s1 < e2) & (s2 < e1))
    )


#: Lines in a bin of the join of ranges.
BIN = 256


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of one path's ours and theirs ranges that overlap: an equi-join on path and bin with a condition.

    Both ranges of a pair hold the later of their starts, so the pair is taken in its bin and
    nowhere else; a path with very many ranges spreads over its bins.
    """
    place = lambda c: F.floor(c / BIN)

    def side(s: str) -> DataFrame:
        bins = F.explode(F.sequence(place(F.col("start")), place(F.col("end")))).alias("bin")
        return ranges.where(F.col("side") == s).select("path", bins, F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"))

    meet = overlapping(F.col("ours_start"), F.col("ours_end"), F.col("theirs_start"), F.col("theirs_end"))
    here = F.col("bin") == place(F.greatest("ours_start", "theirs_start"))
    return side("ours").join(side("theirs"), ["path", "bin"]).where(here & meet).drop("bin")


def coalesced(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of each key merged where they overlap or touch: (*keys, start, end).

    Equal ranges share an island whatever their order: its number counts all breaks up to and among
    them.  Nulls come last, so that an open end hides none; a range that lacks a bound and begins an
    island stays by itself.
    """
    order = W.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last())
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)
    island = F.sum("begins").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    alone = F.when((F.col("begins") == 1) & (F.col("start").isNull() | F.col("end").isNull()), F.row_number().over(order))
    r = ranges.withColumn("reach", reach).withColumn("begins", begins).withColumn("alone", alone).withColumn("island", island)
    return r.groupBy(*keys, "island", "alone").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island", "alone")
