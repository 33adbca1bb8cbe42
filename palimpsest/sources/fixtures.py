"""Versioned tables derived from the relational test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: "Now" of every retention query.
NOW = "2024-01-31 00:00:00"


class Fixtures:
    """Derived tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def snapshots(self) -> DataFrame:
        """An order is a snapshot on its customer's branch; a first order forks from that of customer k // 2."""
        o = self.table("orders").select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("c"),
            F.col("o_orderdate").alias("created_at"),
            F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("message"),
        )
        o = o.withColumn("prev", F.lag("k").over(W.partitionBy("c").orderBy("created_at", "k")))
        firsts = o.groupBy(F.col("c").alias("fc")).agg(F.min_by("k", F.struct("created_at", "k")).alias("fk"))
        fork = (F.col("fc") == F.floor(F.col("c") / 2)) & (F.col("c") > 1) & F.col("prev").isNull()
        return o.join(firsts, fork, "left").select(
            F.col("k").cast("string").alias("hash"),
            "message",
            F.concat(F.lit("c"), "c").alias("branch"),
            F.coalesce(F.col("prev").cast("string"), F.col("fk").cast("string"), F.lit("")).alias("parent_hash"),
            F.lit("").alias("merge_parent"),
            "created_at",
            F.col("k").alias("seq"),
        )

    @cached_property
    def file_map(self) -> DataFrame:
        path = F.concat(F.lit("d"), F.col("l_partkey") % 3, F.lit("/f"), F.col("l_partkey") % 8)
        rows = self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("snapshot_hash"), path.alias("path"), F.concat("l_returnflag", "l_linestatus").alias("h")
        )
        return rows.groupBy("snapshot_hash", "path").agg(F.min("h").alias("hash"))

    @cached_property
    def tags(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("snapshot_hash"))
        v = o.where("o_orderkey % 97 = 0").select(F.concat(F.lit("v"), "snapshot_hash").alias("name"), "snapshot_hash")
        rel = o.where("o_orderkey % 485 = 0").select(F.concat(F.lit("rel-"), "snapshot_hash").alias("name"), "snapshot_hash")
        return v.unionByName(rel)

    @cached_property
    def trash(self) -> DataFrame:
        e = self.table("events").where("event_type = 'error'")
        none = F.lit("")
        return e.select(
            F.concat(F.lit("e"), "event_id").alias("hash"),
            none.alias("message"),
            F.concat(F.lit("c"), "user_id").alias("branch"),
            none.alias("parent_hash"),
            none.alias("merge_parent"),
            (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("created_at"),
            F.col("ts").alias("deleted_at"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def index_cache(self) -> DataFrame:
        return self._parts(F.col("p_size"))

    @cached_property
    def live_files(self) -> DataFrame:
        """The cached files as they are now: some with a later time, some gone."""
        size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
        return self._parts(size, F.col("p_partkey") % 11 != 0)

    def _parts(self, size, keep=None) -> DataFrame:
        p = self.table("part")
        return (p if keep is None else p.where(keep)).select(
            F.concat(F.lit("p/"), "p_partkey").alias("path"),
            (size.cast("long") * 1_000_000_000).alias("mtime_ns"),
            F.length("p_name").cast("long").alias("size"),
            F.col("p_brand").alias("hash"),
        )

    @cached_property
    def stash(self) -> DataFrame:
        s = self.snapshots.where("seq % 499 = 0")
        return s.select(
            F.col("seq").alias("id"), F.concat(F.lit("shelf-"), "hash").alias("name"), F.col("hash").alias("snapshot_hash"), "branch", "parent_hash", "created_at"
        )

    @cached_property
    def doc_versions(self) -> DataFrame:
        """Documents of a source as versions of one file, in the order of their ids."""
        return self.table("documents").select(
            F.col("source").alias("path"),
            F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("version"),
            F.md5(F.col("text").cast("binary")).alias("hash"),
            "text",
        )

    @cached_property
    def objects(self) -> DataFrame:
        d = self.table("documents").select(F.md5(F.col("text").cast("binary")).alias("hash"), "text")
        return d.groupBy("hash").agg(F.min("text").alias("content")).withColumn("length", F.length("content").cast("long"))

    @cached_property
    def lines(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), F.col("text").alias("line"))

    @cached_property
    def merge_pairs(self) -> DataFrame:
        """Siblings: (base, ours, theirs) with one non-empty parent, ours before theirs as text."""
        s = self.snapshots.where("parent_hash <> ''").select("hash", "parent_hash")
        a = s.select(F.col("parent_hash").alias("base"), F.col("hash").alias("ours"))
        b = s.select(F.col("parent_hash").alias("base"), F.col("hash").alias("theirs"))
        return a.join(b, "base").where("ours < theirs")

    @cached_property
    def ranges(self) -> DataFrame:
        start = F.col("l_partkey") % 50
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("path"),
            F.when(F.col("l_linenumber") % 2 == 1, "ours").otherwise("theirs").alias("side"),
            start.alias("start"),
            (start + F.col("l_suppkey") % 4).alias("end"),
        )
