"""Manifests: what changed, and the manifests that follow from changes.

A manifest is (snapshot_hash, path, hash); operators work on any number of snapshots at
once, keyed by ``keys`` besides the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import or_empty

NEW, MODIFIED, DELETED = "New", "Modified", "Deleted"


def compare(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Full outer join of two manifests on ``keys`` and path: (*keys, path, old_hash, new_hash, status).

    ``status`` is New, Modified, Deleted or Same; content never has to be read.
    """
    on = [*(keys or []), "path"]
    a = old.select(*on, F.col("hash").alias("o"))
    b = new.select(*on, F.col("hash").alias("n"))
    j = a.join(b, on, "full_outer").select(*on, or_empty(F.col("o")).alias("old_hash"), or_empty(F.col("n")).alias("new_hash"))
    return j.withColumn("status", _status())


def _status() -> Column:
    status = F.when(F.col("old_hash") == "", NEW).when(F.col("new_hash") == "", DELETED)
    return status.when(F.col("old_hash") != F.col("new_hash"), MODIFIED).otherwise("Same")


def against_parent(snapshots: DataFrame, file_map: DataFrame) -> DataFrame:
    """Every snapshot with a parent compared with it: (snapshot_hash, path, old_hash, new_hash, status).

    A manifest goes once to its own snapshot and once to each child; one aggregate by snapshot
    and path puts both sides together, without joining manifests.
    """
    side = lambda at, own: F.struct(F.col(at).alias("at"), F.col("hash").alias("child"), F.lit(own).alias("own"))
    sides = snapshots.where("parent_hash <> ''").select(F.explode(F.array(side("hash", True), side("parent_hash", False))).alias("x")).select("x.*")
    rows = file_map.join(sides, F.col("snapshot_hash") == F.col("at"))
    of = lambda own: or_empty(F.max(F.when(F.col("own") == own, F.col("hash"))))
    both = rows.groupBy(F.col("child").alias("snapshot_hash"), "path").agg(of(False).alias("old_hash"), of(True).alias("new_hash"))
    return both.withColumn("status", _status())


def manifests_of(pairs: DataFrame, side: str, file_map: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, path, hash) of the snapshot that each pair names in column ``side``."""
    named = pairs.select(*{k: None for k in [*keys, side]})
    return named.join(file_map.withColumnRenamed("snapshot_hash", side), side).select(*keys, "path", "hash")


def probe_cache(live: DataFrame, cache: DataFrame) -> DataFrame:
    """``live`` (path, mtime_ns, size) with the cached ``hash`` where all three agree, and ``hit``."""
    known = cache.select("path", "mtime_ns", "size", "hash")
    return live.select("path", "mtime_ns", "size").join(known, ["path", "mtime_ns", "size"], "left").select(
        "path", "mtime_ns", "size", or_empty(F.col("hash")).alias("hash"), F.col("hash").isNotNull().alias("hit")
    )


def carry_forward(parent: DataFrame, dirty: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The entries of ``parent`` that ``dirty`` does not touch."""
    on = [*(keys or []), "path"]
    return parent.join(dirty.select(*on), on, "left_anti")


def overlaid(base: DataFrame, writes: DataFrame, deletes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``base`` with ``writes`` put over it and ``deletes`` taken out: (*keys, path, hash)."""
    on = [*(keys or []), "path"]
    gone = writes.select(*on).unionByName(deletes.select(*on))
    return base.join(gone, on, "left_anti").select(*on, "hash").unionByName(writes.select(*on, "hash"))


def copied(file_map: DataFrame, moves: DataFrame) -> DataFrame:
    """Manifests of ``moves`` (old, new) under their new names."""
    return file_map.join(moves, F.col("snapshot_hash") == F.col("old")).select(F.col("new").alias("snapshot_hash"), "path", "hash")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def ghosts(live: DataFrame, manifest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Live paths that the manifest lacks."""
    on = [*(keys or []), "path"]
    return live.select(*on).join(manifest.select(*on), on, "left_anti")


def new_objects(candidates: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of ``candidates`` (hash, ...) for each digest that ``objects`` lacks."""
    return candidates.dropDuplicates(["hash"]).join(objects.select("hash"), "hash", "left_anti")
