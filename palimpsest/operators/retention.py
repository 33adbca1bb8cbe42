"""Undo, redo and garbage collection as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .refs import latest_per_branch


def undo(snapshots: DataFrame, tags: DataFrame, trash: DataFrame, branches: DataFrame, deleted_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves the newest snapshot of each of ``branches`` to the trash and drops its tags; merge parents stay recorded."""
    tips = latest_per_branch(snapshots.join(branches.select("branch"), "branch", "left_semi")).select("hash")
    gone = snapshots.join(tips, "hash", "left_semi").withColumn("deleted_at", deleted_at)
    left = snapshots.join(tips, "hash", "left_anti")
    kept = tags.join(tips.withColumnRenamed("hash", "snapshot_hash"), "snapshot_hash", "left_anti").select("name", "snapshot_hash")
    return left, kept, trash.join(tips, "hash", "left_anti").unionByName(gone.select(*trash.columns))


def redo_top(trash: DataFrame) -> DataFrame:
    """The entry that a redo takes from each branch: the last deleted, ties by seq."""
    rest = [c for c in trash.columns if c not in ("branch", "deleted_at", "seq")]
    top = trash.groupBy("branch").agg(F.max(F.struct("deleted_at", "seq", *rest)).alias("x"))
    return top.select("branch", "x.*").select(*trash.columns)


def expired(trash: DataFrame, now, keep_days: int) -> DataFrame:
    return trash.where(F.col("deleted_at") <= now - F.make_interval(days=F.lit(keep_days)))


def orphan_manifests(file_map: DataFrame, snapshots: DataFrame, trash: DataFrame) -> DataFrame:
    """Entries whose snapshot is neither live nor in the trash."""
    for known in (snapshots, trash):
        file_map = file_map.join(known.select(F.col("hash").alias("snapshot_hash")), "snapshot_hash", "left_anti")
    return file_map


def stale_cache(cache: DataFrame, file_map: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Cache entries of paths that no live snapshot has."""
    live = file_map.join(snapshots.select(F.col("hash").alias("snapshot_hash")), "snapshot_hash", "left_semi").select("path")
    return cache.join(live, "path", "left_anti")


def stale_decisions(decisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    return decisions.join(conflicts.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def unreferenced(objects: DataFrame, file_map: DataFrame) -> DataFrame:
    return objects.join(file_map.select("hash"), "hash", "left_anti")
