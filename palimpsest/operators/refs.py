"""Branches, tags, references and history listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DELETED_PREFIX, or_empty, visible



def latest_per_branch(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every branch by (created_at, seq); one partial aggregate, no window."""
    newest = F.max(F.struct("created_at", "seq", "hash", "message", "parent_hash"))
    return snapshots.groupBy("branch").agg(newest.alias("x")).select("branch", "x.hash", "x.message", "x.parent_hash", "x.created_at", "x.seq")


def branches(snapshots: DataFrame, current: str | None = None) -> DataFrame:
    """Visible branches with their newest snapshot; the current one is listed even without any."""
    found = latest_per_branch(snapshots).where(visible(F.col("branch")))
    if current is not None:
        head = snapshots.sparkSession.createDataFrame([(current,)], "branch string")
        found = found.join(head, "branch", "full_outer")
    return found.withColumn("is_current", F.col("branch") == F.lit(current) if current is not None else F.lit(False))


def tag_listing(tags: DataFrame, snapshots: DataFrame) -> DataFrame:
    s = snapshots.select(F.col("hash").alias("snapshot_hash"), "message")
    return tags.join(s, "snapshot_hash", "left").select("name", "snapshot_hash", F.coalesce("message", F.lit("(deleted)")).alias("message"))


def redirect_tags(tags: DataFrame, moves: DataFrame) -> DataFrame:
    """``tags`` with snapshots replaced as ``moves`` (old, new) says."""
    return tags.join(moves, tags["snapshot_hash"] == moves["old"], "left").select("name", F.coalesce("new", "snapshot_hash").alias("snapshot_hash"))


def rename_branch(snapshots: DataFrame, old: str, new: str) -> DataFrame:
    return snapshots.withColumn("branch", F.when(F.col("branch") == old, F.lit(new)).otherwise(F.col("branch")))


def soft_delete(snapshots: DataFrame, branch: str) -> DataFrame:
    return rename_branch(snapshots, branch, DELETED_PREFIX + branch)


def resolve(names: DataFrame, tags: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every ``name`` as (name, kind, hash): a tag, else a hash prefix, else a branch tip.

    ``kind`` is tag, prefix, ambiguous, branch or unknown.  Prefixes join on equality: for
    each length that occurs among the names, hashes are cut to that length.
    """
    asked = names.select("name").distinct()
    lengths = [r[0] for r in asked.select(F.length("name")).distinct().collect() if 0 < r[0] <= 64]
    cuts = F.explode(F.array(*[F.lit(n) for n in lengths])) if lengths else F.explode(F.array().cast("array<int>"))
    heads = snapshots.select("hash", cuts.alias("n")).where(F.col("n") <= F.length("hash")).select(F.expr("substring(hash, 1, n)").alias("name"), "hash")
    wanted = heads.join(asked, "name", "left_semi")
    by_prefix = wanted.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("ph"))
    by_tag = tags.select("name", F.col("snapshot_hash").alias("th"))
    tips = latest_per_branch(snapshots).select(F.col("branch").alias("name"), F.col("hash").alias("bh"))
    j = asked.join(by_tag, "name", "left").join(by_prefix, "name", "left").join(tips, "name", "left")
    kind = F.when(F.col("th").isNotNull(), "tag").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous")
    kind = kind.when(F.col("bh").isNotNull(), "branch").otherwise("unknown")
    found = F.when(F.col("kind") == "tag", F.col("th")).when(F.col("kind") == "prefix", F.col("ph")).when(F.col("kind") == "branch", F.col("bh"))
    return j.withColumn("kind", kind).select("name", "kind", or_empty(found).alias("hash"))


def history(snapshots: DataFrame, tags: DataFrame, branch: str | None = None, limit: int | None = None) -> DataFrame:
    """Visible snapshots, newest first, one row for each tag of a snapshot; ``limit`` counts those rows."""
    s = snapshots.where(visible(F.col("branch"))) if branch is None else snapshots.where(F.col("branch") == branch)
    t = tags.select(F.col("snapshot_hash").alias("hash"), F.col("name").alias("tag"))
    out = s.join(t, "hash", "left").select("hash", "branch", "message", "parent_hash", "created_at", "seq", or_empty(F.col("tag")).alias("tag"))
    return out if limit is None else out.orderBy(F.desc("created_at"), F.desc("seq"), "tag").limit(limit)


def containing(snapshots: DataFrame, file_map: DataFrame, path: str) -> DataFrame:
    """Snapshots whose manifest has ``path``."""
    at = file_map.where(F.col("path") == path).select(F.col("snapshot_hash").alias("hash"))
    return snapshots.join(at, "hash", "left_semi")


def touching(snapshots: DataFrame, file_map: DataFrame, path: str) -> DataFrame:
    """Snapshots in which ``path`` differs from the parent's: added, changed or deleted."""
    at = file_map.where(F.col("path") == path)
    own = at.select(F.col("snapshot_hash").alias("hash"), F.col("hash").alias("new"))
    old = at.select(F.col("snapshot_hash").alias("parent_hash"), F.col("hash").alias("old"))
    j = snapshots.join(own, "hash", "left").join(old, "parent_hash", "left")
    return j.where(or_empty(F.col("new")) != or_empty(F.col("old"))).select(*snapshots.columns)


def numbered(history_rows: DataFrame) -> DataFrame:
    """Newest-first positions; for short listings only, as the numbering passes one task."""
    return history_rows.withColumn("position", F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("seq"), "tag")))
