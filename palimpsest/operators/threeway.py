"""Three-way decisions.  a: ancestor, o: ours, t: theirs; '' where a path is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import InvalidInput, or_empty

POLICIES = ("merge", "cherry_pick", "rebase")


def action(policy: str) -> Column:
    """What to do with a path; the first condition that holds decides.

    skip, keep, keep_deleted_theirs (kept, with a warning), add, update, delete, conflict.
    """
    a, o, t = F.col("base_hash"), F.col("our_hash"), F.col("their_hash")
    if policy == "merge":
        taken = F.when(o == t, "skip").when((o == a) & (t == ""), "delete").when((o == a) & (a == ""), "add").when(o == a, "update")
        return taken.when(t == a, "keep").when(t == "", "keep_deleted_theirs").when(o == "", "update").otherwise("conflict")
    if policy == "cherry_pick":
        taken = F.when(t == a, "skip").when((o == a) & (t == ""), "delete").when(o == a, F.when(a == "", "add").otherwise("update"))
        return taken.when(o == t, "skip").when(t == "", "keep_deleted_theirs").otherwise("conflict")
    if policy == "rebase":
        taken = F.when(t == a, "keep").when((o == a) & (t == ""), "delete").when(o == a, F.when(a == "", "add").otherwise("update"))
        return taken.when(o == t, "skip").otherwise("conflict")
    raise InvalidInput(f"unknown policy: {policy!r}")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, policy: str, keys: list[str] | None = None) -> DataFrame:
    """(*keys, path, base_hash, our_hash, their_hash, action) for every path of ours or theirs;
    under ``rebase`` also for those of the ancestor alone."""
    on = [*(keys or []), "path"]
    o = ours.select(*on, F.col("hash").alias("o"))
    t = theirs.select(*on, F.col("hash").alias("t"))
    a = base.select(*on, F.col("hash").alias("a"))
    sides = o.join(t, on, "full_outer")
    j = sides.join(a, on, "full_outer" if policy == "rebase" else "left")
    j = j.select(*on, or_empty(F.col("a")).alias("base_hash"), or_empty(F.col("o")).alias("our_hash"), or_empty(F.col("t")).alias("their_hash"))
    return j.withColumn("action", action(policy))


def merged_manifest(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, path, hash) after a plan; a conflict keeps ours until it is resolved."""
    taken = F.when(F.col("action").isin("add", "update"), F.col("their_hash")).when(F.col("action") == "delete", F.lit(""))
    return plan.select(*(keys or []), "path", taken.otherwise(F.col("our_hash")).alias("hash")).where("hash <> ''")
