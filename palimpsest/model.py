"""Schemas of the state tables, identifiers and errors.

"No value" is the empty string, never null.  Snapshots carry ``seq``, a number that grows
with insertion, because creation times have a resolution of one second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMAS = {
    "snapshots": "hash string, message string, branch string, parent_hash string, merge_parent string, created_at timestamp, seq bigint",
    "file_map": "snapshot_hash string, path string, hash string",
    "objects": "hash string, content binary",
    "tags": "name string, snapshot_hash string",
    "trash": "hash string, message string, branch string, parent_hash string, merge_parent string, created_at timestamp, seq bigint, deleted_at timestamp",
    "index_cache": "path string, mtime_ns bigint, size bigint, hash string",
    "stash": "id bigint, name string, snapshot_hash string, branch string, parent_hash string, created_at timestamp",
    "conflict_files": "path string, ancestor_hash string, our_hash string, their_hash string",
    "hunk_decisions": "file_path string, hunk_id bigint, decision string, manual_content string",
}
KEYS = {
    "tags": ["name"],
    "index_cache": ["path"],
    "conflict_files": ["path"],
    "hunk_decisions": ["file_path", "hunk_id"],
    "objects": ["hash"],
}
DECISIONS = ("ours", "theirs", "both_ours", "both_theirs", "manual")
DELETED_PREFIX, STASH_BRANCH = "_deleted_", "_stash"


class PalimpsestError(Exception):
    """Base of all errors of this package."""


class NotARepo(PalimpsestError):
    pass


class AlreadyInitialized(PalimpsestError):
    pass


class NestedRepo(PalimpsestError):
    pass


class InvalidInput(PalimpsestError):
    pass


class CorruptRepo(PalimpsestError):
    pass


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def visible(branch: Column) -> Column:
    """False for branches that are hidden: deleted ones and the shelf branch."""
    return ~branch.startswith(DELETED_PREFIX) & ~branch.startswith(STASH_BRANCH)


def snapshot_id(message: Column, branch: Column, parent: Column, created_at: Column, seq: Column) -> Column:
    """First 12 hex digits of a digest of the fields; the time is passed in, so ids are reproducible."""
    stamp = F.date_format(created_at, "yyyy-MM-dd HH:mm:ss")
    return F.substring(F.sha2(F.concat_ws("\x00", message, branch, parent, stamp, seq.cast("string")), 256), 1, 12)
