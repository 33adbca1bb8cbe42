"""A repository of versioned files on any store that Spark can write.

Manifests and objects are only ever appended, in partitions named by the commit's number; the
small tables are rewritten; a commit is the state record that names them, written last.  A
reader trusts the newest complete record and reads partitions up to its number, and a writer
clears what a crashed one has left under the next number: a crash leaves the repository as
it was.  One writer works at a time.  The working tree is an argument: a DataFrame (path,
content), as :func:`palimpsest.sources.tree.read_tree` gives it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import digest, is_binary, normal_path, short_date, short_id, stored_text, under_any
from .model import DECISIONS, DELETED_PREFIX, KEYS, SCHEMAS, STASH_BRANCH, AlreadyInitialized, CorruptRepo, InvalidInput, NestedRepo, NotARepo, or_empty, snapshot_id
from .operators import ancestry, changes, refs, retention, search, textdiff, threeway

MAIN = "main"
APPENDED = ("file_map", "objects")


@dataclass
class State:
    branch: str = MAIN
    parent: str = ""
    seq: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    pending: dict = field(default_factory=dict)  # a merge, pick or rebase that waits for decisions


class Repo:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        records = self._listed("state")
        if not records:
            raise NotARepo(path)
        self.version = max(records)
        text = self.spark.read.text(f"{self.path}/state/{self.version:08d}").first()[0]
        self.state = State(**json.loads(text))

    # Storage ------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Repo:
        self = cls.__new__(cls)
        self.spark, self.path, self.version, self.state = spark, path.rstrip("/"), -1, State()
        if self._listed("state"):
            raise AlreadyInitialized(path)
        at = self._jpath().getParent()
        while at is not None:
            if self._fs().exists(self._jpath(f"{at}/tables/file_map")) and self._fs().exists(self._jpath(f"{at}/state")):
                raise NestedRepo(f"{path} lies in {at}")
            at = at.getParent()
        self._commit({name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
        return self

    def _jpath(self, at: str | None = None):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at or self.path)

    def _fs(self):
        return self._jpath().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[int]:
        fs, at = self._fs(), self._jpath(f"{self.path}/{folder}")
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(self._jpath(f"{s.getPath()}/_SUCCESS"))]
        return [int(p.getName()) for p in done]

    def table(self, name: str) -> DataFrame:
        at = f"{self.path}/tables/{name}/{self.state.tables[name]}"
        if name not in APPENDED:
            df = self.spark.read.schema(SCHEMAS[name]).parquet(at)
            # Tables from before merges were recorded lack the column, which then reads as null.
            return df.withColumn("merge_parent", or_empty(F.col("merge_parent"))) if "merge_parent" in df.columns else df
        return self.spark.read.schema(f"{SCHEMAS[name]}, commit bigint").parquet(at).where(F.col("commit") <= self.version).drop("commit")

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def _commit(self, changed: dict[str, DataFrame], appended: tuple[str, ...] = (), **state) -> None:
        """Writes rewritten tables, then the record that makes them and the rows of ``appended`` tables count."""
        tables, n = dict(self.state.tables), self.version + 1
        if n in self._listed("state"):
            raise InvalidInput("another writer has committed: open the repository again")
        for name, df in changed.items():
            at = f"{n:08d}"
            part = f"/commit={n}" if name in APPENDED else ""
            df.select(*self._columns(name)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/tables/{name}/{at}{part}")
            tables[name] = at
        for name in APPENDED:
            if name not in changed and name not in appended:  # left by a writer that crashed
                self._fs().delete(self._jpath(f"{self.path}/tables/{name}/{tables[name]}/commit={n}"), True)
        new = State(**{**vars(self.state), **state, "tables": tables})
        record = self.spark.createDataFrame([(json.dumps(vars(new)),)], "value string").coalesce(1)
        record.write.mode("overwrite").text(f"{self.path}/state/{n:08d}")
        self.state, self.version = new, n

    def _append(self, name: str, df: DataFrame) -> None:
        """Rows that count from the next commit on, once for each; they replace what a crashed writer left."""
        at = f"{self.path}/tables/{name}/{self.state.tables[name]}/commit={self.version + 1}"
        df.select(*self._columns(name)).write.mode("overwrite").option("compression", "zstd").parquet(at)

    # References -----------------------------------------------------------------------------------

    def resolve_ref(self, name: str) -> str:
        """A tag, a hash prefix, a branch tip, in this order."""
        row = refs.resolve(self.spark.createDataFrame([(name,)], "name string"), self.table("tags"), self.table("snapshots")).first()
        if row["kind"] == "ambiguous":
            raise InvalidInput(f"ambiguous reference: {name}")
        if row["kind"] == "unknown":
            raise InvalidInput(f"unknown reference: {name}")
        return row["hash"]

    def manifest(self, snapshot: str) -> DataFrame:
        if not snapshot:
            return self.spark.createDataFrame([], "path string, hash string")
        return self.table("file_map").where(F.col("snapshot_hash") == snapshot).select("path", "hash").distinct()

    def _tip(self, branch: str) -> str:
        row = refs.latest_per_branch(self.table("snapshots").where(F.col("branch") == branch)).first()
        return row["hash"] if row else ""

    def history(self, branch: str | None = None, limit: int | None = 20, path: str | None = None, touched: bool = False) -> DataFrame:
        """Newest first; the file filter comes before the limit."""
        s = self.table("snapshots")
        if path:
            s = (refs.touching if touched else refs.containing)(s, self.table("file_map"), path.replace("\\", "/"))
        return refs.history(s, self.table("tags"), branch, limit)

    def history_graph(self, limit: int = 20) -> DataFrame:
        page = refs.numbered(refs.history(self.table("snapshots"), self.table("tags").limit(0), limit=limit))
        merged = self.table("snapshots").select("hash", "merge_parent")
        return textdiff.graph_lanes(page.join(merged, "hash"))

    def branches(self) -> DataFrame:
        return refs.branches(self.table("snapshots"), self.state.branch)

    def tags(self) -> DataFrame:
        return refs.tag_listing(self.table("tags"), self.table("snapshots"))

    def tag(self, name: str, ref: str | None = None, force: bool = False) -> None:
        target = self.resolve_ref(ref) if ref else self.state.parent
        if not target:
            raise InvalidInput("nothing to tag")
        tags = self.table("tags")
        if not force and tags.where(F.col("name") == name).limit(1).count():
            raise InvalidInput(f"tag exists: {name}")
        new = self.spark.createDataFrame([(name, target)], SCHEMAS["tags"])
        self._commit({"tags": changes.upserted(tags, new, KEYS["tags"])})

    def delete_tag(self, name: str) -> None:
        tags = self.table("tags")
        if not tags.where(F.col("name") == name).limit(1).count():
            raise InvalidInput(f"unknown tag: {name}")
        self._commit({"tags": tags.where(F.col("name") != name)})

    def switch(self, branch: str, working: DataFrame | None = None) -> str:
        """The tip of ``branch``; an unknown name starts a branch at the present position.

        A ``working`` tree that is passed in, here and below, must have no changes.
        """
        self._clean(working)
        if branch.startswith(DELETED_PREFIX):
            raise InvalidInput("deleted branches cannot be switched to")
        self._idle()
        self._commit({}, branch=branch, parent=self._tip(branch) or self.state.parent)
        return self.state.parent

    def delete_branch(self, name: str) -> None:
        if name in (self.state.branch, MAIN):
            raise InvalidInput(f"cannot delete {name}")
        if not self._tip(name):
            raise InvalidInput(f"unknown branch: {name}")
        self._commit({"snapshots": refs.soft_delete(self.table("snapshots"), name)})

    # Working tree -----------------------------------------------------------------------------------

    def _hashed(self, working: DataFrame) -> DataFrame:
        """(path, hash, content) in storage form: text without carriage returns, binary as it is."""
        text = F.col("content").cast("string")
        clean = F.when(F.is_valid_utf8(text), stored_text(text).cast("binary")).otherwise(F.col("content").cast("binary"))
        w = working.withColumns({"path": normal_path(F.col("path")), "content": clean})
        own = digest(F.col("content"))
        if {"mtime_ns", "size"} <= set(working.columns):  # a file that the cache knows is not hashed again
            known = self.table("index_cache").withColumnRenamed("hash", "__known")
            w = w.join(known, ["path", "mtime_ns", "size"], "left")
            own = F.coalesce("__known", own)
        return w.select("path", own.alias("hash"), "content")

    def status(self, working: DataFrame, ref: str | None = None, paths: list[str] | None = None) -> DataFrame:
        base = self.manifest(self.resolve_ref(ref) if ref else self.state.parent)
        found = changes.compare(base, self._hashed(working).select("path", "hash"))
        return found.where("status <> 'Same'").where(under_any(F.col("path"), paths or []))

    def _clean(self, working: DataFrame | None) -> None:
        if working is not None and self.status(working).limit(1).count():
            raise InvalidInput("the working tree has changes")

    def _idle(self) -> None:
        if self.state.pending:
            raise InvalidInput("a merge waits for decisions")

    def _snapshot(self, manifest: DataFrame, message: str, branch: str, parent: str, merge_parent: str = "", now: datetime | None = None) -> DataFrame:
        """Appends the manifest and gives the row that will make it count."""
        now = (now or datetime.now(UTC)).replace(microsecond=0, tzinfo=None)
        seq = self.state.seq + 1
        row = self.spark.createDataFrame([("", message, branch, parent, merge_parent, now, seq)], SCHEMAS["snapshots"])
        row = row.withColumn("hash", snapshot_id(F.col("message"), F.col("branch"), F.col("parent_hash"), F.col("created_at"), F.col("seq")))
        h = row.first()["hash"]
        self._append("file_map", manifest.select(F.lit(h).alias("snapshot_hash"), "path", "hash"))
        self.state.seq = seq
        self._last = h
        return row

    def _put(self, objects: DataFrame) -> None:
        self._append("objects", changes.new_objects(objects.select("hash", "content"), self.table("objects")))

    def save(self, working: DataFrame, message: str, paths: list[str] | None = None, amend: bool = False, now: datetime | None = None) -> dict | None:
        """Records the changes under ``paths``; None if there are none.

        ``amend`` replaces the tip: the new snapshot starts from the tip's files and keeps its
        parent, and tags and children of the tip move to it.
        """
        if not message.strip():
            raise InvalidInput("empty message")
        dirty = self.status(working, paths=paths).cache()
        counts = {r["status"]: r["count"] for r in dirty.groupBy("status").count().collect()}
        if not counts and not amend:
            return None
        tip, snapshots, tags = self.state.parent, self.table("snapshots"), self.table("tags")
        if amend and not tip:
            raise InvalidInput("nothing to amend")
        files = self._hashed(working).join(dirty.where("new_hash <> ''").select("path"), "path", "left_semi")
        self._put(files)
        manifest = changes.overlaid(self.manifest(tip), files.select("path", "hash"), dirty.where("new_hash = ''").select("path"))
        parent = snapshots.where(F.col("hash") == tip).first()["parent_hash"] if amend else tip
        row = self._snapshot(manifest, message.strip(), self.state.branch, parent, now=now)
        changed = {"snapshots": snapshots.unionByName(row), "trash": self.table("trash").where(F.col("branch") != self.state.branch)}
        if {"mtime_ns", "size"} <= set(working.columns):
            seen = working.select(normal_path(F.col("path")).alias("path"), "mtime_ns", "size").join(manifest, "path")
            changed["index_cache"] = changes.upserted(self.table("index_cache"), seen.join(files.select("path", "hash"), ["path", "hash"], "left_semi"), KEYS["index_cache"])
        if amend:
            rest = snapshots.where(F.col("hash") != tip)
            moved = F.when(F.col("parent_hash") == tip, F.lit(self._last)).otherwise(F.col("parent_hash"))
            changed["snapshots"] = rest.withColumn("parent_hash", moved).unionByName(row)
            changed["tags"] = refs.redirect_tags(tags, self.spark.createDataFrame([(tip, self._last)], "old string, new string"))
        self._commit(changed, APPENDED, parent=self._last)
        dirty.unpersist()
        return {"hash": self._last, "new": counts.get("New", 0), "modified": counts.get("Modified", 0), "deleted": counts.get("Deleted", 0)}

    def checkout(self, ref: str | None = None, paths: list[str] | None = None) -> DataFrame:
        """(path, hash, content) of a snapshot; a missing object raises when it is read."""
        m = self.manifest(self.resolve_ref(ref) if ref else self.state.parent).where(under_any(F.col("path"), paths or []))
        missing = F.raise_error(F.concat(F.lit("missing object "), "hash")).cast("binary")
        return m.join(self.table("objects").withColumn("there", F.lit(True)), "hash", "left").select(
            "path", "hash", F.when(F.col("there"), F.col("content")).otherwise(missing).alias("content")
        )

    def verify(self) -> None:
        lost = self.table("file_map").select("hash").join(self.table("objects"), "hash", "left_anti").limit(1).count()
        if lost:
            raise CorruptRepo("a manifest names an object that is missing")

    def restore(self, ref: str, working: DataFrame | None = None, force: bool = False, paths: list[str] | None = None) -> DataFrame:
        """The files to write; a whole restore moves the position."""
        if not force:
            self._clean(working)
        target = self.resolve_ref(ref)
        files = self.checkout(target, paths)
        if not paths:
            self._commit({}, parent=target)
        return files

    def ghosts(self, working: DataFrame, ref: str) -> DataFrame:
        return changes.ghosts(working.select(normal_path(F.col("path")).alias("path")), self.manifest(self.resolve_ref(ref)))

    # Undo and redo ------------------------------------------------------------------------------------

    def undo(self, now: datetime | None = None, working: DataFrame | None = None) -> str:
        self._idle()
        self._clean(working)
        tip = self._tip(self.state.branch)
        if not tip:
            raise InvalidInput("nothing to undo")
        snapshots = self.table("snapshots")
        parent = snapshots.where(F.col("hash") == tip).first()["parent_hash"]
        at = F.lit((now or datetime.now(UTC)).replace(tzinfo=None))
        here = self.spark.createDataFrame([(self.state.branch,)], "branch string")
        left, tags, trash = retention.undo(snapshots, self.table("tags"), self.table("trash"), here, at)
        # The trash is a stack: what was undone last gets the highest seq.
        top = trash.agg(F.max("seq")).first()[0] or 0
        trash = trash.withColumn("seq", F.when(F.col("hash") == tip, F.lit(max(top, self.state.seq) + 1)).otherwise(F.col("seq")))
        self._commit({"snapshots": left, "tags": tags, "trash": trash}, parent=parent, seq=max(top, self.state.seq) + 1)
        return parent

    def redo(self, working: DataFrame | None = None) -> str:
        self._idle()
        self._clean(working)
        top = retention.redo_top(self.table("trash").where(F.col("branch") == self.state.branch)).first()
        if top is None:
            raise InvalidInput("nothing to redo")
        seq = self.state.seq + 1
        back = self.table("trash").where(F.col("hash") == top["hash"]).drop("deleted_at").withColumn("seq", F.lit(seq).cast("long"))
        trash = self.table("trash").where(F.col("hash") != top["hash"])
        self._commit({"snapshots": self.table("snapshots").unionByName(back), "trash": trash}, parent=top["hash"], seq=seq)
        return top["hash"]

    # Texts ----------------------------------------------------------------------------------------------

    def _texts(self, manifest: DataFrame) -> DataFrame:
        o = self.table("objects").select("hash", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return manifest.join(o, "hash").select("path", "hash", "text")

    def diff_range(self, a: str, b: str, paths: list[str] | None = None, context: int = 3) -> DataFrame:
        """Lines that differ between two snapshots; equal digests are never read."""
        both = changes.compare(self.manifest(self.resolve_ref(a)), self.manifest(self.resolve_ref(b))).where("status <> 'Same'")
        return self._diff(both.where(under_any(F.col("path"), paths or [])), self.table("objects"), context)

    def diff(self, working: DataFrame, ref: str | None = None, paths: list[str] | None = None, context: int = 3) -> DataFrame:
        return self._diff(self.status(working, ref, paths), self.table("objects").unionByName(self._hashed(working).select("hash", "content")), context)

    def show(self, ref: str, paths: list[str] | None = None) -> DataFrame:
        h = self.resolve_ref(ref)
        parent = self.table("snapshots").where(F.col("hash") == h).first()["parent_hash"]
        both = changes.compare(self.manifest(parent), self.manifest(h)).where("status <> 'Same'").where(under_any(F.col("path"), paths or []))
        return self._diff(both, self.table("objects"), 3)

    def describe(self, ref: str) -> DataFrame:
        """One row on a snapshot: what ``show`` has above the lines, with short id and date, and counts of changed files."""
        h = self.resolve_ref(ref)
        row = refs.history(self.table("snapshots").where(F.col("hash") == h), self.table("tags"), limit=None)
        parent = self.table("snapshots").where(F.col("hash") == h).select("hash", "merge_parent")
        both = changes.compare(self.manifest(row.first()["parent_hash"]), self.manifest(h))
        count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
        counts = both.agg(count(changes.NEW), count(changes.MODIFIED), count(changes.DELETED))
        return row.join(parent, "hash").crossJoin(F.broadcast(counts)).select("*", short_id(F.col("hash")).alias("short"), short_date(F.col("created_at")).alias("date"))

    def _diff(self, pairs: DataFrame, objects: DataFrame, context: int) -> DataFrame:
        o = objects.dropDuplicates(["hash"]).select("hash", F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
        a, b = o.select(F.col("hash").alias("old_hash"), F.col("t").alias("old")), o.select(F.col("hash").alias("new_hash"), F.col("t").alias("new"))
        j = pairs.join(a, "old_hash", "left").join(b, "new_hash", "left").withColumn("version", F.lit(0))
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        binary = F.contains(F.substring(text("old"), 1, 1024), F.lit("\x00")) | F.contains(F.substring(text("new"), 1, 1024), F.lit("\x00"))
        return textdiff.line_diff(j.where(~binary).select("path", "version", text("old").alias("old"), text("new").alias("new")), context)

    def grep(self, pattern: str, ref: str | None = None, ignore_case: bool = False, context: int = 2) -> DataFrame:
        lines = search.numbered_lines(self._texts(self.manifest(self.resolve_ref(ref) if ref else self.state.parent)))
        return search.grep_context(lines, pattern, context, ignore_case)

    def blame(self, path: str, ref: str | None = None) -> DataFrame:
        """(line_no, line, hash): the first-parent snapshot that brought each line of ``path``."""
        start = self.resolve_ref(ref) if ref else self.state.parent
        up = ancestry.ancestors(self.spark.createDataFrame([(start,)], "start string"), self.table("snapshots"))
        held = up.join(self.table("file_map").where(F.col("path") == path.replace("\\", "/")).withColumnRenamed("hash", "object"), F.col("hash") == F.col("snapshot_hash"))
        if not held.where("depth = 0").limit(1).count():
            raise InvalidInput(f"not tracked: {path}")
        top = held.agg(F.max("depth")).first()[0]
        steps = held.withColumn("version", (F.lit(top) - F.col("depth")).cast("int"))
        texts = steps.join(self.table("objects").withColumnRenamed("hash", "object"), "object")
        versions = texts.select("path", "version", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return textdiff.blame(versions).join(steps.select("version", F.col("hash")), "version").select("line_no", "line", "hash")

    # Merging ------------------------------------------------------------------------------------------

    def _three(self, base: str, ours: str, theirs: str, policy: str) -> DataFrame:
        return threeway.three_way(self.manifest(base), self.manifest(ours), self.manifest(theirs), policy)

    def _apply(self, plan: DataFrame, message: str, merge_parent: str, pending: dict, now: datetime | None) -> dict:
        """Commits a plan without conflicts; otherwise keeps it until :meth:`resolve`."""
        plan = plan.cache()
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        if counts.get("conflict"):
            files = plan.where("action = 'conflict'").select("path", F.col("base_hash").alias("ancestor_hash"), "our_hash", "their_hash")
            self._commit({"conflict_files": files, "hunk_decisions": self.table("hunk_decisions").limit(0)}, pending={**pending, "message": message, "merge_parent": merge_parent})
            out = {"hash": "", "conflicts": counts["conflict"]}
        else:
            row = self._snapshot(threeway.merged_manifest(plan), message, self.state.branch, self.state.parent, merge_parent, now)
            self._commit({"snapshots": self.table("snapshots").unionByName(row)}, ("file_map",), parent=self._last, pending={})
            out = {"hash": self._last, "conflicts": 0}
        plan.unpersist()
        return {**out, **{k: counts.get(k, 0) for k in ("add", "update", "delete")}}

    def merge(self, branch: str, now: datetime | None = None, working: DataFrame | None = None) -> dict:
        """Fast forward, or a three-way merge with the nearest common ancestor; both record the merged parent."""
        self._idle()
        self._clean(working)
        if branch == self.state.branch:
            raise InvalidInput("cannot merge a branch into itself")
        theirs, ours = self._tip(branch), self.state.parent
        if not theirs or not ours:
            raise InvalidInput(f"no snapshot to merge: {branch}")
        pair = self.spark.createDataFrame([(ours, theirs)], "ours string, theirs string")
        base = ancestry.lca(pair, self.table("snapshots")).first()["base"]
        if base == theirs:
            return {"hash": ours, "conflicts": 0, "add": 0, "update": 0, "delete": 0}
        plan = self._three(base, ours, theirs, "merge")
        return self._apply(plan, f"merge {branch}", theirs, {"kind": "merge", "base": base, "theirs": theirs}, now)

    def cherry_pick(self, ref: str, now: datetime | None = None, working: DataFrame | None = None) -> dict:
        self._idle()
        self._clean(working)
        h = self.resolve_ref(ref)
        picked = self.table("snapshots").where(F.col("hash") == h).first()
        plan = self._three(picked["parent_hash"], self.state.parent, h, "cherry_pick")
        return self._apply(plan, picked["message"], "", {"kind": "cherry_pick", "base": picked["parent_hash"], "theirs": h}, now)

    def rebase(self, onto: str, now: datetime | None = None, working: DataFrame | None = None) -> dict:
        """Replays the snapshots that ``onto`` lacks, oldest first; stops at the first conflict."""
        self._idle()
        self._clean(working)
        target = self.resolve_ref(onto)
        pair = self.spark.createDataFrame([(self.state.parent, target)], "head string, onto string")
        queue = [r["hash"] for r in ancestry.commits_not_in(pair, self.table("snapshots")).orderBy(F.desc("depth")).collect()]
        if not queue:
            return {"hash": self.state.parent, "conflicts": 0}
        start = self.state.parent
        self._commit({}, parent=target)
        return self._replay(queue, {"kind": "rebase", "start": start, "old": queue}, now)

    def _replay(self, queue: list[str], pending: dict, now: datetime | None) -> dict:
        out = {"hash": self.state.parent, "conflicts": 0}
        while queue:
            h, queue = queue[0], queue[1:]
            step = self.table("snapshots").where(F.col("hash") == h).first()
            plan = self._three(step["parent_hash"], self.state.parent, h, "rebase")
            more = {**pending, "base": step["parent_hash"], "theirs": h, "queue": queue}
            out = self._apply(plan, step["message"], "", more, now)
            if out["conflicts"]:
                return out
        # The old chain leaves the branch: the new one stands for it.
        gone = self.spark.createDataFrame([(h,) for h in pending["old"]], "hash string")
        used = self.table("snapshots").join(gone, "hash", "left_anti").select("parent_hash").distinct()
        free = gone.join(used, F.col("hash") == F.col("parent_hash"), "left_anti")
        self._commit({"snapshots": self.table("snapshots").join(free, "hash", "left_anti")})
        return out

    def conflicts(self) -> DataFrame:
        return self.table("conflict_files").orderBy("path")

    def _conflict_texts(self) -> DataFrame:
        """(path, base, ours, theirs) of the files in conflict whose sides are all text."""
        return self._conflict_sides().where("is_text").select("path", *[F.coalesce(x, F.lit("")).alias(x) for x in ("base", "ours", "theirs")])

    def _conflict_sides(self) -> DataFrame:
        text = F.col("content").cast("string")
        o = self.table("objects").select("hash", text.alias("t"), (F.is_valid_utf8(text) & ~is_binary(text)).alias("ok"))
        c = self.table("conflict_files").withColumn("is_text", F.lit(True))
        for side, name in (("ancestor_hash", "base"), ("our_hash", "ours"), ("their_hash", "theirs")):
            c = c.join(o.select(F.col("hash").alias(side), F.col("t").alias(name), F.col("ok").alias("__ok")), side, "left")
            c = c.withColumn("is_text", F.col("is_text") & F.coalesce("__ok", F.lit(True))).drop("__ok")
        return c

    def _taken_whole(self, take: str) -> DataFrame:
        """(path, hash) of the files that are no texts: one side as it is, by its digest; '' if that side has none."""
        first = self.table("hunk_decisions").groupBy(F.col("file_path").alias("path")).agg(F.min(F.struct("hunk_id", "decision")).alias("d"))
        rows = self._conflict_sides().where("not is_text").join(first, "path", "left").withColumn("take", F.coalesce("d.decision", F.lit(take)))
        mixed = rows.where(~F.col("take").isin("ours", "theirs")).first()
        if mixed:
            raise InvalidInput(f"not a text, take one side: {mixed['path']}")
        return rows.select("path", F.when(F.col("take") == "ours", F.col("our_hash")).otherwise(F.col("their_hash")).alias("hash"))

    def conflict_hunks(self) -> DataFrame:
        return textdiff.conflict_hunks(self._conflict_texts())

    def decide(self, path: str, hunk_id: int, decision: str, manual: str | None = None) -> None:
        if decision not in DECISIONS:
            raise InvalidInput(f"unknown decision: {decision}")
        new = self.spark.createDataFrame([(path, hunk_id, decision, manual)], SCHEMAS["hunk_decisions"])
        self._commit({"hunk_decisions": changes.upserted(self.table("hunk_decisions"), new, KEYS["hunk_decisions"])})

    def resolve(self, take: str = "ours", now: datetime | None = None) -> dict:
        """Finishes what waits: recorded decisions first, ``take`` for all other hunks."""
        p = dict(self.state.pending)
        if not p:
            raise InvalidInput("nothing waits for decisions")
        if take not in DECISIONS:
            raise InvalidInput(f"unknown decision: {take}")
        whole = self._taken_whole(take)
        merged = textdiff.resolve(self._conflict_texts(), self.table("hunk_decisions"), take)
        files = merged.select("path", F.col("text").cast("binary").alias("content")).select("path", digest(F.col("content")).alias("hash"), "content")
        # A side that has no file, taken whole, takes the file away.
        side = {"ours": "our_hash", "theirs": "their_hash"}.get(take)
        texts = self._conflict_sides().where("is_text")
        gone = texts.where(F.col(side) == "").select("path") if side else files.limit(0).select("path")
        files = files.join(gone, "path", "left_anti")
        self._put(files)
        plan = self._three(p["base"], self.state.parent, p["theirs"], p["kind"])
        writes = files.select("path", "hash").unionByName(whole.where("hash <> ''"))
        manifest = changes.overlaid(threeway.merged_manifest(plan), writes, gone.unionByName(whole.where("hash = ''").select("path")))
        row = self._snapshot(manifest, p["message"], self.state.branch, self.state.parent, p["merge_parent"], now)
        empty = {"conflict_files": self.table("conflict_files").limit(0), "hunk_decisions": self.table("hunk_decisions").limit(0)}
        self._commit({"snapshots": self.table("snapshots").unionByName(row), **empty}, APPENDED, parent=self._last, pending={})
        if p.get("queue") is not None and p["kind"] == "rebase":
            return self._replay(p["queue"], {k: p[k] for k in ("kind", "start", "old")}, now)
        return {"hash": self._last, "conflicts": 0}

    def abort(self) -> str:
        p = self.state.pending
        if not p:
            raise InvalidInput("nothing waits for decisions")
        empty = {"conflict_files": self.table("conflict_files").limit(0), "hunk_decisions": self.table("hunk_decisions").limit(0)}
        self._commit(empty, parent=p.get("start", self.state.parent), pending={})
        return self.state.parent

    def squash(self, n: int, message: str, now: datetime | None = None) -> str:
        """The last ``n`` snapshots of the branch as one; tags and children follow."""
        if n < 2:
            raise InvalidInput("squash takes at least two snapshots")
        self._idle()
        tip, snapshots = self.state.parent, self.table("snapshots")
        tips = self.spark.createDataFrame([(self.state.branch, tip)], "branch string, hash string")
        chain = [r["hash"] for r in ancestry.squash_range(tips, snapshots, n).orderBy("depth").collect()]
        if len(chain) < n:
            raise InvalidInput("too few snapshots on the branch")
        parent = snapshots.where(F.col("hash") == chain[-1]).first()["parent_hash"]
        row = self._snapshot(self.manifest(tip), message, self.state.branch, parent, now=now)
        moves = self.spark.createDataFrame([(h, self._last) for h in chain], "old string, new string")
        rest = snapshots.where(~F.col("hash").isin(chain))
        moved = F.when(F.col("parent_hash").isin(chain), F.lit(self._last)).otherwise(F.col("parent_hash"))
        self._commit({"snapshots": rest.withColumn("parent_hash", moved).unionByName(row), "tags": refs.redirect_tags(self.table("tags"), moves)}, ("file_map",), parent=self._last)
        return self._last

    # Shelves ------------------------------------------------------------------------------------------

    def stash_push(self, working: DataFrame, name: str | None = None, now: datetime | None = None) -> str | None:
        dirty = self.status(working)
        if not dirty.limit(1).count():
            return None
        at = (now or datetime.now(UTC)).replace(microsecond=0, tzinfo=None)
        name = name or at.strftime("stash-%Y%m%d-%H%M%S")
        shelves = self.table("stash")
        if shelves.where(F.col("name") == name).limit(1).count():
            raise InvalidInput(f"shelf exists: {name}")
        files = self._hashed(working)
        self._put(files)
        row = self._snapshot(files.select("path", "hash"), name, STASH_BRANCH, self.state.parent, now=now)
        shelf = self.spark.createDataFrame([(self.state.seq, name, self._last, self.state.branch, self.state.parent, at)], SCHEMAS["stash"])
        self._commit({"snapshots": self.table("snapshots").unionByName(row), "stash": shelves.unionByName(shelf)}, APPENDED)
        return name

    def stashes(self) -> DataFrame:
        return self.table("stash").orderBy(F.desc("id"))

    def _shelf(self, name: str | None):
        s = self.table("stash") if name is None else self.table("stash").where(F.col("name") == name)
        row = s.orderBy(F.desc("id")).first()
        if row is None:
            raise InvalidInput(f"no such shelf: {name}")
        return row

    def stash_show(self, name: str | None = None) -> DataFrame:
        s = self._shelf(name)
        return changes.compare(self.manifest(s["parent_hash"]), self.manifest(s["snapshot_hash"])).where("status <> 'Same'")

    def stash_pop(self, name: str | None = None, working: DataFrame | None = None) -> DataFrame:
        """(path, action, content): what to write and what to delete; the shelf goes."""
        self._clean(working)
        s = self._shelf(name)
        plan = self.stash_show(s["name"]).join(self.table("objects").withColumnRenamed("hash", "new_hash"), "new_hash", "left")
        out = plan.select("path", F.when(F.col("status") == "Deleted", "delete").otherwise("write").alias("action"), "content")
        self.stash_drop(s["name"])
        return out

    def stash_drop(self, name: str) -> None:
        s = self._shelf(name)
        self._commit({"stash": self.table("stash").where(F.col("id") != s["id"])})

    # Retention ------------------------------------------------------------------------------------------

    def gc(self, keep_days: int = 14, now: datetime | None = None) -> dict:
        """Expired trash, then manifests, cache entries, decisions and objects that nothing names any more."""
        at = F.lit((now or datetime.now(UTC)).replace(tzinfo=None)).cast("timestamp")
        trash, snapshots = self.table("trash"), self.table("snapshots")
        kept = trash.join(retention.expired(trash, at, keep_days).select("hash"), "hash", "left_anti")
        names = snapshots.select("hash").unionByName(kept.select("hash")).withColumnRenamed("hash", "snapshot_hash")
        live = self.table("file_map").join(names, "snapshot_hash", "left_semi")
        objects = self.table("objects")
        loose = retention.unreferenced(objects, live).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b")).first()
        cache, decisions = self.table("index_cache"), self.table("hunk_decisions")
        self._commit({
            "trash": kept,
            "file_map": live,
            "objects": objects.join(live.select("hash"), "hash", "left_semi").dropDuplicates(["hash"]),
            "index_cache": cache.join(retention.stale_cache(cache, live, snapshots).select("path"), "path", "left_anti"),
            "hunk_decisions": decisions.join(self.table("conflict_files").select(F.col("path").alias("file_path")), "file_path", "left_semi"),
        })
        return {"removed": loose["n"], "freed": loose["b"], "folders": self._sweep()}

    def _sweep(self) -> int:
        """Deletes the folders of tables and the records that the newest record does not name; readers of older ones end."""
        fs, gone = self._fs(), []
        for name, at in self.state.tables.items():
            gone += [s.getPath() for s in fs.listStatus(self._jpath(f"{self.path}/tables/{name}")) if s.getPath().getName() != at]
        gone += [s.getPath() for s in fs.listStatus(self._jpath(f"{self.path}/state")) if s.getPath().getName() != f"{self.version:08d}"]
        return sum(bool(fs.delete(p, True)) for p in gone)
