"""All queries of the versioned-data engine, each with the SQL that must agree with it.

``QUERIES`` binds operators to the derived tables of :mod:`palimpsest.sources.fixtures`;
``ORACLE_SQL`` states the same in SQL over the raw tables.  Times are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import snapshot_id
from ..operators import ancestry, changes, intervals, refs, retention, search, textdiff, threeway
from ..sources.fixtures import NOW, Fixtures

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

# The derived tables in SQL, by name; each may use those before it.
FIXTURE_SQL = {
    "ord": "select o_orderkey k, o_custkey c, o_orderdate ts, o_orderstatus || ' ' || o_orderpriority message, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) prev, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders",
    "snapshots": "select o.k::varchar hash, o.message, 'c' || o.c branch, coalesce(o.prev::varchar, f.k::varchar, '') parent_hash, '' merge_parent, o.ts created_at, o.k seq from ord o left join ord f on o.prev is null and o.c > 1 and f.c = o.c // 2 and f.rn = 1",
    "file_map": "select l_orderkey::varchar snapshot_hash, 'd' || (l_partkey % 3) || '/f' || (l_partkey % 8) path, min(l_returnflag || l_linestatus) hash from lineitem group by 1, 2",
    "tags": "select 'v' || o_orderkey as name, o_orderkey::varchar snapshot_hash from orders where o_orderkey % 97 = 0 union all select 'rel-' || o_orderkey, o_orderkey::varchar from orders where o_orderkey % 485 = 0",
    "trash": "select 'e' || event_id hash, 'c' || user_id branch, ts deleted_at, event_id seq from events where event_type = 'error'",
    "cache": "select 'p/' || p_partkey path, p_size::bigint * 1000000000 mtime_ns, length(p_name)::bigint size, p_brand hash from part",
    "live": "select 'p/' || p_partkey path, (p_size + (p_partkey % 7 = 0)::int)::bigint * 1000000000 mtime_ns, length(p_name)::bigint size, p_brand hash from part where p_partkey % 11 <> 0",
    "stash": "select seq id, 'shelf-' || hash as name, hash snapshot_hash, branch, parent_hash from snapshots where seq % 499 = 0",
    "versions": "select source path, row_number() over (partition by source order by doc_id) as version, md5(text) hash, text from documents",
    "objects": "select md5(text) hash, length(min(text))::bigint length from documents group by 1",
    "lines": "select conv_id::varchar path, turn line_no, text line from conversations",
    "pairs": "select a.parent_hash base, a.hash ours, b.hash theirs from snapshots a join snapshots b on a.parent_hash = b.parent_hash and a.parent_hash <> '' and a.hash < b.hash",
    "ranges": "select l_orderkey::varchar path, case when l_linenumber % 2 = 1 then 'ours' else 'theirs' end side, l_partkey % 50 s, l_partkey % 50 + l_suppkey % 4 e from lineitem",
    "tips": "select branch, hash, message, parent_hash, created_at, seq from (select *, row_number() over (partition by branch order by created_at desc, seq desc) r from snapshots) where r = 1",
    "st": "select coalesce(n.snapshot_hash, o.snapshot_hash) snapshot_hash, coalesce(n.path, o.path) path, coalesce(o.hash, '') old_hash, coalesce(n.hash, '') new_hash, case when o.hash is null then 'New' when n.hash is null then 'Deleted' when o.hash <> n.hash then 'Modified' else 'Same' end status from (select f.* from file_map f join snapshots s on s.hash = f.snapshot_hash where s.parent_hash <> '') n full join (select s.hash snapshot_hash, f.path, f.hash from snapshots s join file_map f on f.snapshot_hash = s.parent_hash) o on n.snapshot_hash = o.snapshot_hash and n.path = o.path",
    "up": "select hash as start, hash, 0::bigint depth from snapshots union all select u.start, s.parent_hash, u.depth + 1 from up u join snapshots s on s.hash = u.hash where s.parent_hash <> ''",
    "tip_pairs": "select a.hash ours, b.hash theirs from tips a join tips b on b.branch = 'c' || (substr(a.branch, 2)::bigint // 2)",
    "keys3": "select base, ours, theirs, path from pairs join file_map on snapshot_hash = ours union select base, ours, theirs, path from pairs join file_map on snapshot_hash = theirs",
    "keys_all": "select * from keys3 union select base, ours, theirs, path from pairs join file_map on snapshot_hash = base",
}
_USES = {
    "snapshots": ["ord"], "stash": ["snapshots"], "pairs": ["snapshots"], "tips": ["snapshots"], "st": ["snapshots", "file_map"], "up": ["snapshots"],
    "tip_pairs": ["tips"], "keys3": ["pairs", "file_map"], "keys_all": ["keys3"],
}


def _sql(body: str, uses: str) -> str:
    need: list[str] = []

    def add(name: str) -> None:
        for u in _USES.get(name, []):
            add(u)
        if name not in need:
            need.append(name)

    for name in uses.split():
        add(name)
    head = ", ".join(f"{n} as ({FIXTURE_SQL[n]})" for n in need)
    return f"with recursive {head} {body}" if head else body


def query(name: str, uses: str = "", sql: str | None = None):
    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = _sql(sql, uses)
        return fn

    return register


def _time(c) -> object:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_T = "strftime(created_at, '%Y-%m-%d %H:%M:%S') created_at"


# Changes ------------------------------------------------------------------------------------


@query("status_changes", "st", "select snapshot_hash, path, status from st where status <> 'Same'")
def _(f):
    return changes.against_parent(f.snapshots, f.file_map).where("status <> 'Same'").select("snapshot_hash", "path", "status")


@query("change_counts", "st", "select status, count(*) n from st where status <> 'Same' group by 1")
def _(f):
    return changes.against_parent(f.snapshots, f.file_map).where("status <> 'Same'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("unchanged_files", "st", "select snapshot_hash, path, new_hash hash from st where status = 'Same'")
def _(f):
    same = changes.against_parent(f.snapshots, f.file_map).where("status = 'Same'")
    return same.select("snapshot_hash", "path", F.col("new_hash").alias("hash"))


@query(
    "snapshot_diff", "pairs file_map",
    "select coalesce(a.ours, b.ours) ours, coalesce(a.theirs, b.theirs) theirs, coalesce(a.path, b.path) path, coalesce(a.hash, '') old_hash, coalesce(b.hash, '') new_hash, case when a.hash is null then 'New' when b.hash is null then 'Deleted' else 'Modified' end status from (select ours, theirs, path, hash from pairs join file_map on snapshot_hash = ours) a full join (select ours, theirs, path, hash from pairs join file_map on snapshot_hash = theirs) b on a.ours = b.ours and a.theirs = b.theirs and a.path = b.path where a.hash is distinct from b.hash",
)
def _(f):
    keys = ["ours", "theirs"]
    both = changes.compare(changes.manifests_of(f.merge_pairs, "ours", f.file_map, keys), changes.manifests_of(f.merge_pairs, "theirs", f.file_map, keys), keys)
    return both.where("status <> 'Same'")


@query("cache_probe", "cache live", "select l.path, l.mtime_ns, l.size, coalesce(c.hash, '') hash, c.hash is not null hit from live l left join cache c on c.path = l.path and c.mtime_ns = l.mtime_ns and c.size = l.size")
def _(f):
    return changes.probe_cache(f.live_files, f.index_cache)


@query("carry_forward", "st snapshots file_map", "select s.hash snapshot_hash, p.path, p.hash from snapshots s join file_map p on p.snapshot_hash = s.parent_hash where not exists (select 1 from st where st.snapshot_hash = s.hash and st.path = p.path and st.status <> 'Same')")
def _(f):
    return changes.carry_forward(_parents(f), _dirty(f), ["snapshot_hash"])


def _parents(f: Fixtures) -> DataFrame:
    """Every snapshot with its parent's manifest."""
    s = f.snapshots.where("parent_hash <> ''").select(F.col("hash").alias("snapshot_hash"), "parent_hash")
    return changes.manifests_of(s, "parent_hash", f.file_map, ["snapshot_hash"])


def _dirty(f: Fixtures) -> DataFrame:
    return changes.against_parent(f.snapshots, f.file_map).where("status <> 'Same'")


@query("save_manifest", "snapshots file_map", "select f.* from file_map f join snapshots s on s.hash = f.snapshot_hash where s.parent_hash <> ''")
def _(f):
    dirty = _dirty(f)
    writes = dirty.where("new_hash <> ''").select("snapshot_hash", "path", F.col("new_hash").alias("hash"))
    return changes.overlaid(_parents(f), writes, dirty.where("new_hash = ''"), ["snapshot_hash"])


@query("amend_manifest", "tips file_map", "select 'amended-' || t.hash snapshot_hash, m.path, case when m.path = 'd0/f0' then 'ZZ' else m.hash end hash from tips t join (select snapshot_hash, path, hash from file_map union all select hash, 'd0/f0', 'ZZ' from tips where hash not in (select snapshot_hash from file_map where path = 'd0/f0')) m on m.snapshot_hash = t.hash")
def _(f):
    tips = refs.latest_per_branch(f.snapshots).select(F.concat(F.lit("amended-"), "hash").alias("new"), F.col("hash").alias("old"))
    base = changes.copied(f.file_map, tips)
    edit = tips.select(F.col("new").alias("snapshot_hash"), F.lit("d0/f0").alias("path"), F.lit("ZZ").alias("hash"))
    return changes.overlaid(base, edit, edit.limit(0), ["snapshot_hash"])


@query("content_dedup", "", "with d as (select md5(text) hash, min(doc_id) doc_id from documents group by 1), later as (select md5(text) hash, doc_id from documents where source <> 'src0') select distinct hash from later where hash not in (select md5(text) from documents where source = 'src0')")
def _(f):
    d = f.table("documents").select("source", F.md5(F.col("text").cast("binary")).alias("hash"))
    return changes.new_objects(d.where("source <> 'src0'").select("hash"), d.where("source = 'src0'").select("hash"))


@query("upsert_cache", "cache live", "select * from live union all select * from cache where path not in (select path from live)")
def _(f):
    return changes.upserted(f.index_cache, f.live_files, ["path"])


@query("checkout", "tags file_map", "select name, path, hash from tags join file_map using (snapshot_hash)")
def _(f):
    return changes.manifests_of(f.tags, "snapshot_hash", f.file_map, ["name"])


@query("checkout_paths", "tags file_map", "select name, path, hash from tags join file_map using (snapshot_hash) where starts_with(path, 'd1/') or starts_with(path, 'd2/f3')")
def _(f):
    from ..functions.text import under_any

    return changes.manifests_of(f.tags, "snapshot_hash", f.file_map, ["name"]).where(under_any(F.col("path"), ["d1\\", "d2/f3"]))


@query("checkout_content", "versions objects", "select v.path, v.version, v.hash, o.length from versions v join objects o using (hash)")
def _(f):
    return f.doc_versions.select("path", F.col("version").cast("long").alias("version"), "hash").join(f.objects.select("hash", "length"), "hash")


@query("ghost_files", "pairs file_map", "select ours, theirs, path from pairs join file_map f on f.snapshot_hash = ours where not exists (select 1 from file_map g where g.snapshot_hash = theirs and g.path = f.path)")
def _(f):
    keys = ["ours", "theirs"]
    return changes.ghosts(changes.manifests_of(f.merge_pairs, "ours", f.file_map, keys), changes.manifests_of(f.merge_pairs, "theirs", f.file_map, keys), keys)


@query("stash_listing", "stash", "select id, name, snapshot_hash, branch, row_number() over (order by id desc) as position from stash")
def _(f):
    from pyspark.sql import Window as W

    return f.stash.select("id", "name", "snapshot_hash", "branch", F.row_number().over(W.orderBy(F.desc("id"))).cast("long").alias("position"))


@query("stash_apply_plan", "stash st", "select name, path, new_hash hash, case when status = 'Deleted' then 'delete' else 'write' end action from stash join st using (snapshot_hash) where status <> 'Same'")
def _(f):
    shelf = f.stash.select("name", "snapshot_hash").join(_dirty(f), "snapshot_hash")
    return shelf.select("name", "path", F.col("new_hash").alias("hash"), F.when(F.col("status") == "Deleted", "delete").otherwise("write").alias("action"))


# References and history -----------------------------------------------------------------------


@query("branch_latest", "tips", f"select branch, hash, message, parent_hash, {_T}, seq from tips")
def _(f):
    return refs.branches(f.snapshots).drop("is_current").withColumn("created_at", _time("created_at"))


@query("tags_listing", "tags snapshots", "select name, snapshot_hash, coalesce(message, '(deleted)') message from tags left join (select * from snapshots where branch <> 'c3') s on s.hash = snapshot_hash")
def _(f):
    return refs.tag_listing(f.tags, f.snapshots.where("branch <> 'c3'"))


@query("ref_resolution", "tags tips snapshots", "select name, case when t.th is not null then 'tag' when p.n = 1 then 'prefix' when p.n > 1 then 'ambiguous' when b.hash is not null then 'branch' else 'unknown' end kind, coalesce(case when t.th is not null then t.th when p.n = 1 then p.h when p.n > 1 then '' else b.hash end, '') hash from (select name from tags union select branch from snapshots union select substr(hash, 1, 3) from snapshots union select hash from snapshots union select 'no-such') q left join (select name tn, snapshot_hash th from tags) t on t.tn = name left join (select k, count(*) n, min(hash) h from (select substr(hash, 1, 3) k, hash from snapshots where length(hash) >= 3 union select hash, hash from snapshots where length(hash) <> 3 union select substr(hash, 1, 1), hash from snapshots union select substr(hash, 1, 2), hash from snapshots where length(hash) >= 2 union select substr(hash, 1, 4), hash from snapshots where length(hash) >= 4 union select substr(hash, 1, 5), hash from snapshots where length(hash) >= 5 union select substr(hash, 1, 6), hash from snapshots where length(hash) >= 6) group by 1) p on p.k = name left join tips b on b.branch = name")
def _(f):
    s = f.snapshots
    asked = f.tags.select("name").union(s.select("branch")).union(s.select(F.substring("hash", 1, 3))).union(s.select("hash"))
    return refs.resolve(asked.union(f.spark.createDataFrame([("no-such",)], "name string")), f.tags, s)


_H = f"select hash, branch, message, parent_hash, {_T}, seq, coalesce(name, '') tag from snapshots left join tags on snapshot_hash = hash"


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", _time("created_at"))


@query("history_all", "snapshots tags", _H)
def _(f):
    return _listed(refs.history(f.snapshots, f.tags))


@query("history_branch", "snapshots tags", _H + " where branch = 'c7'")
def _(f):
    return _listed(refs.history(f.snapshots, f.tags, branch="c7"))


@query("history_limit", "snapshots tags", f"select * exclude (o), row_number() over (order by o desc, seq desc, tag) as position from (select hash, branch, message, parent_hash, {_T}, seq, coalesce(name, '') tag, created_at o from snapshots s left join tags on snapshot_hash = hash order by s.created_at desc, seq desc, tag limit 20)")
def _(f):
    return _listed(refs.numbered(refs.history(f.snapshots, f.tags, limit=20)).withColumn("position", F.col("position").cast("long")))


@query("history_file_contains", "snapshots file_map", "select hash, branch, seq from snapshots s where exists (select 1 from file_map f where f.snapshot_hash = s.hash and f.path = 'd1/f4')")
def _(f):
    return refs.containing(f.snapshots, f.file_map, "d1/f4").select("hash", "branch", "seq")


@query("history_file_touched", "snapshots file_map", "select s.hash, s.branch, s.seq from snapshots s left join file_map a on a.snapshot_hash = s.hash and a.path = 'd1/f4' left join file_map b on b.snapshot_hash = s.parent_hash and b.path = 'd1/f4' where coalesce(a.hash, '') <> coalesce(b.hash, '')")
def _(f):
    return refs.touching(f.snapshots, f.file_map, "d1/f4").select("hash", "branch", "seq")


@query("soft_delete_branch", "snapshots", "select hash, case when branch = 'c5' then '_deleted_c5' else branch end branch from snapshots")
def _(f):
    return refs.soft_delete(f.snapshots, "c5").select("hash", "branch")


@query("visible_branches", "snapshots", "select distinct branch from snapshots where branch <> 'c5'")
def _(f):
    return refs.branches(refs.soft_delete(f.snapshots, "c5")).select("branch")


# Ancestry ---------------------------------------------------------------------------------------


@query("ancestry", "up", "select start, hash, depth from up")
def _(f):
    return ancestry.ancestors(f.snapshots.select(F.col("hash").alias("start")), f.snapshots)


@query("is_ancestor", "pairs up", "select o as old, n as new, exists (select 1 from up where start = n and hash = o) is_ancestor from (select base o, ours n from pairs union select ours, theirs from pairs union select ours, base from pairs)")
def _(f):
    p = f.merge_pairs
    pair = lambda a, b: p.select(F.col(a).alias("old"), F.col(b).alias("new"))
    return ancestry.is_ancestor(pair("base", "ours").union(pair("ours", "theirs")).union(pair("ours", "base")).distinct(), f.snapshots)


def _tip_pairs(f: Fixtures) -> DataFrame:
    """Every branch's tip with that of the branch it may have forked from."""
    t = refs.latest_per_branch(f.snapshots).select(F.expr("cast(substring(branch, 2) as bigint)").alias("c"), "hash")
    o = t.select(F.col("c").alias("c2"), F.col("hash").alias("theirs"))
    return t.join(o, F.col("c2") == F.floor(F.col("c") / 2)).select(F.col("hash").alias("ours"), "theirs")


_LCA = "select p.ours, p.theirs, coalesce(first(a.hash order by a.depth), '') base, coalesce(min(a.depth), -1) depth from tip_pairs p left join (select a.start ours, b.start theirs, a.hash, a.depth from up a join up b on a.hash = b.hash join tip_pairs q on q.ours = a.start and q.theirs = b.start) a on a.ours = p.ours and a.theirs = p.theirs group by 1, 2"


@query("lca_pairs", "tip_pairs up", _LCA)
def _(f):
    return ancestry.lca(_tip_pairs(f), f.snapshots)


@query("commits_not_in_target", "tip_pairs up", "select p.ours head, p.theirs onto, a.hash, a.depth from tip_pairs p join up a on a.start = p.ours where not exists (select 1 from up b where b.start = p.theirs and b.hash = a.hash)")
def _(f):
    return ancestry.commits_not_in(_tip_pairs(f).select(F.col("ours").alias("head"), F.col("theirs").alias("onto")), f.snapshots)


_SQ = "select t.branch, u.hash, u.depth from tips t join up u on u.start = t.hash and u.depth < 3 join snapshots s on s.hash = u.hash and s.branch = t.branch"


@query("squash_range", "tips up", _SQ)
def _(f):
    return ancestry.squash_range(refs.latest_per_branch(f.snapshots), f.snapshots, 3)


@query("squash_copy", "tips file_map", "select 'sq-' || hash snapshot_hash, path, f.hash from tips t join (select snapshot_hash, path, hash from file_map) f on f.snapshot_hash = t.hash".replace("'sq-' || hash", "'sq-' || t.hash"))
def _(f):
    t = refs.latest_per_branch(f.snapshots)
    return changes.copied(f.file_map, t.select(F.col("hash").alias("old"), F.concat(F.lit("sq-"), "hash").alias("new")))


@query("tag_redirect", "tips up tags", f"select name, coalesce('sq-' || r.branch, snapshot_hash) snapshot_hash from tags left join ({_SQ}) r on r.hash = snapshot_hash")
def _(f):
    r = ancestry.squash_range(refs.latest_per_branch(f.snapshots), f.snapshots, 3)
    return refs.redirect_tags(f.tags, r.select(F.col("hash").alias("old"), F.concat(F.lit("sq-"), "branch").alias("new")))


@query("fast_forward_copy", "pairs file_map", "select 'ff-' || ours snapshot_hash, path, hash from (select distinct ours from pairs) join file_map on snapshot_hash = ours")
def _(f):
    return changes.copied(f.file_map, f.merge_pairs.select(F.col("ours").alias("old"), F.concat(F.lit("ff-"), "ours").alias("new")).distinct())


# Three-way plans ----------------------------------------------------------------------------------

_K = ["base", "ours", "theirs"]
_COLS = "k.base, k.ours, k.theirs, k.path, coalesce(a.hash, '') base_hash, coalesce(o.hash, '') our_hash, coalesce(t.hash, '') their_hash"
_JOIN = "left join file_map a on a.snapshot_hash = k.base and a.path = k.path left join file_map o on o.snapshot_hash = k.ours and o.path = k.path left join file_map t on t.snapshot_hash = k.theirs and t.path = k.path"
_MERGE = f"select *, case when our_hash = their_hash then 'skip' when our_hash = base_hash and their_hash = '' then 'delete' when our_hash = base_hash and base_hash = '' then 'add' when our_hash = base_hash then 'update' when their_hash = base_hash then 'keep' when their_hash = '' then 'keep_deleted_theirs' when our_hash = '' then 'update' else 'conflict' end action from (select {_COLS} from keys3 k {_JOIN})"
_PICK = f"select *, case when their_hash = base_hash then 'skip' when our_hash = base_hash and their_hash = '' then 'delete' when our_hash = base_hash then case when base_hash = '' then 'add' else 'update' end when our_hash = their_hash then 'skip' when their_hash = '' then 'keep_deleted_theirs' else 'conflict' end action from (select {_COLS} from keys3 k {_JOIN})"
_REBASE = f"select *, case when their_hash = base_hash then 'keep' when our_hash = base_hash and their_hash = '' then 'delete' when our_hash = base_hash then case when base_hash = '' then 'add' else 'update' end when our_hash = their_hash then 'skip' else 'conflict' end action from (select {_COLS} from keys_all k {_JOIN})"


def _plan(f: Fixtures, policy: str) -> DataFrame:
    side = lambda s: changes.manifests_of(f.merge_pairs, s, f.file_map, _K)
    return threeway.three_way(side("base"), side("ours"), side("theirs"), policy, _K)


@query("merge_plan", "keys3", _MERGE)
def _(f):
    return _plan(f, "merge")


@query("cherry_pick_plan", "keys3", _PICK)
def _(f):
    return _plan(f, "cherry_pick")


@query("rebase_plan", "keys_all", _REBASE)
def _(f):
    return _plan(f, "rebase")


@query("merge_summary", "keys3", f"select action, count(*) n from ({_MERGE}) group by 1")
def _(f):
    return _plan(f, "merge").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("merged_manifest", "keys3", f"select base, ours, theirs, path, case when action in ('add', 'update') then their_hash else our_hash end hash from ({_MERGE}) where action <> 'delete' and not (action not in ('add', 'update') and our_hash = '')")
def _(f):
    return threeway.merged_manifest(_plan(f, "merge"), _K)


@query("conflict_listing", "keys3", f"select base, ours, theirs, path, base_hash ancestor_hash, our_hash, their_hash from ({_MERGE}) where action = 'conflict'")
def _(f):
    return _plan(f, "merge").where("action = 'conflict'").withColumnRenamed("base_hash", "ancestor_hash").drop("action")


# Undo, redo, garbage ------------------------------------------------------------------------------


@query("undo_move", "snapshots tips tags", "select 'snapshots' as place, hash as name from snapshots where hash not in (select hash from tips) union all select 'trash', hash from tips union all select 'tags', name from tags where snapshot_hash not in (select hash from tips)")
def _(f):
    left, kept, gone = retention.undo(f.snapshots, f.tags, f.trash.limit(0), f.snapshots.select("branch").distinct(), F.lit(NOW).cast("timestamp"))
    named = lambda place, df, c: df.select(F.lit(place).alias("place"), F.col(c).alias("name"))
    return named("snapshots", left, "hash").union(named("trash", gone, "hash")).union(named("tags", kept, "name"))


@query("redo_pop", "trash", "select branch, hash, seq from (select *, row_number() over (partition by branch order by deleted_at desc, seq desc) r from trash) where r = 1")
def _(f):
    return retention.redo_top(f.trash).select("branch", "hash", "seq")


@query("gc_expired_trash", "trash", f"select hash, seq from trash where deleted_at <= timestamp '{NOW}' - interval 14 days")
def _(f):
    return retention.expired(f.trash, F.lit(NOW).cast("timestamp"), 14).select("hash", "seq")


def _undone(f: Fixtures) -> DataFrame:
    """Snapshots after an undo on every branch whose trash has been emptied."""
    return f.snapshots.join(refs.latest_per_branch(f.snapshots).select("hash"), "hash", "left_anti")


@query("gc_orphan_manifest", "tips snapshots file_map", "select * from file_map where snapshot_hash in (select hash from tips) or snapshot_hash not in (select hash from snapshots)")
def _(f):
    return retention.orphan_manifests(f.file_map, _undone(f), f.trash)


@query("gc_stale_cache", "cache live", "select path from cache where path not in (select path from live)")
def _(f):
    manifest = f.live_files.select(F.lit("now").alias("snapshot_hash"), "path", "hash")
    now = f.spark.createDataFrame([("now",)], "hash string")
    return retention.stale_cache(f.index_cache, manifest, now).select("path")


@query("gc_stale_decisions", "pairs keys3", f"select distinct ours || ':' || path file_path from pairs join file_map on snapshot_hash = ours except select ours || ':' || path from ({_MERGE}) where action = 'conflict'")
def _(f):
    name = F.concat_ws(":", "ours", "path")
    decided = changes.manifests_of(f.merge_pairs, "ours", f.file_map, ["ours"]).select(name.alias("file_path")).distinct()
    return retention.stale_decisions(decided, _plan(f, "merge").where("action = 'conflict'").select(name.alias("path")))


_UNREF = "select hash, length from objects where hash not in (select hash from (select hash, row_number() over (partition by path order by version desc) r from versions) where r = 1)"


def _unreferenced(f: Fixtures) -> DataFrame:
    last = f.doc_versions.groupBy("path").agg(F.max_by("hash", "version").alias("hash"))
    return retention.unreferenced(f.objects.select("hash", "length"), last)


@query("gc_unreferenced_objects", "objects versions", _UNREF)
def _(f):
    return _unreferenced(f)


@query("gc_freed_bytes", "objects versions", f"select count(*) removed, coalesce(sum(length), 0)::bigint freed from ({_UNREF})")
def _(f):
    return _unreferenced(f).agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("freed"))


# Search and ranges ----------------------------------------------------------------------------------

_RE = "[aeiou]tion (the|de|la) "


@query("grep_lines", "lines", f"select path, line_no, line from lines where regexp_matches(line, '{_RE}')")
def _(f):
    return search.grep(f.lines, _RE)


@query("grep_icase", "lines", "select path, line_no from lines where regexp_matches(line, '(?i)^the [a-m]')")
def _(f):
    return search.grep(f.lines, "^the [a-m]", ignore_case=True).select("path", "line_no")


@query("grep_files", "lines", f"select path, count(*) n from lines where regexp_matches(line, '{_RE}') group by 1")
def _(f):
    return search.grep_files(f.lines, _RE)


@query("grep_context", "lines", f"select path, line_no, is_match, coalesce(line_no - lag(line_no) over (partition by path order by line_no) > 1, true) new_block from (select *, max(is_match) over (partition by path order by line_no rows between 2 preceding and 2 following) shown from (select *, regexp_matches(line, '{_RE}') is_match from lines)) where shown")
def _(f):
    return search.grep_context(f.lines, _RE).select("path", "line_no", "is_match", "new_block")


@query("grep_snapshot", "versions", "select path, version, line_no, line from (select path, version, unnest(ls) line, unnest(range(1, len(ls) + 1)) line_no from (select path, version, string_split(case when ends_with(text, chr(10)) then text[:-2] else text end, chr(10)) ls from versions where text <> '')) where regexp_matches(line, 'ing\\.$')")
def _(f):
    name = F.concat_ws("\x00", "path", F.col("version").cast("string"))
    found = search.grep(search.numbered_lines(f.doc_versions.select(name.alias("path"), "text")), "ing\\.$")
    parts = F.split("path", "\x00")
    return found.select(parts[0].alias("path"), parts[1].cast("long").alias("version"), F.col("line_no").cast("long").alias("line_no"), "line")


@query("range_overlap", "ranges", "select o.path, o.s ours_start, o.e ours_end, t.s theirs_start, t.e theirs_end from ranges o join ranges t on o.path = t.path and o.side = 'ours' and t.side = 'theirs' where case when o.s = o.e and t.s = t.e then o.s = t.s when o.s = o.e then t.s <= o.s and o.s <= t.e when t.s = t.e then o.s <= t.s and t.s <= o.e else o.s < t.e and t.s < o.e end")
def _(f):
    return intervals.overlaps(f.ranges)


@query("interval_coalesce", "ranges", "select path, side, min(s) as start, max(e) as end_ from (select *, sum(case when s <= reach then 0 else 1 end) over (partition by path, side order by s, e rows unbounded preceding) island from (select *, max(e) over (partition by path, side order by s, e rows between unbounded preceding and 1 preceding) reach from ranges)) group by path, side, island")
def _(f):
    return intervals.coalesced(f.ranges, ["path", "side"]).withColumnRenamed("end", "end_")


# Texts: no SQL counterpart ------------------------------------------------------------------------


@query("line_diff")
def _(f):
    return textdiff.line_diff(textdiff.consecutive(f.doc_versions))


@query("diff_hunks")
def _(f):
    return textdiff.hunks(textdiff.consecutive(f.doc_versions))


@query("blame")
def _(f):
    return textdiff.blame(f.doc_versions)


def _triples(f: Fixtures, span: int = 64) -> DataFrame:
    """Every version of every path with the next two, as ancestor, ours and theirs; named ``path@version``.

    Versions go in runs of ``span``, each with the two versions after it, so that a path spreads over tasks.
    """
    runs = F.sequence(F.floor(F.greatest(F.col("version") - 3, F.lit(0)) / span), F.floor((F.col("version") - 1) / span))
    v = f.doc_versions.select("path", "version", "text", F.explode(runs).alias("run"))
    w = Window.partitionBy("path", "run").orderBy("version")
    ours, theirs, last = F.lead("text", 1).over(w), F.lead("text", 2).over(w), F.lead("version", 2).over(w)
    j = v.select("path", "version", "run", F.col("text").alias("base"), ours.alias("ours"), theirs.alias("theirs"), last.alias("last"))
    j = j.where(F.col("last").isNotNull() & (F.floor((F.col("version") - 1) / span) == F.col("run")))
    return j.select(F.concat_ws("@", "path", F.col("version").cast("string")).alias("path"), "base", "ours", "theirs")


@query("conflict_hunks")
def _(f):
    return textdiff.conflict_hunks(_triples(f))


@query("resolve_take")
def _(f):
    return textdiff.resolve(_triples(f), take="theirs")


@query("history_graph")
def _(f):
    rows = refs.numbered(refs.history(f.snapshots, f.tags.limit(0), limit=None))
    return textdiff.graph_lanes(rows.withColumn("merge_parent", F.lit("")))


# Scalars ------------------------------------------------------------------------------------------

_MARKED = "select doc_id, case when doc_id % 3 = 0 then chr(65279) else '' end || replace(text, chr(10), case when doc_id % 2 = 0 then chr(13) || chr(10) else chr(13) end) t from documents"


def _marked(f: Fixtures) -> DataFrame:
    """Texts with other line ends, and a byte order mark before every third."""
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    mark = F.when(F.col("doc_id") % 3 == 0, "\ufeff").otherwise("")
    return f.table("documents").select("doc_id", F.concat(mark, F.replace("text", F.lit("\n"), end)).alias("t"))


@query(
    "text_forms", "",
    f"select doc_id, md5(replace(t, chr(13), '')) stored, md5(replace(replace(ltrim(t, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) compared, "
    f"md5(replace(ltrim(t, chr(65279)), chr(13) || chr(10), chr(10))) shown, sha256(t) digest from ({_MARKED})",
)
def _(f):
    t = F.col("t")
    return _marked(f).select("doc_id", F.md5(text.stored_text(t)).alias("stored"), F.md5(text.diff_text(t)).alias("compared"), F.md5(text.show_text(t)).alias("shown"), text.digest(t).alias("digest"))


@query(
    "line_lists", "",
    "select doc_id, len(case when ends_with(text, chr(10)) then list_slice(string_split(text, chr(10)), 1, -2) when text = '' then [] else string_split(text, chr(10)) end)::int n, "
    "md5(case when text = '' then '' else rtrim_one end) joined from (select *, case when ends_with(text, chr(10)) then text else text || chr(10) end rtrim_one from documents)",
)
def _(f):
    at = text.lines(F.col("text"))
    return f.table("documents").select("doc_id", F.size(at).alias("n"), F.md5(text.joined(at, F.size(at) > 0)).alias("joined"))


@query("binary_guard", "", "select doc_id, instr(substr(t, 1, 1024), chr(0)) > 0 is_binary from (select doc_id, case when doc_id % 4 = 0 then substr(text, 1, (doc_id % 2000)::int) || chr(0) || text else text end t from documents)")
def _(f):
    odd = F.concat(F.expr("substr(text, 1, cast(doc_id % 2000 as int))"), F.lit("\x00"), F.col("text"))
    return f.table("documents").select("doc_id", text.is_binary(F.when(F.col("doc_id") % 4 == 0, odd).otherwise(F.col("text"))).alias("is_binary"))


@query(
    "snapshot_ids", "snapshots",
    "select hash, substr(sha256(message || chr(0) || branch || chr(0) || parent_hash || chr(0) || strftime(created_at, '%Y-%m-%d %H:%M:%S') || chr(0) || seq::varchar), 1, 12) id, "
    "substr(message, 1, 8) short, strftime(created_at, '%Y-%m-%d %H:%M') date, ((seq * 10 + 512) // 1024 // 10)::varchar || '.' || ((seq * 10 + 512) // 1024 % 10)::varchar || ' KB' kb from snapshots",
)
def _(f):
    own = snapshot_id(F.col("message"), F.col("branch"), F.col("parent_hash"), F.col("created_at"), F.col("seq"))
    short = text.short_id(F.col("message")).alias("short"), text.short_date(F.col("created_at")).alias("date"), text.kilobytes(F.col("seq")).alias("kb")
    return f.snapshots.select("hash", own.alias("id"), *short)


@query(
    "match_spans", "lines",
    "select path, line_no, (i - 1)::int nth, (sum(length(part)) over w + 2 * (i - 1))::bigint start, (sum(length(part)) over w + 2 * i)::bigint end_, 'th' as text "
    "from (select path, line_no, parts, unnest(parts) part, unnest(range(1, len(parts) + 1)) i from (select path, line_no, string_split(line, 'th') parts from lines where contains(line, 'th'))) "
    "window w as (partition by path, line_no order by i) qualify i < len(parts)",
)
def _(f):
    return search.match_spans(f.lines, "th").withColumnRenamed("end", "end_")
