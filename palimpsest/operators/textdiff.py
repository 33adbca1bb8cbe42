"""Line diffs, provenance and conflict resolution over tables of texts.

Each row holds the texts it compares, so that rows spread over all tasks however many
versions a path has.  Provenance links every line to the equal line of the version before
and follows the links by doubling, with no fold over a path's versions in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import myers
from ..functions.staging import staged
from ..functions.text import diff_text
from .ancestry import _doubled


def _lines(text) -> list[str]:
    parts = text.split("\n") if isinstance(text, str) and text else []
    return parts[:-1] if parts and parts[-1] == "" else parts


def consecutive(versions: DataFrame) -> DataFrame:
    """(path, version, old, new) from (path, version, text): each version with the one before; the first against ''."""
    before = versions.select("path", (F.col("version") + 1).alias("version"), F.col("text").alias("old"))
    j = versions.select("path", "version", F.col("text").alias("new")).join(before, ["path", "version"], "left")
    return j.select("path", "version", diff_text(F.coalesce("old", F.lit(""))).alias("old"), diff_text(F.coalesce("new", F.lit(""))).alias("new"))


def line_diff(pairs: DataFrame, context: int | None = 3) -> DataFrame:
    """(path, version, hunk, row, tag, old_no, new_no, line) of each pair (path, version, old, new).

    Only changes and ``context`` lines around them; whole texts if it is None.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "version", "hunk", "row", "tag", "old_no", "new_no", "line"]
        for b in batches:
            out = [
                (p, v, h, k, tag, i, j, line)
                for p, v, old, new in zip(b["path"], b["version"], b["old"], b["new"])
                for k, (h, tag, i, j, line) in enumerate(myers.rows(_lines(old), _lines(new), context))
            ]
            yield pd.DataFrame(out, columns=cols).astype({"old_no": "Int64", "new_no": "Int64"})

    return pairs.mapInPandas(run, "path string, version int, hunk int, row int, tag string, old_no int, new_no int, line string")


def hunks(pairs: DataFrame, context: int = 3) -> DataFrame:
    """One row for each hunk: (path, version, hunk, deleted, inserted, start, header).

    ``header`` names the hunk's first line and number of lines on either side, in the unified form.
    """
    d = line_diff(pairs, context)
    gone, come = F.count_if(F.col("tag") == "delete"), F.count_if(F.col("tag") == "insert")
    side = lambda c: F.concat_ws(",", F.coalesce(F.min(c), F.lit(0)).cast("string"), F.count(c).cast("string"))
    header = F.concat(F.lit("@@ -"), side("old_no"), F.lit(" +"), side("new_no"), F.lit(" @@"))
    start = F.min(F.coalesce("old_no", "new_no"))
    return d.groupBy("path", "version", "hunk").agg(gone.alias("deleted"), come.alias("inserted"), start.alias("start"), header.alias("header"))


def blame(versions: DataFrame) -> DataFrame:
    """(path, line_no, line, version): for each line of a path's last version the version that brought it."""
    d = staged(line_diff(consecutive(versions), None).where("tag <> 'delete'"), "blame")
    node = lambda v, n: F.concat_ws("\x00", F.col("path"), v.cast("string"), n.cast("string"))
    every = d.select(node(F.col("version"), F.col("new_no")).alias("hash"), "path", "version", "new_no", "line", "old_no")
    links = d.where("tag = 'equal'").select(
        node(F.col("version"), F.col("new_no")).alias("hash"), node(F.col("version") - 1, F.col("old_no")).alias("to"), F.lit(1).cast("long").alias("hops")
    )
    last = versions.groupBy("path").agg(F.max("version").alias("version"))
    tip = every.join(last, ["path", "version"])
    reach = tip.select(F.col("hash").alias("start"), "hash", F.lit(0).cast("long").alias("depth"))
    origin = _doubled(reach, links, ["start"]).groupBy("start").agg(F.max("depth").alias("depth"))
    found = tip.join(origin, tip["hash"] == origin["start"])
    return found.select("path", F.col("new_no").alias("line_no"), "line", (F.col("version") - F.col("depth").cast("int")).alias("version"))


def conflict_hunks(triples: DataFrame, context: int = 3) -> DataFrame:
    """(path, hunk_id, start, end, ours, theirs, base, before, after) of texts (path, base, ours, theirs) that clash.

    Line lists; ``before`` and ``after`` are up to ``context`` lines of the ancestor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, base, ours, theirs in zip(b["path"], b["base"], b["ours"], b["theirs"]):
                lines = _lines(base)
                found = [h for h in myers.merge_texts(lines, _lines(ours), _lines(theirs)) if isinstance(h, myers.Hunk)]
                out += [
                    (p, k, h.start, h.end, h.ours, h.theirs, h.base, lines[max(0, h.start - context) : h.start], lines[h.end : h.end + context])
                    for k, h in enumerate(found)
                ]
            yield pd.DataFrame(out, columns=["path", "hunk_id", "start", "end", "ours", "theirs", "base", "before", "after"])

    lists = "ours array<string>, theirs array<string>, base array<string>, before array<string>, after array<string>"
    return triples.mapInPandas(run, f"path string, hunk_id long, start long, end long, {lists}")


def resolve(triples: DataFrame, decisions: DataFrame | None = None, take: str = "ours") -> DataFrame:
    """(path, text, conflicts): merged texts with every hunk decided.

    ``decisions`` (file_path, hunk_id, decision, manual_content) go before ``take``, which
    holds for all others.  The trailing line feed is that of ours.
    """
    none = "map<bigint,struct<decision:string,manual_content:string>>"
    if decisions is None:
        fed = triples.withColumn("chosen", F.lit(None).cast(none))
    else:
        value = F.struct(F.col("hunk_id").alias("key"), F.struct("decision", "manual_content").alias("value"))
        per = decisions.groupBy(F.col("file_path").alias("path")).agg(F.map_from_entries(F.collect_list(value)).alias("chosen"))
        fed = triples.join(per, "path", "left")
    fed = fed.select("path", "base", "ours", "theirs", F.to_json("chosen").alias("chosen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for p, base, ours, theirs, chosen in zip(b["path"], b["base"], b["ours"], b["theirs"], b["chosen"]):
                picked = json.loads(chosen) if isinstance(chosen, str) else {}
                lines, n = [], 0
                for part in myers.merge_texts(_lines(base), _lines(ours), _lines(theirs)):
                    if isinstance(part, myers.Hunk):
                        d = picked.get(str(n)) or {}
                        lines += myers.decide(part, d.get("decision") or take, _lines(d.get("manual_content")))
                        n += 1
                    else:
                        lines += part
                end = "\n" if lines and isinstance(ours, str) and ours.endswith("\n") else ""
                out.append((p, "\n".join(lines) + end, n))
            yield pd.DataFrame(out, columns=["path", "text", "conflicts"])

    return fed.mapInPandas(run, "path string, text string, conflicts long")


def graph_lanes(listing: DataFrame) -> DataFrame:
    """(position, hash, lane, lanes) of a listing (position, hash, parent_hash, merge_parent), newest first.

    A lane waits for one snapshot, and a snapshot or parent without a lane takes the first free
    one.  Lanes follow the order of the whole listing, so it passes one task as a stream, which
    keeps the open lanes alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane_of: dict[str, int] = {}
        waiting: list[str | None] = []
        free: list[int] = []

        def take(name: str) -> None:
            while free and (free[0] >= len(waiting) or waiting[free[0]] is not None):
                heapq.heappop(free)
            if free:
                lane = heapq.heappop(free)
                waiting[lane] = name
            else:
                lane = len(waiting)
                waiting.append(name)
            lane_of[name] = lane

        for b in batches:
            out = []
            for pos, h, p, m in zip(b["position"], b["hash"], b["parent_hash"], b["merge_parent"]):
                if h not in lane_of:
                    take(h)
                lane, width = lane_of.pop(h), len(waiting)
                waiting[lane] = None
                for parent in (p, m):
                    if parent and parent not in lane_of:
                        if waiting[lane] is None:
                            waiting[lane], lane_of[parent] = parent, lane
                        else:
                            take(parent)
                if waiting[lane] is None:
                    heapq.heappush(free, lane)
                most = max(width, len(waiting))
                while waiting and waiting[-1] is None:
                    waiting.pop()
                out.append((pos, h, lane, most))
            yield pd.DataFrame(out, columns=["position", "hash", "lane", "lanes"])

    ordered = listing.select("position", "hash", "parent_hash", "merge_parent").repartitionByRange(1, "position").sortWithinPartitions("position")
    return ordered.mapInPandas(run, "position int, hash string, lane int, lanes int")
